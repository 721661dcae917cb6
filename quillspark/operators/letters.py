"""Texts of letters: briefs, notes on excerpts and blocks, answers that quote them, scene notes, and the unit a letter is read by.

All of it is expressions and equi-joins; what is gathered is one section's chunk ids and the first chapters of a book, never a table.
A null text counts as empty; null or empty names are no names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import templates as P
from quillspark.functions import text as T
from quillspark.operators import guide as U
from quillspark.operators import joins as J

# The texts of briefs, notes, answers and units, and what stands where something is missing.
BRIEF = "本节对应《旅行人信札》中的“{title}”，当前 brief 仅依据标题与结构元数据生成，待后续人工细读。"
BRIEF_UNTITLED = "本节为一封书信正文，当前 brief 仅依据结构元数据生成，待后续人工细读。"
BRIEF_STATUS = "auto_structural_draft"
EVIDENCE_NOTE = "Structural evidence only; no source text excerpt is included."
EXCERPT_LABELS = {
    "opening_scene": "开篇场景",
    "route_movement": "路线移动",
    "place_description": "地点描写",
    "travel_observation": "旅途观察",
    "reflection": "感受反思",
    "closing_moment": "收束时刻",
}
EXCERPT_LABEL = "阅读线索"
EXCERPT_AT_PLACES = "{label}：这段直接触及{places}，适合作为理解本封信地点经验的文本入口。"
EXCERPT_NOTES = {
    "route_movement": "路线移动：这段能看到作者在交通、道路或抵达过程中的实际感受。",
    "travel_observation": "旅途观察：这段保留了风景、城市或环境的现场感，适合先读再看今昔对照。",
    "reflection": "感受反思：这段把旅程中的情绪和判断露出来，可作为精读切入点。",
    "opening_scene": "开篇场景：这段把本封信的行旅现场打开，适合作为快速浏览的第一处文本锚。",
    "closing_moment": "收束时刻：这段可帮助读者把本封信的移动、观察和回望合在一起。",
}
EXCERPT_NOTE = "阅读线索：这段来自本封信正文，可帮助读者把导读说明落回原书文字。"
EXCERPT_USES = {
    "route_movement": "先看移动方式和空间转换，再回到路线结构。",
    "place_description": "先圈出地点名，再对照本封信中的今日景点说明。",
    "travel_observation": "先读景物和环境，再看场景说明如何解释这种观察。",
    "reflection": "先抓住情绪和判断，再回答阅读问题。",
}
EXCERPT_USE = "先读原文，再看下方场景、路线、今昔对照和参考回答。"
BLOCK_LABELS = {
    "opening_scene": "开篇场景",
    "route_movement": "路线移动",
    "place_observation": "地点观察",
    "travel_detail": "旅途细节",
    "reflection": "感受反思",
    "turning_point": "旅程转折",
    "closing_moment": "收束时刻",
}
BLOCK_LABEL = "阅读片段"
BLOCK_AT_PLACES = "{label}：这段把{places}放进具体行旅语境中，适合先读原文再看地点对照。"
BLOCK_NOTES = {
    "opening_scene": "开篇场景：这段比短摘更完整地打开本封信的时间、状态或出发处境。",
    "route_movement": "路线移动：这段保留了交通、道路或抵达过程，可帮助读者顺着旅程阅读。",
    "travel_detail": "旅途细节：这段呈现途中人物、住宿、交通或日常细节，让旅行不只是地点列表。",
    "reflection": "感受反思：这段把作者的判断和情绪放出来，适合作为精读问题的依据。",
    "turning_point": "旅程转折：这段显示叙述或情绪的转向，适合对照前后段落阅读。",
    "closing_moment": "收束时刻：这段帮助读者理解本封信如何结束或回望这一段旅程。",
}
BLOCK_NOTE = "阅读片段：这段来自本封信正文，可作为个人阅读导览中的连续原文入口。"
NO_TITLE = "本封信"
EXCERPT_ANCHOR = ("real_source_excerpt", "这个问题先回到对应信封卡的原文选段，再展开场景、路线和今昔对照。")
EXCERPT_QUICK = "参考回答：先读“{text}”，再把《{title}》中的地点和移动线索连起来看。"
EXCERPT_DEEP = "参考回答：这封信可从核心原文选段进入。{note} 再结合 {places} 的路线顺序，就能把原文中的现场感、移动过程和今日对照放在同一条阅读线上。"
NO_PLACES = "本封信的地点"
NO_EXCERPT_NOTE = "这段原文适合作为精读入口。"
SAMPLE_ANCHOR = ("real_source_excerpt_route_sample", "全书问题先连接前三封信的真实原文选段，再回到 25 封书信整体路线。")
SAMPLE_QUICK = "参考回答：可以先读前三封信的真实原文选段，看到路线如何从具体交通、地点和观察中展开。"
SAMPLE_DEEP = "参考回答：这 25 封信不是抽象路线表，而是由一段段具体行旅文字推进。先读前三封信的原文选段，再顺着时间线看地点、交通、风景和感受如何逐步连成旅行经验。"
EXCERPT_BASIS = "基于真实原文选段、地点线索与公开导读信息生成，待人工复核。"
BLOCK_ANCHOR = ("source_reading_block", "这个问题优先回到对应书信的原文节选阅读块，再展开场景、路线和今昔对照。")
BLOCK_QUICK = "参考回答：先读这段原文节选“{text}”，再回到《{title}》的路线和地点关系。"
BLOCK_DEEP = "参考回答：这封信现在可以先从一个较完整的原文阅读块进入。{note} 读完这段后，再把下方场景说明、今昔对照和问题回答连起来看，会比只看一句短摘更接近原书的阅读节奏。"
SCENE_TAG = "原书信息中可见{tag}线索，适合作为细读入口。"
SCENE_PLACES = "标题和正文线索把{places}组织成本封信的空间骨架。"
SCENE_THEMES = "结构主题提示读者关注{themes}。"
SCENE_TITLE = "本封信以“{title}”为主要定位，具体场景仍待人工复核。"
SCENE_FILLER = "本条导读仍处于公开预览阶段，需要回到原书继续校订。"
STEPS = (
    "先看路线：把“{route}”当作本封信的阅读骨架。",
    "再读原文摘录或原文线索，抓住作者在路上看到、想到或停留的细节。",
    "找场景变化：注意出发、途中、抵达、山水、城市或寺庙等场景如何切换。",
    "对照今日地点：区分当年旅行经验和今天景区、城市、交通节点的读法。",
    "最后回到阅读问题，用地点线索和场景线索组织自己的回答。",
)
STEPS_ROUTE = "本封信路线"
CLUE_MODE = "short_original_clue"
CLUE_NOTE = "用于定位本封信的场景和语气，不作为全文替代。"
CLUE_USE = "先读这一小段，再看下方的场景和地点说明。"
FOCUS_CLUE = "标题和路线把本封信放在“{route}”这一段旅程中。"
SCENE_CLUE = "本封信的核心场景围绕 {route} 展开。"
PLACE_CLUE = "地点线索：{places}。"
MORE_CLUES = (
    ("structured_reading_clue", "结构化原文线索：用于提示本封信的阅读焦点。", "用来看本封信如何从标题、场景和地点进入旅行叙事。"),
    ("scene_clue", "场景线索：帮助读者在不阅读整章全文的情况下抓住叙事位置。", "用来看出发、途中、抵达或观看方式的转换。"),
    ("place_clue", "地点线索：把短摘和今日景点说明连接起来。", "用来对照下方的昔日旅程与今日读法。"),
)
UNREVIEWED = "待人工复核"
NO_GUIDE = "本封信的导读摘要仍待人工复核。"
NO_STAMP = "日期待复核"
LENGTH_HINTS = ("篇幅较长，适合分两次阅读。", "信息密度较高，建议按场景分段阅读。", "篇幅较短，适合先快速顺读。", "中等篇幅，适合按路线和地点线索阅读。")
NO_FOCUS = "看地点、场景和旅行节奏如何变化。"
UNIT_STEPS = ("先看路线和地点。", "再读原文线索。", "接着看今昔对照。", "最后回答阅读问题。")
NO_CHANGES = "今昔变化待继续复核。"
UNIT_NO_QUESTION = "本封信的阅读问题待人工复核。"
UNIT_NO_ANSWER = "参考回答待人工复核。"
ANSWER_STEPS = ("先确认本封信的路线和核心地点。", "再读原文线索，找出场景和情绪变化。", "最后把今日景点说明放回问题中回答。")
UNIT_BASIS = "基于原书线索、地点说明、结构化导读与公开来源状态整理，待人工复核。"
UNIT_NOTICE = "公开预览 / 个人阅读增强版：本封信仍待人工复核。"


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def brief(title: Column) -> Column:
    t = T.squash(T.or_empty(title))
    return F.when(t == "", BRIEF_UNTITLED).otherwise(P.filled(BRIEF, title=t))


def letters_brief(sections: DataFrame, chunks: DataFrame, first: int = 6, last: int = 30) -> DataFrame:
    """The letters of each book: its sections numbered first to last, in order (of equal ones by section_id), with chunk ids and brief.

    sections: book, section_id, ord, title, char_count, chunk_count. chunks: book, section_id, ord, chunk_id. A section without a
    count has that of its chunks; chunks without an id count, but are not named. evidence_ids: the first three.
    """
    number = F.regexp_extract(T.or_empty("section_id"), r"^sec-([0-9]{3})\z", 1).try_cast("int")
    body = sections.where(number.between(first, last))
    named = F.array_sort(F.collect_list(F.when(T.or_empty("chunk_id") != "", F.struct("ord", "chunk_id"))))
    of = chunks.groupBy("book", "section_id").agg(F.transform(named, lambda x: x["chunk_id"]).alias("_ids"), F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy("book").orderBy("ord", "section_id"))
    j = body.withColumn("_place", place).join(of, ["book", "section_id"], "left")
    count = F.coalesce(F.when(F.col("chunk_count") != 0, F.col("chunk_count")).cast("long"), F.col("_n"), F.lit(0).cast("long"))
    return j.select(
        "book", T.numbered("letter-", F.col("_place"), 3).alias("letter_id"), "section_id", F.col("_place").cast("long").alias("ord"), T.squash(T.or_empty("title")).alias("title"),
        F.coalesce("char_count", F.lit(0)).cast("long").alias("char_count"), count.alias("chunk_count"), _strings(F.col("_ids")).alias("chunk_ids"), brief(F.col("title")).alias("brief"),
        F.concat("section_id", F.lit("-structure")).alias("ref_id"), F.slice(_strings(F.col("_ids")), 1, 3).alias("evidence_ids"), F.lit(EVIDENCE_NOTE).alias("evidence_note"), F.lit(BRIEF_STATUS).alias("review_status"),
    )


def _note(kind: Column, text: Column, places: Column, labels: dict, label: str, at_places: str, notes: dict, note: str) -> Column:
    hits = P.named_in(text, places)
    return F.when(hits.isNotNull(), P.filled(at_places, label=P.by_key(kind, labels, label), places=hits)).otherwise(P.by_key(kind, notes, note))


def excerpt_note(kind: Column, text: Column, places: Column) -> Column:
    """What an excerpt is for: by the places it names, three at most, else by its kind."""
    return _note(kind, text, places, EXCERPT_LABELS, EXCERPT_LABEL, EXCERPT_AT_PLACES, EXCERPT_NOTES, EXCERPT_NOTE)


def reading_use(kind: Column) -> Column:
    return P.by_key(kind, EXCERPT_USES, EXCERPT_USE)


def block_note(role: Column, text: Column, places: Column) -> Column:
    """What a reading block is for: by the places it names, three at most, else by its role."""
    return _note(role, text, places, BLOCK_LABELS, BLOCK_LABEL, BLOCK_AT_PLACES, BLOCK_NOTES, BLOCK_NOTE)


def scene_notes(tags: Column, places: Column, themes: Column, title: Column) -> Column:
    """Three to six notes, no two alike but fillers: of four tags, four places, three themes; of the title where there are none."""
    tagged = F.transform(F.slice(P.some(tags), 1, 4), lambda t: P.filled(SCENE_TAG, tag=t))
    more = lambda items, n, pattern, name: F.when(F.size(P.some(items)) > 0, F.array(P.filled(pattern, **{name: P.listed(F.slice(P.some(items), 1, n))}))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(tagged, more(places, 4, SCENE_PLACES, "places"), more(themes, 3, SCENE_THEMES, "themes"))
    return P.padded(F.when(F.size(notes) > 0, notes).otherwise(F.array(P.filled(SCENE_TITLE, title=title))), 3, SCENE_FILLER, 6)


def reading_steps(route: Column) -> Column:
    return F.array(P.filled(STEPS[0], route=P.first_of(route, STEPS_ROUTE)), *map(F.lit, STEPS[1:]))


def _first(core: str, whole: str) -> Column:
    return F.coalesce(F.get(core, F.lit(0)), F.get(whole, F.lit(0)))


def excerpt_answers(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """questions with source_anchor, quick_answer, deep_answer and basis, from the first excerpt of the question's letter; a question
    without a known letter is anchored in the first three chapters of all.

    questions: question_id, letter_id. chapters: letter_id, ord (unique), chapter_id, section_id, title, places, core_excerpts,
    excerpts (structs of anchor_id, kind, text, note); of one letter's chapters the last in order counts. Three rows are broadcast.
    """
    at = chapters.withColumn("_e", _first("core_excerpts", "excerpts"))
    place = F.struct("letter_id", "chapter_id", "section_id", F.col("_e.anchor_id").alias("anchor_id"), F.col("_e.kind").alias("kind"))
    three = at.orderBy("ord").limit(3).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", place.alias("a")))), lambda x: x["a"]).alias("_three"))
    quick = P.filled(EXCERPT_QUICK, text=P.preview(F.col("_e.text"), 46), title=P.first_of(F.col("title"), NO_TITLE))
    deep = P.filled(EXCERPT_DEEP, note=P.first_of(F.col("_e.note"), NO_EXCERPT_NOTE), places=P.listed(F.slice(_strings(F.col("places")), 1, 4), NO_PLACES))
    known = J.last_wins(at.where("letter_id <> ''"), "letter_id", "ord").select("letter_id", F.struct(F.array(place).alias("anchors"), quick.alias("quick"), deep.alias("deep")).alias("_c"))
    j = questions.join(known, "letter_id", "left").crossJoin(F.broadcast(three))
    hit = F.col("_c").isNotNull()
    either = lambda name, other: F.when(hit, F.col(f"_c.{name}")).otherwise(other)
    anchor = F.struct(F.when(hit, EXCERPT_ANCHOR[0]).otherwise(SAMPLE_ANCHOR[0]).alias("anchor_type"), F.when(hit, EXCERPT_ANCHOR[1]).otherwise(SAMPLE_ANCHOR[1]).alias("note"), either("anchors", F.col("_three")).alias("anchors"))
    return j.select(*[questions[c] if c != "letter_id" else F.col(c) for c in questions.columns], anchor.alias("source_anchor"),
                    either("quick", F.lit(SAMPLE_QUICK)).alias("quick_answer"), either("deep", F.lit(SAMPLE_DEEP)).alias("deep_answer"), F.lit(EXCERPT_BASIS).alias("basis"))


def block_answers(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """questions with source_anchor, quick_answer and deep_answer, from the first reading block of the question's letter, or else of
    the first chapter of all; a missing block quotes and notes nothing.

    As excerpt_answers, but chapters: letter_id, ord, chapter_id, section_id, title, core_blocks, blocks (structs of block_id,
    role, text, note).
    """
    at = chapters.withColumn("_b", _first("core_blocks", "blocks"))
    anchor = F.struct(F.lit(BLOCK_ANCHOR[0]).alias("anchor_type"), "letter_id", "chapter_id", "section_id", F.col("_b.block_id").alias("block_id"), F.col("_b.role").alias("role"), F.lit(BLOCK_ANCHOR[1]).alias("note"))
    quick = P.filled(BLOCK_QUICK, text=P.preview(F.col("_b.text"), 58), title=P.first_of(F.col("title"), NO_TITLE))
    told = F.struct(anchor.alias("source_anchor"), quick.alias("quick_answer"), P.filled(BLOCK_DEEP, note=F.col("_b.note")).alias("deep_answer"))
    known = J.last_wins(at.where("letter_id <> ''"), "letter_id", "ord").select("letter_id", told.alias("_c"))
    first = at.orderBy("ord").limit(1).agg(F.first(told).alias("_f"))
    j = questions.join(known, "letter_id", "left").crossJoin(F.broadcast(first)).withColumn("_t", F.coalesce("_c", "_f"))
    return j.select(*[questions[c] if c != "letter_id" else F.col(c) for c in questions.columns], "_t.*")


def source_clues(letter_id: Column, excerpts: Column, focus: Column, scenes: Column, route: Column, places: Column, most: int = 4) -> Column:
    """The letter's own excerpts, then clues of its focus, first scene and places while there are fewer than ``most``; none repeats
    the excerpt of one before it.

    excerpts: structs of excerpt, mode, note. route: the label, or the places where it is missing. A clue made here is cut at 180
    characters; an excerpt's number is its place among all excerpts, blank ones included.
    """
    name = F.coalesce(letter_id.cast("string"), F.lit("letter"))

    def clue(number, mode, excerpt, note, use) -> Column:
        return F.struct(F.concat(name, T.numbered("-clue-", number, 2)).alias("clue_id"), mode.alias("mode"), excerpt.alias("excerpt"), note.alias("note"), use.alias("use"))

    own = F.transform(excerpts, lambda e, i: clue(i + 1, P.first_of(e["mode"], CLUE_MODE), T.strip(T.or_empty(e["excerpt"])), P.first_of(e["note"], CLUE_NOTE), F.lit(CLUE_USE)))
    none = F.array().cast("array<struct<clue_id:string,mode:string,excerpt:string,note:string,use:string>>")
    start = F.coalesce(F.filter(own, lambda c: c["excerpt"] != ""), none)
    label = P.first_of(route, P.listed(places, UNREVIEWED))
    scene = F.when(F.size(_strings(scenes)) > 0, F.get(scenes, F.lit(0))).otherwise(P.filled(SCENE_CLUE, route=label))
    texts = (P.first_of(focus, P.filled(FOCUS_CLUE, route=label)), scene, P.filled(PLACE_CLUE, places=P.listed(F.slice(_strings(places), 1, 5), UNREVIEWED)))
    spare = F.array(*[F.struct(F.coalesce(t, F.lit("")).alias("text"), *[F.lit(x).alias(k) for k, x in zip(("mode", "note", "use"), more)]) for t, more in zip(texts, MORE_CLUES)])

    def add(acc: Column, x: Column) -> Column:
        fresh = (F.size(acc) < most) & (x["text"] != "") & ~F.exists(acc, lambda c: c["excerpt"] == x["text"])
        return F.when(fresh, F.array_append(acc, clue(F.size(acc) + 1, x["mode"], F.substring(x["text"], 1, 180), x["note"], x["use"]))).otherwise(acc)

    return F.slice(F.aggregate(spare, start, add), 1, most)


def length_hint(chars: Column, chunks: Column) -> Column:
    long, dense, short, plain = LENGTH_HINTS
    return F.when(chunks >= 6, long).when(chars >= 4500, dense).when((chars != 0) & (chars <= 2200), short).otherwise(plain)


def reading_units(chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """chapter_id, number and unit: all that a letter is read by, from its chapter and the first question that asks about it.

    chapters: chapter_id (unique), letter_id, section_id, number, letter_stamp, title, route_label, places, themes, chunk_count,
    char_count, source_summary, letter_summary, summary, focus_expanded, focus, close_reading (excerpt_focus, why_it_matters,
    then_now_prompt), original_excerpt (structs of excerpt, mode, note), scene_notes, route_now (see embedded_places), then_note,
    reading_steps, then_now, answer_hint_expanded, evidence_refs, review_notice. questions: those of joins.question_of, with
    question, close_reading_answer, answer_hint_expanded, answer_hint, answer_steps; of one id the first in order counts.
    """
    c = F.col
    fields = ("question_id", "question", "close_reading_answer", "answer_hint_expanded", "answer_hint", "answer_steps")
    asked = questions.groupBy("question_id").agg(F.min_by(F.struct(*fields), "ord").alias("_q"))
    found = J.question_of(chapters, questions).join(asked, "question_id").select("chapter_id", "_q")
    j = chapters.join(found, "chapter_id", "left")
    or_texts = lambda items, texts: F.when(F.size(_strings(items)) > 0, items).otherwise(_texts(texts))
    told = P.first_of(c("source_summary"), c("letter_summary"))
    summary = F.coalesce(told, c("summary"))
    guide = T.first_sentence(F.coalesce(P.first_of(summary), F.lit(NO_GUIDE)), 150, "。！？!?")
    focus = P.first_of(c("focus_expanded"), c("focus"))
    route = P.first_of(c("route_label"), P.listed(c("places"), UNREVIEWED))
    close, q = c("close_reading"), c("_q")
    answer = F.struct(
        q["question_id"].alias("question_id"), F.when(q.isNotNull(), q["question"]).otherwise(UNIT_NO_QUESTION).alias("question"),
        P.first_of(q["close_reading_answer"], q["answer_hint_expanded"], q["answer_hint"], c("answer_hint_expanded"), UNIT_NO_ANSWER).alias("reference_answer"),
        or_texts(q["answer_steps"], ANSWER_STEPS).alias("answer_steps"), F.lit(UNIT_BASIS).alias("basis"),
    )
    basic = F.struct(
        route.alias("route"), F.slice(_strings(c("places")), 1, 5).alias("core_places"), "chunk_count", "char_count", length_hint(c("char_count"), c("chunk_count")).alias("reading_length_hint"),
        F.coalesce(focus, F.lit(NO_FOCUS)).alias("what_to_watch"),
    )
    flow = F.struct(
        summary.alias("what_it_says"), F.coalesce(P.first_of(close["why_it_matters"], c("focus_expanded")), c("focus")).alias("why_it_matters"), or_texts(c("reading_steps"), UNIT_STEPS).alias("reading_steps"),
        P.first_of(close["then_now_prompt"], c("then_now"), NO_CHANGES).alias("changes_to_notice"),
    )
    details = F.struct(
        _strings(c("scene_notes")).alias("scene_notes"), c("then_note").alias("then_route_note"), c("then_now").alias("then_now_comparison"), _strings(c("evidence_refs")).alias("evidence_refs"),
        P.first_of(c("review_notice"), UNIT_NOTICE).alias("review_notice"),
    )
    unit = F.struct(
        c("number").alias("letter_number"), "letter_id", "section_id", P.first_of(c("letter_stamp"), NO_STAMP).alias("date_or_stamp"), F.coalesce(P.first_of(c("title")), c("route_label")).alias("route_title"),
        guide.alias("one_sentence_guide"), _strings(c("themes")).alias("themes"), basic.alias("basic_info"),
        source_clues(c("letter_id"), c("original_excerpt"), close["excerpt_focus"], c("scene_notes"), c("route_label"), c("places")).alias("source_clues"),
        flow.alias("close_reading_flow"), U.embedded_places(c("route_now"), c("places"), c("then_note")).alias("embedded_places"), answer.alias("question_answer"), details.alias("secondary_details"),
    )
    return j.select("chapter_id", "number", unit.alias("unit"))


def unit_questions(questions: DataFrame, units: DataFrame) -> DataFrame:
    """questions with letter_anchor, answer_summary and basis of the last chapter, by number and id, whose unit asks them; else nulls."""
    answer = T.first_sentence(F.col("unit.question_answer.reference_answer"), 150, "。！？!?")
    last = units.select(F.col("unit.question_answer.question_id").alias("question_id"), "number", "chapter_id", answer.alias("s")).where("question_id IS NOT NULL")
    last = last.groupBy("question_id").agg(F.max(F.struct("number", "chapter_id", "s")).alias("_u"))
    j = questions.join(last, "question_id", "left")
    return j.select(*[F.col(c) for c in questions.columns], F.col("_u.chapter_id").alias("letter_anchor"), F.col("_u.s").alias("answer_summary"), F.when(F.col("_u").isNotNull(), UNIT_BASIS).alias("unit_basis"))


def flow_summary(units: DataFrame, enough: int = 3) -> DataFrame:
    """One row: units, and how many have clues enough, places, an answer, a question. One aggregate."""
    u, n = F.col("unit"), F.count_if
    return units.agg(
        F.count(F.lit(1)).alias("letter_units"), n(F.size(u["source_clues"]) >= enough).alias("source_clue_ready"), n(F.size(u["embedded_places"]) > 0).alias("embedded_places_ready"),
        n(u["question_answer"]["reference_answer"] != "").alias("question_answer_ready"), n(u["question_answer"]["question_id"].isNotNull()).alias("with_question"),
    )
