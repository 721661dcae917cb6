"""Composites of a reading guide: review tasks, timeline and map nodes, embedded places, close readings, questions, the book's
identity, project catalogue and promotion. JVM-side expressions; a list is gathered only for one letter, block or question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import review as R
from quillspark.operators import windows as W

# Statuses, labels, questions, checks and what stands where a text is missing.
PUBLIC = "public_source"
READY = ("public_coordinate", "approximate_coordinate")
PENDING_COORDINATE = "needs_coordinate_review"
PENDING_SOURCE = "needs_source_review"
SOURCE_LABELS = ("已有公开来源", "待补充公开来源")
COORDINATE_LABELS = ("已有公开坐标", "近似坐标", "坐标待复核")
ROLE_LABELS = ("核心地点", "起点或进入地点", "抵达或收束地点", "途经或观察地点", "地点线索")
NO_TODAY = "今日景点信息待公开来源复核。"
NO_THEN = "书信中的旅行语境待复核"
NO_REVIEW = "待后续人工复核。"
NO_CONTEXT = "本封信的当年旅行语境待人工复核。"
NO_MOOD = "可按路线、场景、地点和问题四层进入本封信。"
NO_EXCERPT = "原文线索待人工复核。"
NO_NOTE = "这条线索用于进入本封信的场景和路线。"
WHY = " 它把本封信从单纯地点列表推进到具体旅行经验，适合和路线、场景、今日地点一起读。"
NO_SCENE = "场景线索待人工复核。"
NO_COMPARISON = "把书中当年的到达、移动和观看方式，与今日景点化、城市化或交通化后的读法分开比较。"
NO_QUESTION = "本封信的对应阅读问题待人工复核。"
NO_ANSWER = "这道题的参考回答仍需人工复核；可先从路线、地点和原文线索入手。"
BLOCK_QUESTIONS = (
    "Does this block represent the letter strongly enough?",
    "Does it have complete meaning without feeling cut off?",
    "Does it give useful scene, place, route, or travel detail?",
    "Is the guide note specific and helpful?",
)
CORE_QUESTION = "Should it remain a core reading block or move to the extra area?"
OTHER_QUESTION = "Should it stay in the extra area or move into the core reading flow?"
ROLE_QUESTION = "Should the reading role be recategorized during human review?"
BLOCK_CHECKS = "representative; complete meaning; no abrupt cut; length fit; guide note usefulness"
BOOK_HINT = (
    "参考回答：这本书可以看作一组按行程推进的旅行书信。读者可以先看地点从北方关隘、关中城市、"
    "西南山水、东南沿海一路展开，再看作者如何在不同景观中调整观看方式。这个回答仍是导读提示。"
)
BOOK_CLUES = ("25 封书信标题", "章节地点线索", "结构化主题")
BOOK_THEN_NOW = "全书的今日对照应按每封信的地点分别核验。"
CHAPTER_HINT = "参考回答：可先把%s作为空间顺序，再结合原书场景线索（如%s）理解这封信。今日对照应优先看已列公开来源，未列来源的地点只作待复核提示。"
NOW_CONTEXT = "本节点包含 %d 个已补公开来源地点、%d 个待补来源地点。"
UNKNOWN_HINT = "参考回答：先从对应章节标题、地点线索和主题标签入手；具体解释待人工复核。"
UNKNOWN_THEN_NOW = "今日对照待补充。"
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
RESULTS = ("", "pass", "needs_fix", "blocked", "deferred")


def either(*cols: Column) -> Column:
    """The first value that is neither null nor empty; white space is a value."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def cut_text(value: Column, fallback: str, limit: int) -> Column:
    """The text without outer white space, else the fallback; beyond the limit, an ellipsis ends it."""
    t = F.coalesce(F.when(T.strip(value) != "", T.strip(value)), F.lit(fallback))
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), f"{T.WS}+$", ""), F.lit("…"))).otherwise(t)


def linked_ids(questions: DataFrame, key: str, order: str = "question_id") -> DataFrame:
    """key -> ids: the questions of each block or letter in their order. Rows without key or id link nothing."""
    there = questions.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & (F.coalesce("question_id", F.lit("")) != ""))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("question_id").alias("q"))))
    return there.groupBy(key).agg(F.transform(listed, lambda x: x["q"]).alias("ids"))


def review_tasks(blocks: DataFrame, questions: DataFrame, same: tuple[str, ...] = ("letter_id", "block_id"), prefix: str = "block-", short: int = 90, long: int = 280) -> DataFrame:
    """One task for each block of a letter; of blocks alike in ``same`` the first stays, under its own index.

    blocks: letter_id, block_index, block_id, block_text, reading_role, core, extra; other columns are carried. Null flags are
    false, null texts empty. questions: question_id, block_id.
    """
    first = W.first_rows(blocks, list(same), ["block_index"], 1, F.col("block_index"))
    j = first.join(linked_ids(questions, "block_id"), "block_id", "left")
    text, role = F.coalesce("block_text", F.lit("")), F.coalesce("reading_role", F.lit(""))
    core, extra = F.coalesce("core", F.lit(False)), F.coalesce("extra", F.lit(False))
    asked = [*BLOCK_QUESTIONS]
    questions_of = F.concat_ws(" ", *map(F.lit, asked), F.when(core, CORE_QUESTION).otherwise(OTHER_QUESTION), F.when(role.isin("other", ""), ROLE_QUESTION))
    checks = F.concat_ws("; ", F.lit(BLOCK_CHECKS), F.when(F.length(text) < short, "possibly short"), F.when(F.length(text) > long, "possibly long"), F.when(core, "core placement fit").otherwise("possible core upgrade"))
    task = F.concat(F.lit(prefix), F.col("letter_id").cast("string"), T.numbered("-", F.col("block_index"), 3))
    tasks = j.select(
        task.alias("block_task_id"), *[c for c in blocks.columns if c not in ("core", "extra", "block_text", "reading_role")], text.alias("block_text"), role.alias("reading_role"),
        F.when(core, "core").when(extra, "extra").otherwise("source").alias("current_placement"), F.length(text).cast("long").alias("block_length"),
        F.coalesce(F.array_join("ids", ";"), F.lit("")).alias("linked_question_id"), R.priority(core, F.col("block_index") == 1, F.col("ids").isNotNull()).alias("review_priority"),
        questions_of.alias("review_question"), checks.alias("suggested_checks"),
    )
    return tasks.select("*", *[F.lit("").alias(c) for c in ("review_result", "replacement_strategy", "review_notes", "reviewer", "reviewed_at")])


def timeline_nodes(chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """The node of each letter: places, how many of them have a public source, the letter's questions.

    chapters: letter_id, title, route_label, places (strings), route_now (structs with source_status), then_note, summary, focus.
    """
    public = F.size(F.filter(F.coalesce("route_now", F.array()), lambda p: F.coalesce(p["source_status"] == PUBLIC, F.lit(False)))).cast("long")
    n = F.size(F.coalesce("route_now", F.array())).cast("long")
    places = F.coalesce("places", F.array().cast("array<string>"))
    j = chapters.join(linked_ids(questions, "letter_id"), "letter_id", "left").withColumn("_public", public).withColumn("_pending", n - F.col("_public"))
    return j.select(
        "letter_id", "title", F.coalesce(either(F.col("route_label")), F.array_join(places, "、")).alias("route_label"), places.alias("primary_places"),
        F.coalesce(either(F.col("then_note")), cut_text(F.col("summary"), NO_CONTEXT, 180)).alias("then_context"),
        F.format_string(NOW_CONTEXT, "_public", "_pending").alias("now_context"),
        cut_text(F.col("focus"), NO_MOOD, 160).alias("reading_mood"), F.col("_public").alias("public_source_count"), F.col("_pending").alias("needs_source_review_count"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("linked_question_ids"),
    )


def coordinate_stats(places: DataFrame) -> DataFrame:
    """One row: places by coordinate_status, and the source types of those with a coordinate, as sorted JSON.

    Types are few; the rows of one type are counted before the types meet.
    """
    status = F.coalesce(either(F.col("coordinate_status")), F.lit(PENDING_COORDINATE))
    n = lambda s: F.count_if(F.col("s") == s)
    by_type = places.select(status.alias("s"), F.coalesce(either(F.col("coordinate_source_type")), F.lit("unknown")).alias("t")).groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), n(READY[0]).alias("p"), n(READY[1]).alias("a"), n(PENDING_COORDINATE).alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    types = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("p") + F.col("a") > 0, F.struct("t", (F.col("p") + F.col("a")).alias("n"))))))
    return by_type.agg(total("n").alias("total_place_count"), total("p").alias("public_coordinate_count"), total("a").alias("approximate_coordinate_count"), total("r").alias("needs_coordinate_review_count"),
                       total(F.col("p") + F.col("a")).alias("coordinate_ready_count"), F.to_json(types).alias("coordinate_source_type_counts"))


def map_nodes(places: DataFrame, order: list, buckets: list[Column]) -> DataFrame:
    """The places numbered from 1 in their order (see windows.numbered_rows for buckets)."""
    return W.numbered_rows(places, "node", order, buckets)


def ready_by_letter(stops: DataFrame, places: DataFrame) -> DataFrame:
    """letter_id, coordinate_ready_count, needs_coordinate_review_count. stops: letter_id, place_name, repeats counted, a null name
    for a letter without places; places: place_name, place_order, coordinate_status, of one name the last standing."""
    last = places.groupBy("place_name").agg(F.max_by(F.struct("coordinate_status"), "place_order").alias("_p"))
    j = stops.join(last, "place_name", "left")
    ready = F.count_if(F.col("_p.coordinate_status").isin(*READY))
    return j.groupBy("letter_id").agg(ready.alias("coordinate_ready_count"), (F.count("place_name") - ready).alias("needs_coordinate_review_count"))


def _embedded(name, role, then, today, source_status, source_name, coordinate_status, note) -> Column:
    public, near = F.coalesce(coordinate_status == READY[0], F.lit(False)), F.coalesce(coordinate_status == READY[1], F.lit(False))
    return F.struct(
        name.alias("place_name"), role.alias("role"), then.alias("then_perspective"), today.alias("today_perspective"), F.coalesce(source_status, F.lit(PENDING_SOURCE)).alias("source_status"),
        F.when(F.coalesce(source_status == PUBLIC, F.lit(False)), SOURCE_LABELS[0]).otherwise(SOURCE_LABELS[1]).alias("source_label"), source_name.alias("source_name"),
        F.coalesce(coordinate_status, F.lit(PENDING_COORDINATE)).alias("coordinate_status"), F.when(public, COORDINATE_LABELS[0]).when(near, COORDINATE_LABELS[1]).otherwise(COORDINATE_LABELS[2]).alias("coordinate_label"),
        note.alias("review_note"),
    )


def embedded_places(route_now: Column, places: Column, then_note: Column, most: int = 5, spare: int = 3) -> Column:
    """The first places of a letter's route with role, perspectives and labels; without a route, its first chapter places.

    route_now: structs of place_name, then_context (strings), now_context, source_status, source_name, coordinate_status, review_note.
    A name's role is that of its last place in the whole route.
    """
    empty = F.lit(None).cast("string")
    n = F.size(route_now)
    names = F.transform(route_now, lambda p: p["place_name"])

    def role(name: Column) -> Column:
        last = n - F.array_position(F.reverse(names), name) + 1
        return F.when(n == 1, ROLE_LABELS[0]).when(last == 1, ROLE_LABELS[1]).when(last == n, ROLE_LABELS[2]).otherwise(ROLE_LABELS[3])

    def stop(p: Column) -> Column:
        told = F.array_join(F.filter(F.coalesce(p["then_context"], F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))), "、")
        then = F.coalesce(either(told, then_note), F.lit(NO_THEN))
        return _embedded(p["place_name"], role(p["place_name"]), then, F.coalesce(either(p["now_context"]), F.lit(NO_TODAY)), either(p["source_status"]), p["source_name"], either(p["coordinate_status"]), F.coalesce(either(p["review_note"]), F.lit(NO_REVIEW)))

    def bare(name: Column) -> Column:
        return _embedded(name, F.lit(ROLE_LABELS[4]), F.coalesce(either(then_note), F.lit(NO_THEN + "。")), F.lit(NO_TODAY), empty, empty, empty, F.lit(NO_REVIEW))

    return F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.slice(route_now, 1, most), stop)).otherwise(F.transform(F.slice(F.coalesce(places, F.array().cast("array<string>")), 1, spare), bare))


def close_readings(chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """What to read closely in each letter, with its first question.

    chapters: letter_id, excerpt, excerpt_note, summary, scenes, places, comparison; questions: letter_id, question_order,
    question_id, question, answer (of a letter's questions the first by order and id is used).
    """
    first = questions.groupBy("letter_id").agg(F.min_by(F.struct("question", "answer"), F.struct("question_order", "question_id")).alias("_q"))
    j = chapters.join(first, "letter_id", "left")
    note = F.coalesce(either(F.col("excerpt_note")), F.lit(NO_NOTE))
    scenes = F.slice(F.coalesce("scenes", F.array().cast("array<string>")), 1, 5)
    return j.select(
        "letter_id", cut_text(either(F.col("excerpt"), F.col("summary")), NO_EXCERPT, 220).alias("excerpt_focus"), cut_text(F.concat(note, F.lit(WHY)), "", 260).alias("why_it_matters"),
        F.when(F.size(scenes) > 0, scenes).otherwise(F.array(F.lit(NO_SCENE))).alias("scene_to_notice"), F.coalesce("places", F.array().cast("array<string>")).alias("place_to_notice"),
        cut_text(F.col("comparison"), NO_COMPARISON, 260).alias("then_now_prompt"), F.coalesce(either(F.col("_q.question")), F.lit(NO_QUESTION)).alias("question_bridge"), cut_text(F.col("_q.answer"), NO_ANSWER, 260).alias("answer_bridge"),
    )


def enriched_questions(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Adds answer_hint, source_clues, place_clues and then_now_hint: of the book, of the question's chapter, or what stands for an unknown one.

    questions: scope, section_id; chapters: section_id (unique), route_label, scenes, places, comparison. Names of questions win.
    """
    about = F.struct(F.coalesce("scenes", F.array().cast("array<string>")).alias("scenes"), F.coalesce("places", F.array().cast("array<string>")).alias("places"), F.coalesce(either(F.col("route_label")), F.lit(ROLE_LABELS[4])).alias("route"), F.col("comparison").alias("comparison"))
    j = questions.join(chapters.select("section_id", about.alias("_c")), "section_id", "left")
    book, known, none = F.coalesce(F.col("scope") == "book", F.lit(False)), F.col("_c").isNotNull(), F.array().cast("array<string>")
    hint = F.format_string(CHAPTER_HINT, F.col("_c.route"), F.array_join(F.slice("_c.scenes", 1, 2), "；"))
    return j.select(
        *[F.col(c) for c in questions.columns], F.when(book, BOOK_HINT).when(known, hint).otherwise(UNKNOWN_HINT).alias("answer_hint"),
        F.when(book, F.array(*map(F.lit, BOOK_CLUES))).when(known, F.slice("_c.scenes", 1, 3)).otherwise(none).alias("source_clues"), F.when(book | ~known, none).otherwise(F.col("_c.places")).alias("place_clues"),
        F.when(book, BOOK_THEN_NOW).when(known, F.col("_c.comparison")).otherwise(UNKNOWN_THEN_NOW).alias("then_now_hint"),
    )


def with_envelope(payload: DataFrame, book: DataFrame, **constants: str) -> DataFrame:
    """Every row of the payload with constant columns and the one row of book as a struct; an empty book gives null."""
    one = book.agg(F.first(F.struct(*book.columns)).alias("book"))  # an aggregate without keys has one row
    return payload.crossJoin(F.broadcast(one)).select(*[F.lit(v).alias(k) for k, v in constants.items()], "book", *[payload[c] for c in payload.columns])


def _first_broken(rules: list[tuple[str, Column]], order: str) -> Column:
    """The problem of the first row, by order, that breaks a rule; within a row the first rule."""
    problem = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        problem = F.when(broken, name).otherwise(problem)
    return F.min_by(problem, F.when(problem.isNotNull(), F.col(order)))


def task_blockers(tasks: DataFrame, order: str, promised: Column) -> DataFrame:
    """One row: total, blank, and blockers, what of the manual review stands against a promotion, in the rules' order.

    tasks: priority, result, notes. promised: the summary's total. Of the rules on P2 and on results only the first broken
    row's is named. One aggregate, whatever the number of tasks.
    """
    r = T.strip(F.coalesce("result", F.lit("")))
    urgent, p2 = F.coalesce(F.col("priority").isin("P0", "P1"), F.lit(False)), F.coalesce(F.col("priority") == "P2", F.lit(False))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    later = [("p2_not_pass_or_deferred", p2 & ~r.isin("pass", "deferred")), ("p2_deferred_without_notes", p2 & (r == "deferred") & (T.strip(F.coalesce("notes", F.lit(""))) == ""))]
    state = [("illegal_manual_result", ~r.isin(*RESULTS)), ("manual_review_needs_fix", r == "needs_fix"), ("manual_review_blocked", r == "blocked")]
    total = F.count(F.lit(1))
    found = F.array(
        F.when(~total.eqNullSafe(promised), "manual_review_summary_mismatch"), F.when(some(urgent & (r == "")), "manual_review_incomplete"), F.when(some(urgent & (r != "pass")), "p0_p1_not_all_pass"),
        _first_broken(later, order), _first_broken(state, order),
    )
    return tasks.agg(total.alias("total"), F.count_if(r == "").alias("blank"), F.array_compact(found).alias("blockers"))


def file_blockers(public: DataFrame, mirror: DataFrame, schema: str, status: str = "draft") -> DataFrame:
    """name, blocker: what of the public files and their mirror stands against a promotion. Both: name, schema_version, status, body."""
    m = mirror.select("name", F.struct("schema_version", "status", "body").alias("_m"))
    j = public.join(m, "name", "left")
    there = F.col("_m").isNotNull()
    same = there & F.struct("schema_version", "status", "body").eqNullSafe(F.col("_m"))
    named = lambda broken, what: F.when(broken, F.concat(F.lit(what + ":"), F.col("name")))
    found = F.array(
        named(~there, "missing_web_mirror_file"), named(there & ~F.col("schema_version").eqNullSafe(F.lit(schema)), "schema_version_mismatch"), named(there & ~F.col("status").eqNullSafe(F.lit(status)), "public_status_not_draft"),
        named(there & ~same, "web_mirror_mismatch"), named(there & ~F.col("_m.status").eqNullSafe(F.lit(status)), "web_status_not_draft"),
    )
    return j.select("name", F.explode(F.array_compact(found)).alias("blocker"))


def promoted(payloads: DataFrame, ready: bool, phrase: str, wanted: str, status: str) -> DataFrame:
    """The payloads with the new status, as a new table; unchanged unless all is ready and the phrase is the exact one."""
    return payloads.withColumn("status", F.lit(status)) if ready and phrase == wanted else payloads


def added_projects(index: DataFrame, new: DataFrame) -> DataFrame:
    """index and the new projects that may join it, plus refused (null, "invalid slug" or "slug exists") for the rest.

    Both: slug and further columns of index. Of new rows with one slug, none but the least by their columns joins.
    """
    known = index.select("slug", F.lit(True).alias("_known")).distinct()
    same = new.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(*[c for c in index.columns if c != "slug"]))).alias("_rows")).join(known, "slug", "left")
    rows = same.select("slug", "_known", F.posexplode("_rows").alias("_i", "_r"))
    refused = F.when(~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False)), "invalid slug").when(F.col("_known") | (F.col("_i") > 0), "slug exists")
    return index.withColumn("refused", F.lit(None).cast("string")).unionByName(rows.select("slug", "_r.*", refused.alias("refused")))


def inspected(files: DataFrame, needed: tuple[str, ...], wished: tuple[str, ...]) -> DataFrame:
    """A row for each project: files present, missing next ones, intake_ready (every needed kind is there and no file has a finding) and what to do next.

    files: project, kind, present, finding (null: none).
    """
    there = F.coalesce("present", F.lit(False))
    has = lambda k: F.coalesce(F.bool_or((F.col("kind") == k) & there), F.lit(False))
    clean = F.count("finding") == 0
    ready = clean
    for k in needed:
        ready = ready & has(k)
    missing = F.array_compact(F.array(*[F.when(~has(k), k) for k in wished]))
    g = files.groupBy("project").agg(F.count_if(there).alias("files_present"), missing.alias("missing_next"), clean.alias("privacy_ok"), ready.alias("intake_ready"))
    steps = F.array_compact(F.array(F.when(F.size("missing_next") > 0, "implement the missing next stages"), F.when(F.col("intake_ready"), "build the briefs").otherwise("complete the intake")))
    return g.withColumn("next_actions", steps)
