"""Texts of letters and the units they are read by, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import letters as L
from quillspark.plans.guide_queries import _LETTERS, letters
from quillspark.plans.registry import query, table
from quillspark.plans.text_queries import numbered_sql, squash_sql


def filled_sql(pattern: str, **slots: str) -> str:
    out = "'" + pattern + "'"
    for name, value in slots.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


def case_sql(key: str, texts: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + f" ELSE '{default}' END"


def list_sql(texts) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


# briefs: a document is a section of a book of 40, a conversation's turns are chunks

@query("g27_letters_brief", f"""WITH s AS (SELECT doc_id // 40 AS book, 'sec-' || lpad(CAST(doc_id % 40 AS VARCHAR), 3, '0') AS section_id, doc_id * 7 % 40 AS ord, CASE WHEN lang = 'de' THEN ' ' ELSE {squash_sql("substr(text, 1, 20)")} END AS title, n_chars, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS cc, doc_id % 40 AS no FROM documents),
  c AS (SELECT conv_id // 40 AS book, 'sec-' || lpad(CAST(conv_id % 40 AS VARCHAR), 3, '0') AS section_id, count(*) AS n, coalesce(list(conv_id || '-' || turn ORDER BY turn) FILTER (role <> 'system'), []) AS ids FROM conversations GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ord, section_id) AS i FROM s WHERE no BETWEEN 6 AND 30)
  SELECT book, {numbered_sql('letter-', 'i', 3)} AS letter_id, section_id, i AS ord, trim(title) AS title, n_chars AS char_count, CASE WHEN cc <> 0 THEN cc ELSE coalesce(n, 0) END AS chunk_count, coalesce(array_to_string(ids, '|'), '') AS chunk_ids,
    CASE WHEN trim(title) = '' THEN '{L.BRIEF_UNTITLED}' ELSE {filled_sql(L.BRIEF, title="title")} END AS brief, section_id || '-structure' AS ref_id, coalesce(array_to_string(ids[1:3], '|'), '') AS evidence_ids, '{L.EVIDENCE_NOTE}' AS evidence_note, 'auto_structural_draft' AS review_status
  FROM b LEFT JOIN c USING (book, section_id)""")
def g27_briefs(spark, d):
    name = lambda k: F.concat(F.lit("sec-"), F.lpad((k % 40).cast("string"), 3, "0"))
    book = lambda k: F.floor(k / 40)
    k, v = F.col("doc_id"), F.col("conv_id")
    sections = table(spark, d, "documents").select(book(k).alias("book"), name(k).alias("section_id"), (k * 7 % 40).alias("ord"), F.when(F.col("lang") == "de", " ").otherwise(F.substring("text", 1, 20)).alias("title"), F.col("n_chars").alias("char_count"), F.when(k % 3 != 0, k).otherwise(0).alias("chunk_count"))
    chunks = table(spark, d, "conversations").select(book(v).alias("book"), name(v).alias("section_id"), F.col("turn").alias("ord"), F.when(F.col("role") != "system", F.concat_ws("-", v.cast("string"), F.col("turn").cast("string"))).otherwise("").alias("chunk_id"))
    return L.letters_brief(sections, chunks).withColumns({c: F.array_join(c, "|") for c in ("chunk_ids", "evidence_ids")})


# notes: every turn is an excerpt and a block of a kind

_KINDS = ("opening_scene", "route_movement", "travel_observation", "reflection", "closing_moment", "place_description", "turning_point", "other")
_NAMES = ("Thtion", "Überdie", "eau", "stinst", "ouer", "erth")
_HITS = f"array_to_string(list_filter({list_sql(_NAMES)}, lambda p: contains(text, p))[1:3], '、')"


@query("g27_notes", f"""WITH t AS (SELECT conv_id, turn::BIGINT AS turn, {list_sql(_KINDS)}[turn % 8 + 1] AS kind, coalesce(text, '') AS text FROM conversations), h AS (SELECT *, {_HITS} AS hits FROM t)
  SELECT conv_id, turn, CASE WHEN hits <> '' THEN {filled_sql(L.EXCERPT_AT_PLACES, label=case_sql('kind', L.EXCERPT_LABELS, L.EXCERPT_LABEL), places='hits')} ELSE {case_sql('kind', L.EXCERPT_NOTES, L.EXCERPT_NOTE)} END AS excerpt_note, {case_sql('kind', L.EXCERPT_USES, L.EXCERPT_USE)} AS reading_use,
    CASE WHEN hits <> '' THEN {filled_sql(L.BLOCK_AT_PLACES, label=case_sql('kind', L.BLOCK_LABELS, L.BLOCK_LABEL), places='hits')} ELSE {case_sql('kind', L.BLOCK_NOTES, L.BLOCK_NOTE)} END AS block_note FROM h""")
def g27_notes(spark, d):
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("turn") % 8).cast("int"))
    names = F.array(F.lit(""), *map(F.lit, _NAMES), F.lit(None).cast("string"))
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), kind.alias("kind"), "text")
    of = (F.col("kind"), F.col("text"), names)
    return turns.select("conv_id", "turn", L.excerpt_note(*of).alias("excerpt_note"), L.reading_use(F.col("kind")).alias("reading_use"), L.block_note(*of).alias("block_note"))


_TAGS, _THEMES = ("the", "und", "que", "für", "eau"), ("tion", "keit", "ment", "ing")
_FOUND = lambda words: f"list_filter({list_sql(words)}, lambda w: contains(text, w))"


@query("g27_scene_notes", f"""WITH f AS (SELECT doc_id, source, {_FOUND(_TAGS)} AS tags, {_FOUND(_NAMES)} AS places, {_FOUND(_THEMES)} AS themes FROM documents),
  n AS (SELECT doc_id, source, list_concat(list_transform(tags[1:4], lambda x: {filled_sql(L.SCENE_TAG, tag='x')}), list_concat(CASE WHEN len(places) > 0 THEN [{filled_sql(L.SCENE_PLACES, places="array_to_string(places[1:4], '、')")}] ELSE [] END,
    CASE WHEN len(themes) > 0 THEN [{filled_sql(L.SCENE_THEMES, themes="array_to_string(themes[1:3], '、')")}] ELSE [] END)) AS ns FROM f),
  m AS (SELECT doc_id, CASE WHEN len(ns) > 0 THEN ns ELSE [{filled_sql(L.SCENE_TITLE, title='source')}] END AS ns FROM n)
  SELECT doc_id, array_to_string(list_concat(ns, CASE len(ns) WHEN 1 THEN {list_sql([L.SCENE_FILLER] * 2)} WHEN 2 THEN {list_sql([L.SCENE_FILLER])} ELSE [] END), '|') AS notes FROM m""")
def g27_scene_notes(spark, d):
    found = lambda words: T.labels_by_keywords(F.col("text"), {w: (w,) for w in words})
    return table(spark, d, "documents").select("doc_id", F.array_join(L.scene_notes(found(_TAGS), found(_NAMES), found(_THEMES), F.col("source")), "|").alias("notes"))


# answers: a customer is a chapter, some of them without letter or excerpt; orders ask about them

_CHAPTERS = """ch AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN 'c' || c_custkey % 1000 ELSE '' END AS letter_id, c_custkey AS ord, 'ch-' || c_custkey AS chapter_id, CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS title, CASE WHEN c_nationkey > 9 THEN [c_mktsegment, 'x', 'y', 'z', 'w'] ELSE [] END AS places,
    CASE WHEN c_acctbal > 6000 THEN 'core' WHEN c_acctbal > 0 THEN 'all' END AS has, repeat(c_name, CAST(c_custkey % 5 AS INTEGER)) AS body, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS note FROM customer),
  k AS (SELECT * FROM ch WHERE letter_id <> '' QUALIFY row_number() OVER (PARTITION BY letter_id ORDER BY ord DESC) = 1),
  q AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'c' || o_custkey % 1000 END AS letter_id FROM orders)"""


def _chapters(spark, d, first: str, second: str):
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    part = F.struct(F.concat(F.lit("a-"), k.cast("string")).alias(first), F.lit("reflection").alias(second), F.repeat("c_name", (k % 5).cast("int")).alias("text"), F.when(k % 2 == 0, F.col("c_name")).alias("note"))
    nothing = F.slice(F.array(part), 1, 0)
    rich, some = F.col("c_acctbal") > 6000, F.col("c_acctbal") > 0
    return table(spark, d, "customer").select(
        F.when(k % 5 > 0, F.concat(F.lit("c"), (k % 1000).cast("string"))).otherwise("").alias("letter_id"), k.alias("ord"), F.concat(F.lit("ch-"), k.cast("string")).alias("chapter_id"), F.lit("s").alias("section_id"), F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("title"),
        F.when(F.col("c_nationkey") > 9, F.array(F.col("c_mktsegment"), *map(F.lit, "xyzw"))).otherwise(none).alias("places"), F.when(rich, F.array(part, F.struct(*[F.lit("other").alias(c) for c in (first, second, "text", "note")]))).alias("core"), F.when(some & ~rich, F.array(part)).otherwise(nothing).alias("whole"),
    )


def _order_questions(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("c"), (F.col("o_custkey") % 1000).cast("string"))).alias("letter_id"))


def _preview_sql(n: int) -> str:
    return f"CASE WHEN has IS NULL THEN '' ELSE substr(body, 1, {n}) || CASE WHEN length(body) > {n} THEN '...' ELSE '' END END"


@query("g27_excerpt_answers", f"""WITH {_CHAPTERS}, t AS (SELECT array_to_string(list(coalesce(chapter_id, '') || CASE WHEN has IS NULL THEN '' ELSE ':a-' || ord END ORDER BY ord), '|') AS three FROM (FROM ch ORDER BY ord LIMIT 3))
  SELECT o_orderkey, q.letter_id, CASE WHEN chapter_id IS NULL THEN '{L.SAMPLE_ANCHOR[0]}' ELSE '{L.EXCERPT_ANCHOR[0]}' END AS anchor_type, CASE WHEN chapter_id IS NULL THEN three WHEN has IS NULL THEN chapter_id ELSE chapter_id || ':a-' || ord END AS anchors,
    CASE WHEN chapter_id IS NULL THEN '{L.SAMPLE_QUICK}' ELSE {filled_sql(L.EXCERPT_QUICK, text=_preview_sql(46), title=f"coalesce(title, '{L.NO_TITLE}')")} END AS quick_answer,
    CASE WHEN chapter_id IS NULL THEN '{L.SAMPLE_DEEP}' ELSE {filled_sql(L.EXCERPT_DEEP, note=f"CASE WHEN has IS NULL OR note IS NULL THEN '{L.NO_EXCERPT_NOTE}' ELSE note END", places=f"CASE WHEN len(places) = 0 THEN '{L.NO_PLACES}' ELSE array_to_string(places[1:4], '、') END")} END AS deep_answer,
    '{L.EXCERPT_BASIS}' AS basis FROM q LEFT JOIN k ON q.letter_id = k.letter_id CROSS JOIN t""")
def g27_excerpt_answers(spark, d):
    chapters = _chapters(spark, d, "anchor_id", "kind").withColumnsRenamed({"core": "core_excerpts", "whole": "excerpts"})
    a = L.excerpt_answers(_order_questions(spark, d), chapters)
    anchors = F.array_join(F.transform("source_anchor.anchors", lambda x: F.concat_ws(":", x["chapter_id"], x["anchor_id"])), "|")
    return a.select("o_orderkey", "letter_id", "source_anchor.anchor_type", anchors.alias("anchors"), "quick_answer", "deep_answer", "basis")


@query("g27_block_answers", f"""WITH {_CHAPTERS}, f AS (FROM ch ORDER BY ord LIMIT 1), j AS (SELECT o_orderkey, q.letter_id AS asked, k.* FROM q JOIN k ON q.letter_id = k.letter_id UNION ALL SELECT o_orderkey, q.letter_id, f.* FROM q ANTI JOIN k ON q.letter_id = k.letter_id CROSS JOIN f)
  SELECT o_orderkey, asked AS letter_id, letter_id AS anchor_letter, CASE WHEN has IS NOT NULL THEN 'a-' || ord END AS block_id, {filled_sql(L.BLOCK_QUICK, text=_preview_sql(58), title=f"coalesce(title, '{L.NO_TITLE}')")} AS quick_answer,
    {filled_sql(L.BLOCK_DEEP, note="CASE WHEN has IS NULL THEN '' ELSE coalesce(note, '') END")} AS deep_answer FROM j""")
def g27_block_answers(spark, d):
    chapters = _chapters(spark, d, "block_id", "role").withColumnsRenamed({"core": "core_blocks", "whole": "blocks"})
    a = L.block_answers(_order_questions(spark, d), chapters)
    return a.select("o_orderkey", "letter_id", F.col("source_anchor.letter_id").alias("anchor_letter"), "source_anchor.block_id", "quick_answer", "deep_answer")


# reading units: an order is a chapter, its stops are the places; customers ask, by letter, by link or by the number in their id

_UNIT_CHAPTERS = f"""{_LETTERS}, c AS (SELECT letter_id AS k, 'L' || letter_id AS letter_id, letter_id % 1000 AS number, n, prio, route, places, CASE WHEN n = 3 THEN places[1] WHEN n = 6 THEN repeat('f', 200) END AS focus, CASE WHEN n > 4 THEN 'R' || n WHEN n = 1 THEN '' END AS label,
    CASE n % 3 WHEN 0 THEN [prio] WHEN 1 THEN [] ELSE [''] END AS scenes, CASE WHEN n = 2 THEN prio || '。 more' WHEN n = 4 THEN 'a ' || prio || '? b' END AS told, CASE WHEN n % 2 = 0 THEN [{{'e': '', 'i': 1}}, {{'e': places[1], 'i': 2}}, {{'e': prio, 'i': 3}}] ELSE [] END AS own FROM l)"""
_UNIT_QUESTIONS = """q AS (SELECT 'q' || c_custkey AS question_id, CASE WHEN c_custkey % 2 = 0 THEN 'L' || (c_custkey * 3) END AS letter_id, CASE WHEN c_custkey % 3 = 0 THEN 'L' || (c_custkey * 5) END AS linked, c_custkey AS ord, c_mktsegment AS question,
    CASE WHEN c_acctbal > 5000 THEN c_name || '！ and more' WHEN c_acctbal > 0 THEN '' END AS close, CASE WHEN c_nationkey > 12 THEN 'hint' END AS hint FROM customer),
  own AS (SELECT letter_id, question_id, ord FROM q UNION ALL SELECT linked, question_id, ord FROM q WHERE linked IS NOT NULL), fo AS (SELECT letter_id, arg_min(question_id, ord) AS own FROM own WHERE letter_id IS NOT NULL GROUP BY 1),
  nu AS (SELECT e, arg_min(question_id, ord) AS numbered FROM (SELECT DISTINCT lpad(CAST(number AS VARCHAR), 3, '0') AS e FROM c) JOIN q ON right(question_id, 3) = e GROUP BY 1),
  a AS (SELECT c.*, coalesce(fo.own, numbered) AS asked FROM c LEFT JOIN fo ON c.letter_id = fo.letter_id LEFT JOIN nu ON lpad(CAST(number AS VARCHAR), 3, '0') = e),
  j AS (SELECT a.*, q.question_id, q.question, q.close, q.hint, CASE WHEN label <> '' THEN label WHEN len(places) > 0 THEN array_to_string(places, '、') ELSE '待人工复核' END AS way FROM a LEFT JOIN q ON asked = question_id)"""
_CLUES = f"""list_reduce(list_prepend({{'n': 0, 'id': 0, 'mode': '', 'e': '', 'xs': list_transform(list_filter(own, lambda o: o.e <> ''), lambda o: {{'id': o.i, 'mode': '{L.CLUE_MODE}', 'e': o.e}})}},
    list_transform([['{L.MORE_CLUES[0][0]}', CASE WHEN focus <> '' THEN focus ELSE {filled_sql(L.FOCUS_CLUE, route='way')} END], ['{L.MORE_CLUES[1][0]}', CASE WHEN len(scenes) > 0 THEN scenes[1] ELSE {filled_sql(L.SCENE_CLUE, route='way')} END], ['{L.MORE_CLUES[2][0]}', {filled_sql(L.PLACE_CLUE, places="array_to_string(places[1:5], '、')")}]],
      lambda x: {{'n': 0, 'id': 0, 'mode': x[1], 'e': x[2], 'xs': list_transform(own[1:0], lambda o: {{'id': o.i, 'mode': '', 'e': o.e}})}})),
    lambda s, x: {{'n': 0, 'id': 0, 'mode': '', 'e': '', 'xs': CASE WHEN len(s.xs) < 4 AND x.e <> '' AND NOT list_contains(list_transform(s.xs, lambda y: y.e), x.e) THEN list_append(s.xs, {{'id': CAST(len(s.xs) + 1 AS INTEGER), 'mode': x.mode, 'e': substr(x.e, 1, 180)}}) ELSE s.xs END}}).xs[1:4]"""
_REFERENCE = f"CASE WHEN close <> '' THEN close WHEN hint <> '' THEN hint WHEN n = 2 THEN 'own' ELSE '{L.UNIT_NO_ANSWER}' END"


def unit_chapters(spark, d):
    n, k, prio, first = F.col("stops"), F.col("letter_id"), F.col("title"), F.get("places", F.lit(0))
    none = F.lit(None).cast("string")
    excerpt = lambda e, m, note: F.struct(e.alias("excerpt"), m.alias("mode"), note.alias("note"))
    own = F.array(excerpt(F.lit(" "), none, none), excerpt(first, F.lit(""), none), excerpt(prio, none, F.lit("")))
    return letters(spark, d).select(
        F.concat(F.lit("ch-"), k.cast("string")).alias("chapter_id"), F.concat(F.lit("L"), k.cast("string")).alias("letter_id"), F.lit("s").alias("section_id"), (k % 1000).cast("int").alias("number"), F.when(n == 1, "stamp").alias("letter_stamp"), F.when(n != 7, prio).otherwise("").alias("title"),
        F.when(n > 4, F.concat(F.lit("R"), n.cast("string"))).when(n == 1, "").alias("route_label"), "places", F.array(prio).alias("themes"), n.alias("chunk_count"), (n * 1200).alias("char_count"), F.when(n == 2, F.concat(prio, F.lit("。 more"))).alias("source_summary"),
        F.when(n == 4, F.concat(F.lit("a "), prio, F.lit("? b"))).alias("letter_summary"), F.when(n == 5, " ").alias("summary"), F.when(n == 5, "watch").alias("focus_expanded"), F.when(n == 4, "").when(n == 3, "plain").alias("focus"),
        F.struct(F.when(n == 3, first).when(n == 6, F.repeat(F.lit("f"), F.lit(200))).alias("excerpt_focus"), F.when(n == 1, "why").alias("why_it_matters"), F.when(n == 7, "changes").alias("then_now_prompt")).alias("close_reading"),
        F.when(n % 2 == 0, own).alias("original_excerpt"), F.when(n % 3 == 0, F.array(prio)).when(n % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit(""))).alias("scene_notes"), "route_now", none.alias("then_note"),
        F.when(n == 2, F.array(F.lit("step"))).alias("reading_steps"), F.when(n == 6, "then").alias("then_now"), F.when(n == 2, "own").alias("answer_hint_expanded"), F.array(F.lit("r")).alias("evidence_refs"), F.when(n == 3, "seen").alias("review_notice"),
    )


def unit_questions(spark, d):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    of = lambda x: F.concat(F.lit("L"), x.cast("string"))
    return table(spark, d, "customer").select(
        F.concat(F.lit("q"), k.cast("string")).alias("question_id"), F.when(k % 2 == 0, of(k * 3)).alias("letter_id"), F.when(k % 3 == 0, F.array(of(k * 5))).alias("linked"), F.lit("letter").alias("scope"), k.alias("ord"), F.col("c_mktsegment").alias("question"),
        F.when(F.col("c_acctbal") > 5000, F.concat("c_name", F.lit("！ and more"))).when(F.col("c_acctbal") > 0, "").alias("close_reading_answer"), none.alias("answer_hint_expanded"), F.when(F.col("c_nationkey") > 12, "hint").alias("answer_hint"), F.when(k % 7 == 0, F.array(F.lit("one"))).alias("answer_steps"),
    )


@query("g28_reading_units", f"""WITH {_UNIT_CHAPTERS}, {_UNIT_QUESTIONS}, u AS (SELECT *, {_CLUES} AS clues FROM j)
  SELECT letter_id, number, CASE WHEN n = 1 THEN 'stamp' ELSE '{L.NO_STAMP}' END AS stamp, CASE WHEN n = 7 THEN label ELSE prio END AS route_title, CASE n WHEN 2 THEN prio || '。' WHEN 4 THEN 'a ' || prio || '?' WHEN 5 THEN '' ELSE '{L.NO_GUIDE}' END AS guide, way AS route, array_to_string(places[1:5], '|') AS core_places,
    CASE WHEN n >= 6 THEN '{L.LENGTH_HINTS[0]}' WHEN n >= 4 THEN '{L.LENGTH_HINTS[1]}' WHEN n = 1 THEN '{L.LENGTH_HINTS[2]}' ELSE '{L.LENGTH_HINTS[3]}' END AS hint, CASE n WHEN 5 THEN 'watch' WHEN 3 THEN 'plain' ELSE '{L.NO_FOCUS}' END AS watch,
    array_to_string(list_transform(clues, lambda x: letter_id || '-clue-0' || x.id || ':' || x.mode || ':' || x.e), '|') AS clues, CASE n WHEN 2 THEN told WHEN 4 THEN told WHEN 5 THEN ' ' END AS says, CASE n WHEN 1 THEN 'why' WHEN 5 THEN 'watch' WHEN 3 THEN 'plain' WHEN 4 THEN '' END AS why,
    CASE WHEN n = 2 THEN 'step' ELSE '{'|'.join(L.UNIT_STEPS)}' END AS steps, CASE n WHEN 7 THEN 'changes' WHEN 6 THEN 'then' ELSE '{L.NO_CHANGES}' END AS changes, CAST(CASE WHEN len(route) > 0 THEN least(len(route), 5) ELSE least(len(places), 3) END AS BIGINT) AS embedded,
    question_id, coalesce(question, '{L.UNIT_NO_QUESTION}') AS question, {_REFERENCE} AS reference_answer, CASE WHEN CAST(substr(question_id, 2) AS BIGINT) % 7 = 0 THEN 'one' ELSE '{'|'.join(L.ANSWER_STEPS)}' END AS answer_steps, CASE WHEN n = 3 THEN 'seen' ELSE '{L.UNIT_NOTICE}' END AS notice FROM u""")
def g28_units(spark, d):
    u = F.col("unit")
    b, f, a = u["basic_info"], u["close_reading_flow"], u["question_answer"]
    clues = F.array_join(F.transform(u["source_clues"], lambda c: F.concat_ws(":", c["clue_id"], c["mode"], c["excerpt"])), "|")
    return L.reading_units(unit_chapters(spark, d), unit_questions(spark, d)).select(
        u["letter_id"].alias("letter_id"), F.col("number").cast("long").alias("number"), u["date_or_stamp"].alias("stamp"), u["route_title"].alias("route_title"), u["one_sentence_guide"].alias("guide"), b["route"].alias("route"), F.array_join(b["core_places"], "|").alias("core_places"),
        b["reading_length_hint"].alias("hint"), b["what_to_watch"].alias("watch"), clues.alias("clues"), f["what_it_says"].alias("says"), f["why_it_matters"].alias("why"), F.array_join(f["reading_steps"], "|").alias("steps"), f["changes_to_notice"].alias("changes"),
        F.size(u["embedded_places"]).cast("long").alias("embedded"), a["question_id"].alias("question_id"), a["question"].alias("question"), a["reference_answer"].alias("reference_answer"), F.array_join(a["answer_steps"], "|").alias("answer_steps"), u["secondary_details"]["review_notice"].alias("notice"),
    )


@query("g28_unit_questions", f"""WITH {_UNIT_CHAPTERS}, {_UNIT_QUESTIONS}, r AS (SELECT question_id, 'ch-' || k AS ch, CASE WHEN close <> '' THEN split_part(close, ' ', 1) ELSE {_REFERENCE} END AS s FROM j WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY number DESC, 'ch-' || k DESC) = 1)
  SELECT q.question_id, ch AS letter_anchor, s AS answer_summary FROM q LEFT JOIN r USING (question_id)""")
def g28_questions(spark, d):
    asked = unit_questions(spark, d)
    return L.unit_questions(asked, L.reading_units(unit_chapters(spark, d), asked)).select("question_id", "letter_anchor", "answer_summary")


@query("g28_flow_summary", f"""WITH {_UNIT_CHAPTERS}, {_UNIT_QUESTIONS} SELECT count(*) AS letter_units, count(*) FILTER (len({_CLUES}) >= 3) AS source_clue_ready, count(*) FILTER (len(route) > 0 OR len(places) > 0) AS embedded_places_ready, count(*) AS question_answer_ready, count(question_id) AS with_question FROM j""")
def g28_summary(spark, d):
    return L.flow_summary(L.reading_units(unit_chapters(spark, d), unit_questions(spark, d)))
