"""Composites of a reading guide and its constraint suites, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import guide as U
from quillspark.operators import suites as S
from quillspark.operators import windows as W
from quillspark.plans.domain_queries import SEG, segments
from quillspark.plans.registry import query, table
from quillspark.plans.relational_queries import _TASKS, tasks
from quillspark.plans.text_queries import numbered_sql, strip_sql

# review tasks: a conversation is a letter, its turns are blocks, some of them one block twice; documents ask about blocks

_LINKED = "SELECT (doc_id % 40) || '-' || (doc_id % 7) AS block_id, list('q' || doc_id ORDER BY 'q' || doc_id) AS ids FROM documents WHERE doc_id % 3 = 0 GROUP BY 1"
_BLOCKS = """b AS (SELECT conv_id AS letter_id, turn::BIGINT + 1 AS block_index, conv_id || '-' || (turn % 5) AS block_id, coalesce(text, '') AS t, role, turn % 5 < 2 AS core, turn % 5 = 2 AS extra FROM conversations),
  b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY letter_id, block_id ORDER BY block_index) AS i FROM b) WHERE i = 1)"""


def blocks(spark, d):
    part = F.col("turn") % 5
    role = F.when(F.col("role") == "system", "other").otherwise(F.col("role"))
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("letter_id"), (F.col("turn").cast("long") + 1).alias("block_index"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), part.cast("string")).alias("block_id"),
        F.col("text").alias("block_text"), role.alias("reading_role"), (part < 2).alias("core"), (part == 2).alias("extra"),
    )


def questions(spark, d):
    k = F.col("doc_id")
    block = F.concat((k % 40).cast("string"), F.lit("-"), (k % 7).cast("string"))
    return table(spark, d, "documents").select(F.concat(F.lit("q"), k.cast("string")).alias("question_id"), F.when(k % 3 == 0, block).alias("block_id"))


@query("g31_review_tasks", f"""WITH {_BLOCKS}, l AS ({_LINKED})
  SELECT {numbered_sql("block-' || letter_id || '-", 'block_index', 3)} AS block_task_id, letter_id, block_index, block_id, t AS block_text, CASE role WHEN 'system' THEN 'other' ELSE coalesce(role, '') END AS reading_role,
    CASE WHEN core THEN 'core' WHEN extra THEN 'extra' ELSE 'source' END AS current_placement, length(t) AS block_length, coalesce(array_to_string(ids, ';'), '') AS linked_question_id,
    CASE WHEN core AND block_index = 1 THEN 'P0' WHEN core OR len(ids) > 0 THEN 'P1' ELSE 'P2' END AS review_priority,
    'Does this block represent the letter strongly enough? Does it have complete meaning without feeling cut off? Does it give useful scene, place, route, or travel detail? Is the guide note specific and helpful? '
      || CASE WHEN core THEN 'Should it remain a core reading block or move to the extra area?' ELSE 'Should it stay in the extra area or move into the core reading flow?' END
      || CASE WHEN role IS NULL OR role IN ('system', '') THEN ' Should the reading role be recategorized during human review?' ELSE '' END AS review_question,
    'representative; complete meaning; no abrupt cut; length fit; guide note usefulness' || CASE WHEN length(t) < 90 THEN '; possibly short' ELSE '' END || CASE WHEN length(t) > 280 THEN '; possibly long' ELSE '' END
      || CASE WHEN core THEN '; core placement fit' ELSE '; possible core upgrade' END AS suggested_checks, '' AS review_result, '' AS replacement_strategy, '' AS review_notes, '' AS reviewer, '' AS reviewed_at
  FROM b1 LEFT JOIN l USING (block_id)""")
def g31(spark, d):
    return U.review_tasks(blocks(spark, d), questions(spark, d))


# letters: an order is a letter, its points are the places of its route; customers' numbers serve as questions

_STOP = "{'place_name': p.name, 'then': CASE WHEN p.confidence = 'verified' THEN list_filter([p.name, '', 'T'], lambda x: x <> '') ELSE [] END, 'source_status': CASE p.confidence WHEN 'verified' THEN 'public_source' WHEN 'approximate' THEN 'draft' END, 'coordinate_status': CASE p.confidence WHEN 'verified' THEN 'public_coordinate' WHEN 'approximate' THEN 'approximate_coordinate' END}"
_LETTERS = f"{SEG}, l AS (SELECT id AS letter_id, n, prio, CASE WHEN gap THEN [] ELSE list_transform(ps, lambda p: {_STOP}) END AS route, list_transform(ps, lambda p: p.name) AS places, CASE WHEN status = 'F' THEN ' ' || prio || ' ' WHEN status = 'O' THEN '' END AS summary FROM s)"
_ASKED = "a AS (SELECT c_custkey * 3 AS letter_id, list(c_name ORDER BY c_name) AS ids FROM customer GROUP BY 1)"


def letters(spark, d):
    none = F.lit(None).cast("string")

    def stop(p):
        return F.struct(
            p["name"].alias("place_name"), F.when(p["confidence"] == "verified", F.array(p["name"], F.lit(""), none, F.lit("T"))).alias("then_context"), none.alias("now_context"),
            F.when(p["confidence"] == "verified", "public_source").when(p["confidence"] == "approximate", "draft").alias("source_status"), none.alias("source_name"),
            F.when(p["confidence"] == "verified", "public_coordinate").when(p["confidence"] == "approximate", "approximate_coordinate").alias("coordinate_status"), F.lit("").alias("review_note"),
        )

    route = F.transform("ps", stop)
    summary = F.when(F.col("status") == "F", F.concat(F.lit(" "), F.col("prio"), F.lit(" "))).when(F.col("status") == "O", "")
    return segments(spark, d).select(F.col("id").alias("letter_id"), F.col("n").alias("stops"), F.col("prio").alias("title"), F.when(F.col("gap"), F.slice(route, 1, 0)).otherwise(route).alias("route_now"), F.transform("ps", lambda p: p["name"]).alias("places"), summary.alias("summary"))


def letter_questions(spark, d):
    return table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("letter_id"), F.col("c_name").alias("question_id"), F.col("c_custkey").alias("question_order"), F.col("c_mktsegment").alias("question"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("answer"))


@query("g16_timeline_nodes", f"""WITH {_LETTERS}, {_ASKED}, c AS (SELECT *, len(list_filter(route, lambda p: coalesce(p.source_status = 'public_source', FALSE))) AS pub FROM l)
  SELECT letter_id, prio AS title, CASE WHEN n > 3 THEN 'long' ELSE array_to_string(places, '、') END AS route_label, array_to_string(places, '|') AS primary_places, CASE WHEN n = 2 THEN 'two' WHEN summary LIKE ' %' THEN prio ELSE '本封信的当年旅行语境待人工复核。' END AS then_context,
    '本节点包含 ' || pub || ' 个已补公开来源地点、' || (len(route) - pub) || ' 个待补来源地点。' AS now_context, CASE WHEN n > 2 THEN left('{'long ' * 40}', 159) || '…' ELSE '可按路线、场景、地点和问题四层进入本封信。' END AS reading_mood, pub AS public_source_count, len(route) - pub AS needs_source_review_count,
    coalesce(array_to_string(ids, ','), '') AS linked FROM c LEFT JOIN a USING (letter_id)""".replace(f"left('{'long ' * 40}', 159)", f"'{('long ' * 40)[:159].rstrip()}'"))
def g16(spark, d):
    n = F.col("stops")
    chapters = letters(spark, d).withColumns({"route_label": F.when(n > 3, "long").when(n == 1, ""), "then_note": F.when(n == 2, "two"), "focus": F.when(n > 2, "long " * 40)})
    nodes = U.timeline_nodes(chapters, letter_questions(spark, d))
    return nodes.withColumns({"primary_places": F.array_join("primary_places", "|"), "linked": F.array_join("linked_question_ids", ",")}).drop("linked_question_ids")


@query("g18_embedded_places", f"""WITH {_LETTERS}, u AS (SELECT letter_id, n, route, unnest(range(1, least(len(route), 5) + 1)) AS i FROM l), r AS (SELECT letter_id, i, route[i] AS p, n, list_max(list_filter(range(1, n + 1), lambda k: route[k].place_name = route[i].place_name)) AS last FROM u),
  w AS (SELECT letter_id, places, unnest(range(1, least(len(places), 3) + 1)) AS i FROM l WHERE len(route) = 0)
  SELECT letter_id, i::BIGINT AS i, p.place_name AS place_name, CASE WHEN n = 1 THEN '核心地点' WHEN last = 1 THEN '起点或进入地点' WHEN last = n THEN '抵达或收束地点' ELSE '途经或观察地点' END AS role, CASE WHEN len(p."then") > 0 THEN array_to_string(p."then", '、') ELSE '书信中的旅行语境待复核' END AS then_perspective,
    coalesce(p.source_status, 'needs_source_review') AS source_status, CASE WHEN p.source_status = 'public_source' THEN '已有公开来源' ELSE '待补充公开来源' END AS source_label,
    CASE p.coordinate_status WHEN 'public_coordinate' THEN '已有公开坐标' WHEN 'approximate_coordinate' THEN '近似坐标' ELSE '坐标待复核' END AS coordinate_label, '今日景点信息待公开来源复核。' AS today_perspective, '待后续人工复核。' AS review_note FROM r
  UNION ALL SELECT letter_id, i, places[i], '地点线索', '书信中的旅行语境待复核。', 'needs_source_review', '待补充公开来源', '坐标待复核', '今日景点信息待公开来源复核。', '待后续人工复核。' FROM w""")
def g18(spark, d):
    e = letters(spark, d).select("letter_id", F.posexplode(U.embedded_places(F.col("route_now"), F.col("places"), F.lit(None).cast("string"))).alias("i", "e"))
    return e.select("letter_id", (F.col("i") + 1).cast("long").alias("i"), *[f"e.{c}" for c in ("place_name", "role", "then_perspective", "source_status", "source_label", "coordinate_label", "today_perspective", "review_note")])


@query("g28_close_readings", f"""WITH {_LETTERS}, q AS (SELECT c_custkey * 3 AS letter_id, c_mktsegment AS question, CASE WHEN c_acctbal > 0 THEN c_name END AS answer FROM customer)
  SELECT letter_id, CASE WHEN n > 3 THEN 'seen' WHEN summary LIKE ' %' THEN prio ELSE '原文线索待人工复核。' END AS excerpt_focus, CASE WHEN n > 3 THEN '{'n' * 259}…' ELSE '这条线索用于进入本封信的场景和路线。 它把本封信从单纯地点列表推进到具体旅行经验，适合和路线、场景、今日地点一起读。' END AS why_it_matters,
    array_to_string(list_slice(places, 1, 5), '|') AS scenes, len(places) AS places, '把书中当年的到达、移动和观看方式，与今日景点化、城市化或交通化后的读法分开比较。' AS then_now_prompt, coalesce(question, '本封信的对应阅读问题待人工复核。') AS question_bridge, coalesce(answer, '这道题的参考回答仍需人工复核；可先从路线、地点和原文线索入手。') AS answer_bridge FROM l LEFT JOIN q USING (letter_id)""")
def g28(spark, d):
    n = F.col("stops")
    chapters = letters(spark, d).withColumns({"excerpt": F.when(n > 3, "seen"), "excerpt_note": F.when(n > 3, "n" * 300), "scenes": F.col("places"), "comparison": F.lit(" ")})
    r = U.close_readings(chapters, letter_questions(spark, d))
    return r.withColumns({"scenes": F.array_join("scene_to_notice", "|"), "places": F.size("place_to_notice").cast("long")}).drop("scene_to_notice", "place_to_notice")


@query("g29_enriched_questions", """WITH c AS (SELECT c_custkey * 2 AS section_id, c_name, c_mktsegment FROM customer)
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '参考回答：这本书可以看作一组按行程推进的旅行书信。读者可以先看地点从北方关隘、关中城市、西南山水、东南沿海一路展开，再看作者如何在不同景观中调整观看方式。这个回答仍是导读提示。'
      WHEN section_id IS NOT NULL THEN '参考回答：可先把' || CASE WHEN c_mktsegment = 'FURNITURE' THEN '地点线索' ELSE c_mktsegment END || '作为空间顺序，再结合原书场景线索（如' || c_name || '；b）理解这封信。今日对照应优先看已列公开来源，未列来源的地点只作待复核提示。'
      ELSE '参考回答：先从对应章节标题、地点线索和主题标签入手；具体解释待人工复核。' END AS answer_hint,
    CASE WHEN o_orderstatus = 'P' THEN '25 封书信标题|章节地点线索|结构化主题' WHEN section_id IS NOT NULL THEN c_name || '|b|c' ELSE '' END AS source_clues, CASE WHEN o_orderstatus <> 'P' AND section_id IS NOT NULL THEN c_mktsegment ELSE '' END AS place_clues,
    CASE WHEN o_orderstatus = 'P' THEN '全书的今日对照应按每封信的地点分别核验。' WHEN section_id IS NOT NULL THEN c_name ELSE '今日对照待补充。' END AS then_now_hint FROM orders LEFT JOIN c ON o_custkey = section_id""")
def g29(spark, d):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    chapters = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("section_id"), F.when(seg == "FURNITURE", "").otherwise(seg).alias("route_label"), F.array(name, F.lit("b"), F.lit("c"), F.lit("d")).alias("scenes"), F.array(seg).alias("places"), name.alias("comparison"))
    asked = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("section_id"), F.when(F.col("o_orderstatus") == "P", "book").otherwise("letter").alias("scope"))
    return U.enriched_questions(asked, chapters).select("o_orderkey", "answer_hint", F.array_join("source_clues", "|").alias("source_clues"), F.array_join("place_clues", "|").alias("place_clues"), "then_now_hint")


# places: customers with coordinates

_PLACES = "pl AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_acctbal > 5000 THEN 'public_coordinate' WHEN c_acctbal > 0 THEN 'approximate_coordinate' ELSE 'needs_coordinate_review' END AS status, CASE WHEN c_nationkey = 0 THEN 'unknown' ELSE c_mktsegment END AS type FROM customer)"


def places(spark, d):
    a = F.col("c_acctbal")
    status = F.when(a > 5000, "public_coordinate").when(a > 0, "approximate_coordinate").when(F.col("c_custkey") % 2 == 0, "")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("place_order"), F.col("c_name").alias("place_name"), status.alias("coordinate_status"), F.when(F.col("c_nationkey") != 0, F.col("c_mktsegment")).alias("coordinate_source_type"))


@query("g17_coordinate_stats", f"""WITH {_PLACES}, t AS (SELECT type, count(*) AS n FROM pl WHERE status <> 'needs_coordinate_review' GROUP BY type)
  SELECT count(*) AS total_place_count, count(*) FILTER (status = 'public_coordinate') AS public_coordinate_count, count(*) FILTER (status = 'approximate_coordinate') AS approximate_coordinate_count, count(*) FILTER (status = 'needs_coordinate_review') AS needs_coordinate_review_count,
    count(*) FILTER (status <> 'needs_coordinate_review') AS coordinate_ready_count, (SELECT '{{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}}' FROM t) AS coordinate_source_type_counts FROM pl""")
def g17(spark, d):
    return U.coordinate_stats(places(spark, d))


@query("g17_map_nodes", f"WITH {_PLACES} SELECT row_number() OVER (ORDER BY status, k) AS node, name AS place_name FROM pl")
def g17_nodes(spark, d):
    p = places(spark, d).withColumn("s", F.coalesce(U.either(F.col("coordinate_status")), F.lit(U.PENDING_COORDINATE)))
    return U.map_nodes(p, ["s", "place_order"], [F.col("s"), F.floor(F.col("place_order") / W.NUMBERED_TOGETHER)]).select("node", "place_name")


@query("g17_ready_by_letter", f"WITH {_PLACES} SELECT o_orderkey AS letter_id, CASE WHEN status IN ('public_coordinate', 'approximate_coordinate') THEN 1 ELSE 0 END AS coordinate_ready_count, CASE WHEN status IN ('public_coordinate', 'approximate_coordinate') OR o_orderstatus = 'P' THEN 0 ELSE 1 END AS needs_coordinate_review_count FROM orders LEFT JOIN pl ON o_custkey = k AND o_orderstatus <> 'P'")
def g17_letters(spark, d):
    stops = table(spark, d, "orders").select(F.col("o_orderkey").alias("letter_id"), F.when(F.col("o_orderstatus") != "P", F.format_string("Customer#%09d", "o_custkey")).alias("place_name"))
    return U.ready_by_letter(stops, places(spark, d))


# identity, catalogue, promotion


@query("g26_envelope", "SELECT 'v2' AS schema_version, 'draft' AS status, (SELECT min(n_name) FROM nation) AS title, 'epub' AS source_type, r_regionkey, r_name FROM region")
def g26(spark, d):
    book = table(spark, d, "nation").agg(F.min("n_name").alias("n")).select(U.either(F.lit(""), F.lit(None).cast("string"), F.col("n")).alias("title"), F.lit("epub").alias("source_type"))
    wrapped = U.with_envelope(table(spark, d, "region").select("r_regionkey", "r_name"), book, schema_version="v2", status="draft")
    return wrapped.select("schema_version", "status", "book.*", "r_regionkey", "r_name")


_NOTED = f"{_TASKS}, t AS (SELECT doc_id, priority, CASE WHEN result = 'odd' THEN 'needs_fix' WHEN result = 'fail' AND priority = 'P2' THEN 'deferred' ELSE result END AS result, CASE WHEN doc_id % 2 = 0 THEN 'n' ELSE '' END AS notes FROM tasks)"


@query("g12_task_blockers", f"""WITH {_NOTED}, p AS (SELECT doc_id, CASE WHEN result NOT IN ('pass', 'deferred') THEN 'p2_not_pass_or_deferred' WHEN result = 'deferred' AND notes = '' THEN 'p2_deferred_without_notes' END AS x FROM t WHERE priority = 'P2'),
  i AS (SELECT doc_id, CASE WHEN result NOT IN ('', 'pass', 'needs_fix', 'blocked', 'deferred') THEN 'illegal_manual_result' WHEN result IN ('needs_fix', 'blocked') THEN 'manual_review_' || result END AS x FROM t)
  SELECT (SELECT count(*) FROM t) AS total, (SELECT count(*) FROM t WHERE result = '') AS blank, concat_ws('|', CASE WHEN (SELECT count(*) FROM t) <> 95 THEN 'manual_review_summary_mismatch' END, CASE WHEN EXISTS (FROM t WHERE priority IN ('P0', 'P1') AND result = '') THEN 'manual_review_incomplete' END,
    CASE WHEN EXISTS (FROM t WHERE priority IN ('P0', 'P1') AND result <> 'pass') THEN 'p0_p1_not_all_pass' END, (SELECT x FROM p WHERE x IS NOT NULL ORDER BY doc_id LIMIT 1), (SELECT x FROM i WHERE x IS NOT NULL ORDER BY doc_id LIMIT 1)) AS blockers""")
def g12(spark, d):
    r = F.col("result")
    noted = tasks(spark, d).select("doc_id", "priority", F.when(r == "odd", "needs_fix").when((r == "fail") & (F.col("priority") == "P2"), "deferred").otherwise(r).alias("result"), F.when(F.col("doc_id") % 2 == 0, "n").alias("notes"))
    return U.task_blockers(noted, "doc_id", F.lit(95)).withColumn("blockers", F.array_join("blockers", "|"))


@query("g12_file_blockers", """WITH p AS (SELECT page_id AS k, url AS name, CASE WHEN page_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS schema_version, CASE WHEN page_id % 7 = 0 THEN 'final' ELSE 'draft' END AS status FROM pages WHERE url IS NOT NULL),
  j AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'final' ELSE 'draft' END AS mirrored, k % 3 = 1 AS missing FROM p)
  SELECT k, 'missing_web_mirror_file:' || k AS blocker FROM j WHERE missing UNION ALL SELECT k, 'schema_version_mismatch:' || k FROM j WHERE NOT missing AND schema_version <> 'v2' UNION ALL SELECT k, 'public_status_not_draft:' || k FROM j WHERE NOT missing AND status <> 'draft'
  UNION ALL SELECT k, 'web_mirror_mismatch:' || k FROM j WHERE NOT missing AND (mirrored <> status OR k % 13 = 0) UNION ALL SELECT k, 'web_status_not_draft:' || k FROM j WHERE NOT missing AND mirrored <> 'draft'""")
def g12_files(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").where("url IS NOT NULL")
    schema, name = F.when(k % 5 == 0, "v1").otherwise("v2").alias("schema_version"), k.cast("string").alias("name")
    public = p.select(name, schema, F.when(k % 7 == 0, "final").otherwise("draft").alias("status"), F.col("url").alias("body"))
    mirror = p.where(k % 3 != 1).select(name, schema, F.when(k % 11 == 0, "final").otherwise("draft").alias("status"), F.when(k % 13 == 0, None).otherwise(F.col("url")).alias("body"))
    return U.file_blockers(public, mirror, "v2").select(F.col("name").cast("long").alias("k"), "blocker")


@query("g36_added_projects", """WITH old AS (SELECT 'nation-' || n_nationkey AS slug, n_name AS title FROM nation), new AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'Bad Slug' ELSE 'nation-' || (s_nationkey + s_suppkey % 4 * 20) END AS slug, 's' || s_suppkey AS title FROM supplier)
  SELECT slug, title, NULL AS refused FROM old UNION ALL SELECT slug, title, CASE WHEN slug = 'Bad Slug' THEN 'invalid slug' WHEN slug IN (SELECT slug FROM old) OR row_number() OVER (PARTITION BY slug ORDER BY title) > 1 THEN 'slug exists' END FROM new""")
def g36(spark, d):
    old = table(spark, d, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("title"))
    s = F.col("s_suppkey")
    slug = F.when(s % 4 == 0, "Bad Slug").otherwise(F.concat(F.lit("nation-"), (F.col("s_nationkey") + s % 4 * 20).cast("string")))
    return U.added_projects(old, table(spark, d, "supplier").select(slug.alias("slug"), F.concat(F.lit("s"), s.cast("string")).alias("title")))


@query("g37_promoted", "SELECT n_nationkey, 'reviewed' AS status FROM nation UNION ALL SELECT n_nationkey + 1000, 'draft' FROM nation")
def g37(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.lit("draft").alias("status"))
    refused = U.promoted(n, True, "promote ", "promote", "reviewed").withColumn("n_nationkey", F.col("n_nationkey") + 1000)
    return U.promoted(n, True, "promote", "promote", "reviewed").unionByName(refused)


@query("g23_inspected", """WITH f AS (SELECT source || '-' || (doc_id % 20) AS project, lang AS kind, doc_id % 5 <> 0 AS present, CASE WHEN doc_id % 90 = 0 THEN 'marker' END AS finding FROM documents),
  g AS (SELECT project, count(*) FILTER (present) AS files_present, concat_ws('|', CASE WHEN NOT bool_or(kind = 'fr' AND present) THEN 'fr' END, CASE WHEN NOT bool_or(kind = 'de' AND present) THEN 'de' END) AS missing_next, count(finding) = 0 AS privacy_ok, bool_or(kind = 'en' AND present) AS en FROM f GROUP BY project)
  SELECT project, files_present, missing_next, privacy_ok, privacy_ok AND en AS intake_ready, concat_ws('|', CASE WHEN missing_next <> '' THEN 'implement the missing next stages' END, CASE WHEN privacy_ok AND en THEN 'build the briefs' ELSE 'complete the intake' END) AS next_actions FROM g""")
def g23(spark, d):
    k = F.col("doc_id")
    files = table(spark, d, "documents").select(F.concat("source", F.lit("-"), (k % 20).cast("string")).alias("project"), F.col("lang").alias("kind"), (k % 5 != 0).alias("present"), F.when(k % 90 == 0, "marker").alias("finding"))
    return U.inspected(files, ("en",), ("fr", "de")).withColumns({c: F.array_join(c, "|") for c in ("missing_next", "next_actions")})


# constraint suites


def _found(rule: str, severity: str, path: str, message: str, source: str) -> str:
    said = message if message.startswith("(") else f"'{message}'"
    return f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, CAST({path} AS VARCHAR) AS path, {said} AS message FROM {source}"


def _all(rules) -> str:
    return " UNION ALL ".join(_found(*r) for r in rules)


_ROUTE = f"""{SEG}, g0 AS (SELECT id, CASE WHEN id % 50 = 0 THEN id + 1 WHEN id % 51 <> 0 THEN id END AS ord, CASE WHEN status <> 'P' THEN prio ELSE '' END AS title, list_transform(ps, lambda p: {{'name': p.name, 'lat': p.lat * 2, 'lng': p.lng}}) AS pts, n, gap, status FROM s),
  g AS (SELECT id, ord, title, CASE WHEN id % 37 <> 0 THEN pts[1] END AS st, pts[n] AS en, CASE WHEN id % 37 <> 0 THEN [pts[1]] ELSE [] END || CASE WHEN n > 2 THEN pts[2:n - 1] ELSE [] END || [pts[n]] AS pts,
    CASE WHEN id % 7 = 0 THEN [] ELSE list_transform(pts, lambda p: {{'page': p.lat, 'quote': CASE WHEN id % 5 = 0 THEN repeat(p.name, 60) ELSE p.name END, 'note': CASE WHEN id % 11 <> 0 THEN 'n' ELSE '' END}}) END AS refs,
    CASE WHEN id % 41 <> 0 THEN CASE status WHEN 'F' THEN 'walked' WHEN 'O' THEN 'vehicle' ELSE 'flown' END END AS movement, id % 43 <> 0 AS walk, id % 47 <> 0 AS modern, CASE WHEN id % 29 <> 0 THEN gap END AS gap, id % 3 AS noted, id % 2 = 0 AS reviewed FROM g0),
  rf AS (SELECT id, unnest(refs) AS r, unnest(range(1, len(refs) + 1)) AS i FROM g), pp AS (SELECT id, unnest(pts) AS p FROM g)"""
_BAD = "NOT ((({p}.lat IS NULL) AND ({p}.lng IS NULL)) OR coalesce({p}.lat BETWEEN -90 AND 90 AND {p}.lng BETWEEN -180 AND 180, FALSE))"
_ROUTE_SQL = f"WITH {_ROUTE} " + _all([
    ("C1.order", "error", "'route'", "order must be consecutive", "(SELECT 1 WHERE EXISTS (FROM g WHERE ord IS DISTINCT FROM id))"),
    ("C1.field", "error", "id", "missing order", "g WHERE ord IS NULL OR ord = 0"), ("C1.field", "error", "id", "missing title", "g WHERE title = ''"),
    ("C1.point", "error", "id", "missing start.name", "g WHERE st IS NULL"),
    ("C1.point", "error", "id", "('invalid coordinate for start ' || st.name)", "g WHERE st IS NOT NULL AND " + _BAD.format(p="st")), ("C1.point", "error", "id", "('invalid coordinate for end ' || en.name)", "g WHERE " + _BAD.format(p="en")),
    ("C1.point", "error", "id", "('invalid coordinate for ' || p.name)", "pp WHERE " + _BAD.format(p="p")),
    ("C1.refs", "error", "id", "missing book_refs", "g WHERE len(refs) = 0"), ("C1.refs", "error", "id", "('book_ref #' || i || ' must include page, quote, note')", "rf WHERE r.page IS NULL OR r.note = ''"),
    ("C1.quote", "warning", "id", "('book_ref #' || i || ' quote longer than 120 chars')", "rf WHERE length(r.quote) > 120"),
    ("C1.coordinates", "error", "id", "missing coordinates but no review_notes", "g WHERE NOT reviewed AND len(list_filter(pts, lambda p: p.lat IS NULL)) > 0"),
    ("C1.gap", "error", "id", "missing gap_notes", "g WHERE noted = 0"), ("C1.gap", "error", "id", "missing do_not_connect", "g WHERE gap IS NULL"), ("C1.gap", "error", "id", "do_not_connect requires gap_notes", "g WHERE gap AND noted < 2"),
    ("C1.info", "info", "id", "('movement_type=' || movement)", "g WHERE movement <> 'walked'"), ("C1.info", "info", "id", "do_not_connect", "g WHERE gap"),
    ("C1.enum", "error", "id", "missing movement_type", "g WHERE movement IS NULL"), ("C1.enum", "error", "id", "invalid movement_type", "g WHERE movement = 'flown'"),
    ("C1.enum", "error", "id", "missing walkability_status", "g WHERE NOT walk"), ("C1.enum", "error", "id", "invalid modern_followability", "g WHERE NOT modern"),
])


@query("c1_route", _ROUTE_SQL)
def c1(spark, d):
    i, n, status = F.col("id"), F.col("n"), F.col("status")
    pts = F.transform("ps", lambda p: F.struct(p["name"].alias("name"), (p["lat"] * 2).alias("lat"), p["lng"].alias("lng")))
    s = segments(spark, d).withColumn("pts", pts)
    quote = lambda p: F.when(i % 5 == 0, F.repeat(p["name"], 60)).otherwise(p["name"])
    refs = F.transform("pts", lambda p: F.struct(p["lat"].cast("long").alias("page"), quote(p).alias("quote"), F.when(i % 11 != 0, "n").otherwise("").alias("note")))
    walked = F.when(status == "F", "walked").when(status == "O", "vehicle").otherwise("flown")
    notes = F.when(i % 3 == 1, F.array().cast("array<string>")).when(i % 3 == 2, F.array(F.lit("g")))
    return S.route(s.select(
        "id", i.alias("place"), F.when(i % 50 == 0, i + 1).when(i % 51 != 0, i).alias("order"), F.when(status != "P", F.col("prio")).otherwise("").alias("title"), F.when(i % 37 != 0, F.col("pts")[0]).alias("start"), F.element_at("pts", -1).alias("end"),
        F.when(n > 2, F.slice("pts", F.lit(2), n - 2)).alias("via"), F.when(i % 7 != 0, refs).alias("refs"), F.when(i % 41 != 0, walked).alias("movement_type"), F.lit("continuous").alias("continuity_status"),
        F.when(i % 43 != 0, "needs_review").alias("walkability_status"), F.when(i % 47 != 0, "approximate_only").otherwise("x").alias("modern_followability"), notes.alias("gap_notes"), F.when(i % 29 != 0, F.col("gap")).alias("do_not_connect"), F.when(i % 2 == 0, "r").alias("review_notes"),
    ))


_EXPECTED = tuple(f"sec-{i:03d}" for i in range(6, 31))
_LT = f"""lt AS (SELECT doc_id AS k, CASE WHEN doc_id % 8 = 0 THEN 'L' || doc_id ELSE {numbered_sql('letter-', '(doc_id % 150)', 3)} END AS letter_id, CASE WHEN doc_id % 6 = 5 THEN 'sec-031' ELSE {numbered_sql('sec-', '(doc_id + 6)', 3)} END AS section_id, CASE WHEN doc_id % 14 <> 0 THEN doc_id + 1 END AS ord,
    CASE WHEN doc_id % 13 <> 0 THEN text ELSE ' ' END AS brief, source, doc_id % 9 AS chunks, doc_id % 10 <> 0 AS placed, CASE WHEN doc_id % 12 = 0 THEN [] ELSE [text, source] END AS notes FROM documents),
  ln AS (SELECT k, unnest(notes) AS x, unnest(range(len(notes))) AS i FROM lt)"""


@query("c2_letters", f"WITH {_LT} " + _all([
    ("C2.count", "error", "'letters'", "('expected 25, got ' || n)", "(SELECT count(*) AS n FROM lt) WHERE n <> 25"), ("C2.list", "error", "'letters[' || k || '].places'", "places must be a list", "lt WHERE NOT placed"),
    ("C2.list", "error", "'letters[' || k || '].chunk_ids'", "chunk_ids must be a non-empty list", "lt WHERE chunks < 2"), ("C2.list", "error", "'letters[' || k || '].notes'", "notes must be a non-empty list", "lt WHERE len(notes) = 0"),
    ("C2.id", "error", "'letters[' || k || '].letter_id'", "invalid letter_id", "lt WHERE k % 8 = 0"), ("C2.id", "error", "'letters[' || k || '].letter_id'", "duplicate letter_id", "(SELECT *, row_number() OVER (PARTITION BY letter_id ORDER BY k) AS i FROM lt) WHERE i > 1"),
    ("C2.order", "error", "'letters[' || k || '].order'", "out of order", "lt WHERE ord IS NULL"), ("C2.section", "error", "'letters[' || k || '].section_id'", "section out of order", "lt WHERE k >= 25 OR k % 6 = 5"),
    ("C2.section", "error", "'letters[' || k || '].section_id'", "forbidden section", "lt WHERE section_id IN ('sec-031', 'sec-001')"), ("C2.brief", "error", "'letters[' || k || '].brief'", "brief must be a non-empty string", f"lt WHERE coalesce({strip_sql('brief')}, '') = ''"),
    ("C2.marker", "error", "'letters[' || k || ']'", "forbidden marker", "lt WHERE contains(coalesce(brief, ''), 'license') OR contains(source, 'license')"), ("C2.note", "error", "'letters[' || k || '].evidence_refs[' || i || ']'", "evidence note too long", "ln WHERE length(x) > 160"),
    ("C2.marker", "error", "'letters[' || k || '].evidence_refs[' || i || ']'", "forbidden marker", "ln WHERE contains(x, 'license')"),
]))
def c2(spark, d):
    k = F.col("doc_id")
    none = F.array().cast("array<string>")
    rows = table(spark, d, "documents").select(
        (k + 1).alias("place"), F.when(k % 8 == 0, F.concat(F.lit("L"), k.cast("string"))).otherwise(T.numbered("letter-", k % 150, 3)).alias("letter_id"), F.when(k % 6 == 5, "sec-031").otherwise(T.numbered("sec-", k + 6, 3)).alias("section_id"), F.when(k % 14 != 0, k + 1).alias("order"), F.col("source").alias("title"),
        F.when(k % 9 == 0, none).when(k % 9 > 1, F.array(F.lit("c"))).alias("chunk_ids"), F.when(k % 13 != 0, F.col("text")).otherwise(" ").alias("brief"), F.when(k % 10 != 0, none).alias("places"), none.alias("themes"), F.when(k % 12 == 0, none).otherwise(F.array("text", "source")).alias("notes"),
    )
    return S.letters(rows, _EXPECTED, ("license",), ("sec-031", "sec-001"))


_PASSAGES = """ch AS (SELECT DISTINCT conv_id AS chapter FROM conversations UNION ALL SELECT n_nationkey + 9000000 FROM nation),
  it AS (SELECT conv_id AS chapter, turn::BIGINT AS item, CASE WHEN turn <> 4 THEN conv_id ELSE conv_id + 1 END AS section_id, CASE turn % 3 WHEN 1 THEN text || 'zz' WHEN 2 THEN replace(text, ' ', '  ') ELSE text END AS t, turn < 2 AS core, turn > 2 AS extra, CASE WHEN turn % 4 <> 3 THEN role ELSE ' ' END AS note FROM conversations),
  sized AS (SELECT ch.chapter, count(item) AS a, count(*) FILTER (core) AS c, count(*) FILTER (extra) AS e FROM ch LEFT JOIN it USING (chapter) GROUP BY 1)"""
_AT, _CH = "'chapters[' || chapter || '][' || item || ']'", "'chapters[' || chapter || ']'"


@query("c7_reading_blocks", f"WITH {_PASSAGES} " + _all([
    ("C7.chapters", "error", "'chapters'", "('expected 25, got ' || n)", "(SELECT count(*) AS n FROM ch) WHERE n <> 25"), ("C7.few", "error", _CH, "('expected >=5 all, got ' || a)", "sized WHERE a < 5"), ("C7.few", "error", _CH, "('expected >=2 core, got ' || c)", "sized WHERE c < 2"), ("C7.few", "error", _CH, "('expected >=3 extra, got ' || e)", "sized WHERE e < 3"),
    ("C7.field", "error", _AT, "missing note", f"it WHERE {strip_sql('note')} = ''"), ("C7.field", "error", _AT, "missing text", f"it WHERE coalesce({strip_sql('t')}, '') = ''"), ("C7.section", "error", _AT, "section mismatch", "it WHERE item = 4"), ("C7.length", "error", _AT, "too short", "it WHERE length(coalesce(t, '')) < 70"), ("C7.length", "warning", _AT, "near the long limit", "it WHERE length(t) > 340"),
    ("C7.placeholder", "error", _AT, "placeholder marker found", "it WHERE contains(t, 'zz')"),
    ("C7.source", "error", _AT, "text not found in its section", f"it WHERE NOT EXISTS (FROM conversations c WHERE c.conv_id = chapter AND {strip_sql('t')} <> '' AND (contains(c.text, t) OR contains(regexp_replace(c.text, '\\s+', ' ', 'g'), trim(regexp_replace(t, '\\s+', ' ', 'g')))))"),
]))
def c7(spark, d):
    turns = table(spark, d, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    chapters = turns.select(k.alias("chapter")).distinct().unionByName(table(spark, d, "nation").select((F.col("n_nationkey") + 9000000).alias("chapter"))).withColumn("section_id", F.col("chapter"))
    text = F.when(t % 3 == 1, F.concat("text", F.lit("zz"))).when(t % 3 == 2, F.replace(F.col("text"), F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    items = turns.select(k.alias("chapter"), t.cast("long").alias("item"), F.when(t != 4, k).otherwise(k + 1).alias("section_id"), text.alias("text"), (t < 2).alias("core"), (t > 2).alias("extra"), F.when(t % 4 != 3, F.col("role")).otherwise(" ").alias("note"))
    return S.passages(chapters, items, turns.select(k.alias("section_id"), "text"), "C7", {"all": 5, "core": 2, "extra": 3}, ("text", "note"), ("zz",), 70, 340)


@query("c7_average", f"""WITH b AS (SELECT round_even(avg(length(coalesce(text, ''))), 1) AS b FROM documents), e AS (SELECT round_even(avg(length(text)), 1) AS e FROM benchmark WHERE text <> ''), x AS (SELECT round_even(avg(length(text)), 1) AS e FROM documents WHERE text <> ''), y AS (SELECT round_even(avg(length(coalesce(text, ''))), 1) AS b FROM benchmark)
  {_found('C7.average', 'error', "'average_length'", 'average block length is not clearly above excerpt average', 'b, e WHERE b < greatest(90, e + 35)')} UNION ALL {_found('C7.average', 'error', "'average_length'", 'average block length is not clearly above excerpt average', 'x, y WHERE b < greatest(90, e + 35)')}""")
def c7_average(spark, d):
    docs, marks = table(spark, d, "documents").select("text"), table(spark, d, "benchmark").select("text")
    return S.longer_blocks(docs, marks).unionByName(S.longer_blocks(marks, docs))


@query("c8_workbench", f"""WITH {_BLOCKS}, tk AS (SELECT {numbered_sql("block-' || letter_id || '-", 'block_index', 3)} AS id, *, length(t) + CASE WHEN block_index % 3 = 0 THEN 1 ELSE 0 END AS stated, CASE WHEN core AND block_index = 1 THEN 'P0' END AS p0 FROM b1), pl AS (SELECT letter_id, count(*) AS n FROM tk GROUP BY 1) """ + _all([
    ("C8.count", "error", "'tasks'", "('expected 125, got ' || n)", "(SELECT count(*) AS n FROM tk) WHERE n <> 125"), ("C8.letters", "error", "'tasks'", "('expected 25, got ' || n)", "(SELECT count(*) AS n FROM pl) WHERE n <> 25"), ("C8.p0", "error", "'tasks'", "('expected at least 25, got ' || n)", "(SELECT count(p0) AS n FROM tk) WHERE n < 25"),
    ("C8.letter", "error", "letter_id", "fewer than 5 tasks", "pl WHERE n < 5"), ("C8.field", "error", "id", "missing block_text", f"tk WHERE {strip_sql('t')} = ''"), ("C8.length", "error", "id", "length does not match the text", "tk WHERE stated <> length(t)"), ("C8.blank", "error", "id", "reviewer must be blank", "tk WHERE block_index % 4 = 0"),
]))
def c8_workbench(spark, d):
    made = U.review_tasks(blocks(spark, d), questions(spark, d))
    i = F.col("block_index")
    odd = made.withColumns({"reviewer": F.when(i % 4 == 0, "x").otherwise(""), "block_length": F.col("block_length") + F.when(i % 3 == 0, 1).otherwise(0)})
    return S.workbench(odd, "block_task_id", ["letter_id", "block_index", "block_text", "review_question"], 125)


_MANUAL = f"""{_TASKS}, mt AS (SELECT doc_id AS place, CASE WHEN doc_id % 20 <> 19 THEN 't' || (doc_id % 180) ELSE '' END AS task_id, CASE WHEN doc_id % 33 = 0 THEN 'P3' ELSE priority END AS priority,
    CASE doc_id % 6 WHEN 0 THEN 'public_boundary' WHEN 1 THEN 'chapter_card' WHEN 2 THEN 'key_concept' WHEN 3 THEN 'chapter_card_sample' WHEN 4 THEN 'web_mirror' ELSE '' END AS category, CASE WHEN doc_id % 11 <> 0 THEN 'x' || (doc_id % 50) ELSE '' END AS target_id, result FROM tasks),
  sm(kind, name, n) AS (VALUES ('total', '', 200), ('priority', 'P0', 18), ('priority', 'P1', 100), ('category', 'chapter_card', 33), ('category', 'key_concept', 33), ('category', 'web_mirror', NULL)),
  rc AS (SELECT 'total' AS kind, '' AS name, count(*) AS m FROM mt UNION ALL SELECT 'priority', priority, count(*) FROM mt GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM mt GROUP BY 2)"""


@query("c12_manual_tasks", f"WITH {_MANUAL} " + _all([
    ("C12.id", "error", "place", "task_id is required", "mt WHERE task_id = ''"), ("C12.id", "error", "place", "duplicate task_id", "(SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY place) AS i FROM mt) WHERE i > 1 AND task_id <> ''"),
    ("C12.enum", "error", "place", "invalid priority", "mt WHERE priority = 'P3'"), ("C12.field", "error", "place", "missing category", "mt WHERE category = ''"), ("C12.field", "error", "place", "missing target_id", "mt WHERE target_id = ''"), ("C12.blank", "error", "place", "manual_result must be blank", "mt WHERE result <> ''"),
    ("C12.summary", "error", "kind || '.' || name", "does not match the recount", "rc LEFT JOIN sm USING (kind, name) WHERE n IS DISTINCT FROM m"), ("C12.summary", "error", "kind", "counts do not sum to the total", "(SELECT kind, sum(n) AS s FROM sm WHERE kind <> 'total' GROUP BY 1) WHERE s <> (SELECT count(*) FROM mt)"),
    *[("C12.coverage", "error", f"'{c}'", "no P0 task", f"(SELECT count(*) AS n FROM mt WHERE priority = 'P0' AND category = '{c}') WHERE n = 0") for c in ("public_boundary", "schema_status", "web_mirror", "quote_policy", "book_overview")],
    *[("C12.coverage", "error", f"'{c}'", f"('expected {w}, got ' || n)", f"(SELECT count(DISTINCT target_id) AS n FROM mt WHERE category = '{c}') WHERE n <> {w}") for c, w in (("chapter_card", 25), ("key_concept", 5), ("reading_question", 26), ("quote_structural_entry", 25))],
    ("C12.coverage", "error", "'chapter_card_sample'", "fewer than 5 P0 tasks", "(SELECT count(*) AS n FROM mt WHERE priority = 'P0' AND category = 'chapter_card_sample') WHERE n < 5"),
]))
def c12(spark, d):
    k = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("public_boundary", "chapter_card", "key_concept", "chapter_card_sample", "web_mirror", "")))
    made = tasks(spark, d).select(k.alias("place"), F.when(k % 20 != 19, F.concat(F.lit("t"), (k % 180).cast("string"))).alias("task_id"), F.when(k % 33 == 0, "P3").otherwise(F.col("priority")).alias("priority"), kinds[(k % 6).cast("int")].alias("category"),
                                  F.when(k % 11 != 0, F.concat(F.lit("x"), (k % 50).cast("string"))).alias("target_id"), F.lit("q").alias("review_question"), F.col("result").alias("manual_result"))
    stated = spark.createDataFrame([("total", "", 200), ("priority", "P0", 18), ("priority", "P1", 100), ("category", "chapter_card", 33), ("category", "key_concept", 33), ("category", "web_mirror", None)], "kind string, name string, n long")
    return S.manual_tasks(made, stated)


@query("c18_place_sources", "WITH p AS (SELECT c_custkey AS k, c_acctbal > 0 AS public, c_nationkey = 3 AS odd, c_nationkey < 5 AS bare FROM customer), n AS (SELECT count(*) FILTER (public AND NOT odd) AS n FROM p) " + _all([
    ("C18.count", "error", "'places'", "not above 11 public sources", "n WHERE n <= 11"), ("C18.count", "warning", "'places'", "below 20 public sources", "n WHERE n < 20"), ("C18.stats", "error", "'stats'", "does not match the recount", "n WHERE n <> 7"),
    ("C18.status", "error", "'places[' || k || ']'", "unexpected source_status", "p WHERE odd"), ("C18.field", "error", "'places[' || k || ']'", "missing source_url", "p WHERE public AND bare AND NOT odd"), ("C18.field", "error", "'places[' || k || ']'", "missing source_review_note", "p WHERE public AND bare AND NOT odd"),
    ("C18.note", "error", "'places[' || k || ']'", "missing review note", "p WHERE NOT public AND bare AND NOT odd"),
]))
def c18(spark, d):
    bare = F.col("c_nationkey") < 5
    status = F.when(F.col("c_nationkey") == 3, None).when(F.col("c_acctbal") > 0, "public_source").otherwise("needs_source_review")
    return S.place_sources(table(spark, d, "customer").select(F.col("c_custkey").alias("place"), status.alias("source_status"), F.col("c_name").alias("source_name"), F.when(~bare, "u").alias("source_url"), F.col("c_mktsegment").alias("source_type"), F.when(~bare, "n").otherwise("").alias("source_review_note"), F.lit(12).alias("updated_in")), 7)


@query("c19_coordinates", "WITH p AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'public_coordinate' WHEN c_acctbal > 0 THEN 'needs_coordinate_review' WHEN c_nationkey < 9 THEN 'odd' END AS s, c_nationkey * 8 AS lat, c_nationkey AS nk FROM customer) " + _all([
    ("C19.count", "error", "'places'", "('expected 66, got ' || n)", "(SELECT count(*) AS n FROM p) WHERE n <> 66"), ("C19.coverage", "warning", "'places'", "fewer than 35 places with a coordinate", "(SELECT count(*) AS n FROM p WHERE s = 'public_coordinate') WHERE n < 35"),
    ("C19.status", "error", "'places[' || k || ']'", "missing coordinate_status", "p WHERE s IS NULL"), ("C19.status", "error", "'places[' || k || ']'", "unexpected coordinate_status", "p WHERE s = 'odd'"),
    ("C19.point", "error", "'places[' || k || ']'", "missing or invalid lat/lng", "p WHERE s = 'public_coordinate' AND (lat > 90 OR nk = 2)"), ("C19.note", "error", "'places[' || k || ']'", "missing review note", "p WHERE s = 'needs_coordinate_review' AND nk < 12"),
]))
def c19(spark, d):
    a, n = F.col("c_acctbal"), F.col("c_nationkey")
    status = F.when(a > 5000, "public_coordinate").when(a > 0, "needs_coordinate_review").when(n < 9, "odd")
    return S.coordinates(table(spark, d, "customer").select(F.col("c_custkey").alias("place"), status.alias("coordinate_status"), (n * 8.0).alias("lat"), F.when(n != 2, n * 1.0).alias("lng"), F.when(n >= 12, "n").alias("coordinate_review_note")))
