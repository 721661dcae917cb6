"""Composite operators on segments, reviews, evidence and release gates, each beside the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import checks as C
from quillspark.operators import evidence as E
from quillspark.operators import geo as G
from quillspark.operators import joins as J
from quillspark.operators import review as R
from quillspark.operators import windows as W
from quillspark.plans.registry import query, table
from quillspark.plans.relational_queries import _TASKS, tasks
from quillspark.plans.text_queries import CLAIMS_SQL, anchors_sql, key_sql, numbered_sql, strip_sql
from quillspark.sources.kept import shared_folder
from quillspark.sources.versioned import VersionedTable

#: Segments of the benchmark tables: an order is a segment, its lines are the points in order.
SEG = """pt AS (SELECT l_orderkey AS id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS ord, 'P' || l_partkey AS name, CASE WHEN l_suppkey % 29 <> 0 THEN CAST((l_partkey * 7) % 120 - 60 AS DOUBLE) END AS lat,
    CASE WHEN l_suppkey % 29 <> 0 THEN CAST((l_suppkey * 11) % 300 - 150 AS DOUBLE) END AS lng, CASE WHEN l_suppkey % 29 = 0 THEN 'missing' WHEN l_returnflag = 'R' THEN 'approximate' ELSE 'verified' END AS confidence FROM lineitem),
  seg AS (SELECT id, list({'name': name, 'lat': lat, 'lng': lng, 'confidence': confidence} ORDER BY ord) AS ps FROM pt GROUP BY id),
  s AS (SELECT id, ps, len(ps) AS n, o_orderstatus = 'P' AS gap, o_orderstatus AS status, o_orderpriority AS prio, o_totalprice AS price FROM seg JOIN orders ON id = o_orderkey)"""


def segments(spark, d):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    known = s % 29 != 0
    point = F.struct(
        (F.col("l_linenumber") * 100000000 + k * 1000 + s).alias("ord"), F.concat(F.lit("P"), k.cast("string")).alias("name"),
        F.when(known, (k * 7 % 120 - 60).cast("double")).alias("lat"), F.when(known, (s * 11 % 300 - 150).cast("double")).alias("lng"),
        F.when(~known, "missing").when(F.col("l_returnflag") == "R", "approximate").otherwise("verified").alias("confidence"),
    )
    seg = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(point)).alias("ps"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("gap"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"), F.col("o_totalprice").alias("price"))
    return seg.join(o, "id").withColumn("n", F.size("ps"))


@query("w6_chain_distance", f"""WITH {SEG}, st AS (SELECT id, ps, n, unnest(range(1, n)) AS i FROM s WHERE n >= 2 AND len(list_filter(ps, lambda p: p.lat IS NULL)) = 0)
  SELECT id, CAST(floor(round(sum(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(ps[i + 1].lat) - radians(ps[i].lat)) / 2), 2) + cos(radians(ps[i].lat)) * cos(radians(ps[i + 1].lat)) * pow(sin((radians(ps[i + 1].lng) - radians(ps[i].lng)) / 2), 2))))), 2)) AS BIGINT) AS km FROM st GROUP BY id""")
def w6(spark, d):
    return segments(spark, d).select("id", F.explode(F.array(G.path_km(F.col("ps")))).alias("km")).where("km IS NOT NULL").select("id", F.floor("km").cast("long").alias("km"))


@query("f5_coordinate_state", f"WITH {SEG} SELECT id, CASE WHEN len(list_filter(ps, lambda p: p.confidence = 'missing')) > 0 THEN 'missing' WHEN len(list_filter(ps, lambda p: p.confidence = 'approximate')) > 0 THEN 'approximate' ELSE 'verified' END AS state FROM s")
def f5(spark, d):
    return segments(spark, d).select("id", G.coordinate_state(F.col("ps")).alias("state"))


@query("f6_valid_coordinates", f"WITH {SEG} SELECT id, len(list_filter(ps, lambda p: NOT coalesce((p.lat IS NULL AND p.lng IS NULL) OR (p.lat BETWEEN -50 AND 50), FALSE))) AS odd FROM s")
def f6(spark, d):
    odd = F.filter("ps", lambda p: ~F.coalesce((p["lat"].isNull() & p["lng"].isNull()) | p["lat"].between(-50, 50), F.lit(False)))
    return segments(spark, d).select("id", F.size(odd).cast("long").alias("odd"))


@query("a19_bounding_box", f"WITH {SEG}, u AS (SELECT id, unnest(ps) AS p FROM s) SELECT id, min(p.lat) AS south, max(p.lat) AS north, min(p.lng) AS west, max(p.lng) AS east FROM u GROUP BY id")
def a19(spark, d):
    return segments(spark, d).select("id", G.bounding_box(F.col("ps")).alias("b")).select("id", "b.*")


@query("f1_segment_filters", f"""WITH {SEG} SELECT id, status = 'F' AS walked, status <> 'F' AS mixed, gap AS do_not_connect, len(list_filter(ps, lambda p: p.confidence = 'approximate')) > 0 AS approximate,
  prio = '4-NOT SPECIFIED' AS unspecified, gap OR prio = '4-NOT SPECIFIED' OR len(list_filter(ps, lambda p: p.confidence = 'missing')) > 0 AS needs_review FROM s""")
def f1(spark, d):
    any_of = lambda v: F.exists("ps", lambda p: p["confidence"] == v)
    blank = F.col("prio") == "4-NOT SPECIFIED"
    return segments(spark, d).select("id", (F.col("status") == "F").alias("walked"), (F.col("status") != "F").alias("mixed"), F.col("gap").alias("do_not_connect"), any_of("approximate").alias("approximate"), blank.alias("unspecified"), (F.col("gap") | blank | any_of("missing")).alias("needs_review"))


@query("f13_walkable", f"WITH {SEG} SELECT id FROM s WHERE NOT gap")
def f13(spark, d):
    return segments(spark, d).where(~F.coalesce("gap", F.lit(False))).select("id")


@query("g3_line_features", f"""WITH {SEG} SELECT id, NOT gap AND n >= 2 AND len(list_filter(ps, lambda p: p.lat IS NULL)) = 0 AS drawn, CASE WHEN NOT gap AND n >= 2 AND len(list_filter(ps, lambda p: p.lat IS NULL)) = 0 THEN CAST(n AS BIGINT) END AS points FROM s""")
def g3(spark, d):
    f = segments(spark, d).select("id", G.line_feature(F.col("id"), F.col("ps"), F.col("gap")).alias("f"))
    parsed = f.select("id", F.from_json("f", "geometry struct<type:string,coordinates:array<array<double>>>").alias("g"))
    return parsed.select("id", F.col("g.geometry").isNotNull().alias("drawn"), F.when(F.col("g.geometry").isNotNull(), F.size("g.geometry.coordinates")).cast("long").alias("points"))


@query("g4_point_features", f"WITH {SEG}, u AS (SELECT id, n, unnest(ps) AS p, unnest(range(n)) AS place FROM s) SELECT id, CAST(place AS BIGINT) AS place, CASE WHEN place = 0 THEN 'start' WHEN place = n - 1 THEN 'end' ELSE 'via' END AS role, p.name AS name, p.lat AS lat, p.lng AS lng FROM u WHERE p.lat IS NOT NULL")
def g4(spark, d):
    return G.waypoints(segments(spark, d), "id", "ps")


@query("g5_gpx_tracks", f"""WITH {SEG}, k AS (SELECT id, gap, list_filter(ps, lambda p: p.lat IS NOT NULL) AS kn FROM s) SELECT id,
  '<trkseg>' || array_to_string(list_transform(kn, lambda p: '<trkpt lat="' || CAST(p.lat AS VARCHAR) || '" lon="' || CAST(p.lng AS VARCHAR) || '"><name>' || p.name || '</name></trkpt>'), '') || '</trkseg>' AS track FROM k WHERE NOT gap AND len(kn) >= 2""")
def g5(spark, d):
    return segments(spark, d).select("id", G.gpx_track(F.col("ps"), F.col("gap")).alias("track")).where("track IS NOT NULL")


@query("g6_walkable_blocks", f"WITH {SEG} SELECT {numbered_sql('walk-block-', 'row_number() OVER (ORDER BY id)', 3)} AS block_id, id, CASE WHEN prio = '5-LOW' THEN 'needs_review' WHEN status <> 'F' OR n > 5 THEN 'partial' ELSE 'continuous' END AS status FROM s WHERE NOT gap")
def g6(spark, d):
    return G.walkable_blocks(segments(spark, d), "id", "id", "gap", F.col("status") == "F", F.col("n") > 5, F.col("prio") == "5-LOW")


_RISK = "(CASE WHEN gap THEN 3 ELSE 0 END + CASE WHEN status <> 'F' THEN 2 ELSE 0 END + CASE WHEN prio = '5-LOW' THEN 2 ELSE 0 END + len(list_filter(ps, lambda p: p.confidence = 'approximate')) + n // 3)"


@query("a16_risk_score", f"WITH {SEG}, r AS (SELECT id, CAST({_RISK} AS BIGINT) AS score FROM s) SELECT id, score FROM r WHERE score > 0 ORDER BY score DESC, id LIMIT 8")
def a16(spark, d):
    near = F.size(F.filter("ps", lambda p: p["confidence"] == "approximate"))
    score = G.risk_score(F.col("gap"), F.col("status") != "F", F.col("prio") == "5-LOW", near, F.col("n"))
    return segments(spark, d).select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(8)


@query("a17_reasons", f"WITH {SEG}, r AS (SELECT id, concat_ws('|', CASE WHEN gap THEN 'gap' END, CASE WHEN status <> 'F' THEN 'not walked' END, CASE WHEN prio = '5-LOW' THEN 'low' END) AS reasons FROM s) SELECT * FROM r WHERE reasons <> ''")
def a17(spark, d):
    reasons = F.concat_ws("|", F.when(F.col("gap"), "gap"), F.when(F.col("status") != "F", "not walked"), F.when(F.col("prio") == "5-LOW", "low"))
    return segments(spark, d).select("id", reasons.alias("reasons")).where("reasons <> ''")


@query("g20_candidates_flat", f"WITH {SEG}, u AS (SELECT id, n, unnest(ps) AS p, unnest(range(n)) AS i FROM s) SELECT id, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 1 ELSE 2 END AS role_order, p.name AS name FROM u")
def g20(spark, d):
    u = segments(spark, d).select("id", "n", F.posexplode("ps").alias("i", "p"))
    return u.select("id", F.when(F.col("i") == 0, 0).when(F.col("i") == F.col("n") - 1, 1).otherwise(2).alias("role_order"), F.col("p.name").alias("name"))


@query("g13_priority", "SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 5 = 1 THEN 'P0' WHEN quality = 1 OR toxic = 1 THEN 'P1' ELSE 'P2' END AS priority FROM labels")
def g13(spark, d):
    core = F.col("quality") == 1
    return table(spark, d, "labels").select("doc_id", R.priority(core, F.col("doc_id") % 5 == 1, F.col("toxic") == 1).alias("priority"))


#: Decisions on labels: repeated, unknown, blank, invalid, marked and standing ones among them.
_DEC = """dec AS (SELECT doc_id AS task_id, doc_id AS ord, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'odd' WHEN 2 THEN 'fail' ELSE 'pass' END AS result, CASE WHEN doc_id % 4 = 0 THEN 'see draft' WHEN doc_id % 4 = 1 THEN 'forbidden' ELSE '' END AS notes FROM documents WHERE doc_id % 3 <> 0
    UNION ALL SELECT doc_id, doc_id + 1000000, 'pass', '' FROM documents WHERE doc_id % 50 = 1), tk AS (SELECT doc_id AS task_id, CASE WHEN toxic = 1 THEN 'pass' ELSE '' END AS current FROM labels)"""
_JUDGED = f"""{_DEC}, jd AS (SELECT dec.task_id, dec.ord, result, notes, CASE WHEN row_number() OVER (PARTITION BY dec.task_id ORDER BY dec.ord) > 1 THEN 'duplicate id' WHEN tk.task_id IS NULL THEN 'unknown id' WHEN result = '' AND notes <> '' THEN 'result missing' WHEN result = '' THEN NULL WHEN result NOT IN ('pass', 'fail') THEN 'invalid result'
    WHEN result = 'fail' AND notes = '' THEN 'notes missing' WHEN current <> '' THEN 'already decided' WHEN contains(notes, 'forbidden') THEN 'forbidden marker' END AS problem FROM dec LEFT JOIN tk ON dec.task_id = tk.task_id)"""


def decisions(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id")
    result = F.when(k % 6 == 0, "").when(k % 6 == 1, "odd").when(k % 6 == 2, "fail").otherwise("pass")
    notes = F.when(k % 4 == 0, "see draft").when(k % 4 == 1, "forbidden").otherwise("")
    first = docs.where(k % 3 != 0).select(k.alias("task_id"), k.alias("ord"), result.alias("result"), notes.alias("notes"))
    again = docs.where(k % 50 == 1).select(k.alias("task_id"), (k + 1000000).alias("ord"), F.lit("pass").alias("result"), F.lit("").alias("notes"))
    standing = table(spark, d, "labels").select(k.alias("task_id"), F.when(F.col("toxic") == 1, "pass").otherwise("").alias("current"))
    judged = R.judged_decisions(first.unionByName(again), standing, "task_id", "ord", ("pass", "fail"), ("fail",), ("forbidden",))
    return judged, standing


@query("g10_decision_import", f"WITH {_JUDGED} SELECT task_id, ord, problem, problem IS NULL AND result <> '' AS usable FROM jd")
def g10(spark, d):
    return decisions(spark, d)[0].select("task_id", "ord", "problem", "usable")


@query("g11_decision_apply", f"WITH {_JUDGED}, ok AS (SELECT task_id, result FROM jd WHERE problem IS NULL AND result <> '') SELECT tk.task_id, coalesce(ok.result, current) AS current, ok.result IS NOT NULL AS updated FROM tk LEFT JOIN ok USING (task_id)")
def g11(spark, d):
    """The rows that have no problem make a clean file, and are applied."""
    judged, standing = decisions(spark, d)
    return R.apply_decisions(standing, judged.where("problem IS NULL"), "task_id", dry_run=False)


@query("g11_all_or_nothing", f"WITH {_JUDGED} SELECT tk.task_id, CASE WHEN (SELECT bool_and(problem IS NULL) FROM jd) THEN coalesce(jd.result, current) ELSE current END AS current, (SELECT bool_and(problem IS NULL) FROM jd) AND jd.result IS NOT NULL AS updated FROM tk LEFT JOIN (SELECT * FROM jd WHERE problem IS NULL AND result <> '') jd USING (task_id)")
def g11_all(spark, d):
    """The file as it came: one broken row, and no row is applied."""
    judged, standing = decisions(spark, d)
    return R.apply_decisions(standing, judged, "task_id", dry_run=False)


@query("g11_dry_run", f"WITH {_DEC} SELECT task_id, current, FALSE AS updated FROM tk")
def g11d(spark, d):
    judged, standing = decisions(spark, d)
    return R.apply_decisions(standing, judged, "task_id")


@query("g11_versioned_import", f"WITH {_JUDGED}, ok AS (SELECT task_id, result, notes FROM jd WHERE problem IS NULL AND result <> '') SELECT tk.task_id, coalesce(ok.result, current) AS manual_result, coalesce(ok.notes, '') AS notes, CASE WHEN ok.result IS NOT NULL THEN 'r' ELSE '' END AS reviewer, ok.result IS NOT NULL AS dated, CAST(2 AS BIGINT) AS version FROM tk LEFT JOIN ok USING (task_id)")
def g11_versioned(spark, d):
    """The task table after a broken file, which changes nothing, and a clean one, which makes its second version."""
    judged, standing = decisions(spark, d)
    judged = judged.withColumns({"reviewer": F.lit(" r "), "reviewed_at": F.lit("")})
    store = VersionedTable(spark, f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex[:12]}")
    store.write(standing.withColumnRenamed("current", "manual_result"))
    phrase = f"{R.IMPORT_PHRASE}guide"
    R.import_decisions(store, judged, "task_id", "guide", apply=True, confirm=phrase)
    R.import_decisions(store, judged.where("problem IS NULL"), "task_id", "guide", apply=True, confirm=phrase)
    return store.read().select("task_id", "manual_result", "notes", "reviewer", (F.col("reviewed_at") != "").alias("dated"), F.lit(store.version()).cast("long").alias("version"))


@query("g32_decision_template", f"WITH {_TASKS} SELECT doc_id, priority, '' AS review_result, '' AS reviewer FROM tasks")
def g32(spark, d):
    return R.decision_template(tasks(spark, d), ["doc_id", "priority"], ["review_result", "reviewer"])


@query("g8_snippet", r"""WITH q AS (SELECT item_id, regexp_replace(text, '\s+', ' ', 'g') AS q FROM benchmark), m AS (SELECT item_id, doc_id, q, trim(regexp_replace(d.text, '\s+', ' ', 'g')) AS t FROM documents d JOIN benchmark b ON contains(d.text, b.text) JOIN q USING (item_id))
  SELECT item_id, doc_id, substr(t, greatest(strpos(t, trim(q)) - 120, 1), strpos(t, trim(q)) - greatest(strpos(t, trim(q)) - 120, 1) + length(trim(q)) + 180) AS snippet FROM m""")
def g8(spark, d):
    docs, quotes = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").withColumnRenamed("text", "quote")
    found = J.containment(quotes, docs, "item_id", "quote", "doc_id", "text").join(quotes, "item_id").join(docs, "doc_id")
    return found.select("item_id", "doc_id", T.snippet(F.col("text"), F.col("quote")).alias("snippet"))


#: Nine kinds of references to a document's own page. What is made of the kind 7 is near it (two letters put into a stretch that
#: does not repeat, of a text long enough), the marks of the kind 8 are in no text: so SQL can tell what similarity must find.
_REFS = """refs AS (SELECT doc_id AS ref_id, CASE WHEN doc_id % 9 = 0 THEN 'x' WHEN doc_id % 9 = 1 THEN NULL WHEN doc_id % 9 = 2 THEN CAST(doc_id + 9000000 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS page,
  CASE WHEN doc_id % 9 = 3 THEN '!?' WHEN doc_id % 9 = 4 THEN ' ' WHEN doc_id % 9 = 7 AND length(text) > 300 AND NOT contains(substr(text, 22), substr(text, 21, 12)) AND NOT contains(substr(text, 62), substr(text, 61, 12)) THEN substr(text, 21, 40) || 'zq' || substr(text, 61, 40) WHEN doc_id % 9 = 8 THEN repeat('☂☃', 20) ELSE substr(text, 10, 40) END AS quote,
  CASE WHEN doc_id % 9 = 5 THEN ' ' ELSE 'n' END AS note FROM documents)"""


@query("g1_citation_audit", f"""WITH {_REFS} SELECT ref_id, CASE WHEN page IS NULL OR {strip_sql("coalesce(quote, '')")} = '' OR {strip_sql('note')} = '' THEN 'missing_ref_field' WHEN try_cast(page AS BIGINT) IS NULL THEN 'invalid_page' WHEN d.doc_id IS NULL THEN 'missing_page' WHEN {key_sql('quote')} = '' THEN 'empty_quote'
  WHEN contains({key_sql("coalesce(text, '')")}, {key_sql('quote')}) THEN 'found' WHEN ref_id % 9 = 8 THEN 'citation_mismatch' ELSE 'approximate' END AS status FROM refs LEFT JOIN documents d ON try_cast(page AS BIGINT) = d.doc_id""")
def g1(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text")
    page = F.when(k % 9 == 0, "x").when(k % 9 == 1, F.lit(None)).when(k % 9 == 2, (k + 9000000).cast("string")).otherwise(k.cast("string"))
    once = lambda at: ~F.contains(F.col("text").substr(F.lit(at + 1), F.length("text")), F.substring("text", at, 12))
    near = F.concat(F.substring("text", 21, 40), F.lit("zq"), F.substring("text", 61, 40))
    quote = F.when(k % 9 == 3, "!?").when(k % 9 == 4, " ").when((k % 9 == 7) & (F.length("text") > 300) & once(21) & once(61), near).when(k % 9 == 8, "☂☃" * 20).otherwise(F.substring("text", 10, 40))
    refs = docs.select(k.alias("ref_id"), page.alias("page"), quote.alias("quote"), F.when(k % 9 == 5, " ").otherwise("n").alias("note"))
    return J.quote_status(refs, docs.withColumnRenamed("doc_id", "page"), note="note", scores=False).select("ref_id", "status")


@query("j8_fuzzy_citation")
def j8(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text")
    quote = F.concat(F.substring("text", 20, 25), F.lit("zq"), F.substring("text", 47, 25))
    refs = docs.select(k.alias("ref_id"), k.cast("string").alias("page"), quote.alias("quote"))
    return J.quote_status(refs, docs.withColumnRenamed("doc_id", "page")).select("ref_id", "status", F.round("score", 4).alias("score"))


_PLACES = ("casa", "maison", "haus", "house", "road")
#: A conversation is a segment whose turns are audited; it cites the documents of its id and the next one.
_AUDIT_SQL = f"""WITH ev AS (SELECT c.conv_id, string_agg(d.text, ' ' ORDER BY d.doc_id) AS evidence FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN documents d ON d.doc_id IN (c.conv_id, c.conv_id + 1) GROUP BY 1),
  c0 AS (SELECT conv_id AS doc_id, text FROM conversations), CLAIMS,
  u AS (SELECT DISTINCT doc_id AS conv_id, t FROM claim), {anchors_sql('u', 't', _PLACES)},
  n AS (SELECT conv_id, t, {key_sql('t')} AS ck, {key_sql("coalesce(evidence, '')")} AS ek, anchors FROM f JOIN ev USING (conv_id)),
  g AS (SELECT *, len(anchors) AS n, len(list_filter(anchors, lambda a: contains(ek, {key_sql('a')}))) AS hits FROM n)
  SELECT conv_id, t AS claim, CASE WHEN ck = '' THEN 'empty' WHEN contains(ek, ck) THEN 'direct' WHEN n = 1 AND hits = 0 THEN 'none' WHEN n = 1 AND length(ck) <= 12 THEN 'anchor'
    WHEN n = 1 THEN 'similar?' WHEN n > 1 AND hits >= (n + 1) // 2 THEN 'anchors' WHEN n > 1 THEN 'none' WHEN length(ck) <= 10 THEN 'short' ELSE 'similar?' END AS support FROM g"""


@query("g2_claim_audit", _AUDIT_SQL.replace("CLAIMS", CLAIMS_SQL.replace("FROM documents", "FROM c0")))
def g2(spark, d):
    """What containment and anchors decide; "similar?" is what claim_support goes on to compare (tests do that on small rows)."""
    turns, docs = table(spark, d, "conversations").select("conv_id", "text"), table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")
    refs = turns.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.col("conv_id"), F.col("conv_id") + 1)).alias("page"))
    evidence = E.evidence_text(refs, docs, "conv_id", "page", "text")
    claims = turns.select("conv_id", F.explode(T.claims(F.col("text"))).alias("claim")).distinct()
    return E.claims_by_anchors(claims, evidence, "conv_id", T.anchors(F.col("claim"), _PLACES), T.plain_key).select("conv_id", "claim", "support")


def audited_segments(spark, d):
    """Conversations as segments: a turn is a field's value (of turns of one field, the last). Each cites two passages of the benchmark as pages."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    value = lambda i: F.max_by(F.when(F.col("turn") % 8 == i, F.col("text")), F.when(F.col("turn") % 8 == i, F.col("turn")))
    segments = turns.groupBy("conv_id").agg(*[value(i).alias(f) for i, f in enumerate(E.AUDITED_FIELDS)])
    pages = table(spark, d, "benchmark").select(F.col("item_id").alias("page"), "text")
    cited = lambda i: (F.col("conv_id") % 40 + i).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), cited(i).alias("page"), F.concat(F.lit("quote "), F.col("terrain").substr(1, 40)).alias("quote"), F.lit("note").alias("note")) for i in (1, 0)]))
    refs = segments.select("conv_id", each.alias("_r")).select("conv_id", "_r.*")
    return segments, refs, pages


@query("g2_field_claims", "WITH w AS (SELECT conv_id, turn % 8 AS field, arg_max(text, turn) AS text FROM conversations GROUP BY ALL), d0 AS (SELECT conv_id * 8 + field AS doc_id, text FROM w), CLAIMS SELECT doc_id // 8 AS conv_id, CAST(doc_id % 8 AS BIGINT) AS field, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM claim GROUP BY doc_id".replace("CLAIMS", CLAIMS_SQL.replace("FROM documents", "FROM d0")))
def g2_fields(spark, d):
    rows = E.field_claims(audited_segments(spark, d)[0], "conv_id")
    number = F.array_position(F.array(*[F.lit(f) for f in E.AUDITED_FIELDS]), F.col("field")) - 1
    return rows.groupBy("conv_id", number.cast("long").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("claim")).cast("long").alias("chars"))


@query("g2_unsupported_claims")
def g2_unsupported(spark, d):
    """Every claim of the eight fields that pages, quotes and notes do not carry; similarity is part of it, so tests hold it against brute force."""
    segments, refs, pages = audited_segments(spark, d)
    names = E.named_places(F.array(*[F.lit(p) for p in _PLACES]))
    found = E.unsupported_claims(segments, refs, pages, "conv_id", "ord", names)
    return found.select("conv_id", "field", F.col("place").cast("long").alias("place"), "claim", F.array_join("anchors", "|").alias("anchors"), "pages")


@query("u8_upsert_refs", "SELECT o_orderkey, concat_ws(',', o_orderpriority, CASE WHEN lower(o_orderstatus) <> lower(o_orderpriority) THEN o_orderstatus END) AS refs FROM orders")
def u8(spark, d):
    one = lambda c: F.array(F.struct(F.col(c).alias("quote")))
    merged = E.add_refs(one("o_orderpriority"), F.concat(one("o_orderstatus"), one("o_orderstatus")), lambda r: F.lower(r["quote"]))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(merged, lambda r: r["quote"]), ",").alias("refs"))


@query("n12_resolve_actions", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN o_orderpriority WHEN o_orderstatus IN ('F', 'P') THEN 'new' ELSE 'not stated' END AS after FROM orders")
def n12(spark, d):
    action = F.when(F.col("o_orderstatus") == "F", "supported_with_new_ref").when(F.col("o_orderstatus") == "P", "rewrite").otherwise("clear")
    return table(spark, d, "orders").select("o_orderkey", E.resolve(action, F.col("o_orderpriority"), F.lit("new"), F.col("o_totalprice") > 100000, "not stated").alias("after"))


@query("f8_partition_refs", "SELECT conv_id, count(*) FILTER (role = 'system') AS chapters, count(*) FILTER (role <> 'system') AS facts FROM conversations GROUP BY conv_id")
def f8(spark, d):
    refs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    a, b = E.partition_refs(F.col("r"), lambda r: r["role"] == "system")
    return refs.select("conv_id", F.size(a).cast("long").alias("chapters"), F.size(b).cast("long").alias("facts"))


@query("g14_reverse_index", "SELECT l_partkey AS anchor, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS questions FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY l_partkey")
def g14(spark, d):
    listed = F.transform(F.array_sort(F.collect_set("l_orderkey")), lambda x: x.cast("string"))
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("anchor")).agg(F.array_join(listed, ",").alias("questions"))


@query("g15_route_index", "SELECT c_nationkey, string_agg(c_name, '|' ORDER BY c_custkey) AS names, min(c_custkey) AS first_order FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def g15(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    return table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.array_join(listed, "|").alias("names"), F.min("c_custkey").alias("first_order"))


@query("g30_strengthen_place", "SELECT n_nationkey, CASE WHEN s.n > 0 THEN 'public' ELSE 'pending' END AS source, coalesce(s.n > 0, FALSE) OR n_nationkey % 2 = 0 AS is_key FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON n_nationkey = s_nationkey WHERE s.n > 0 OR TRUE")
def g30(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, d, "nation").join(rich, "n_nationkey", "left")
    there = F.coalesce(F.col("n") > 0, F.lit(False))
    return j.select("n_nationkey", F.when(there, "public").otherwise("pending").alias("source"), (there | (F.col("n_nationkey") % 2 == 0)).alias("is_key"))


@query("g25_cards", f"SELECT {numbered_sql('letter-', 'row_number() OVER (ORDER BY doc_id)', 4)} AS letter_id, doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), '、') AS hint FROM documents")
def g25(spark, d):
    cards = table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " ", 4), 1, 3), "、").alias("hint"))
    return W.numbered_rows(cards, "_n", ["doc_id"], [F.floor(F.col("doc_id") / W.NUMBERED_TOGETHER)]).select(T.numbered("letter-", F.col("_n"), 4).alias("letter_id"), "doc_id", "hint")


@query("g7_checklist", f"""WITH {SEG} SELECT 'gap' AS family, id FROM s WHERE gap UNION ALL SELECT 'unspecified', id FROM s WHERE prio = '4-NOT SPECIFIED' UNION ALL SELECT 'approximate', id FROM s, (SELECT unnest(ps) AS p, id AS pid FROM s) WHERE pid = id AND p.confidence = 'approximate'""")
def g7(spark, d):
    s = segments(spark, d)
    fam = lambda df, name: df.select(F.lit(name).alias("family"), "id")
    near = s.select("id", F.explode("ps").alias("p")).where("p.confidence = 'approximate'")
    return fam(s.where("gap"), "gap").unionByName(fam(s.where("prio = '4-NOT SPECIFIED'"), "unspecified")).unionByName(fam(near, "approximate"))


# release gates


_F = lambda rule, sev, path, msg, src: f"SELECT '{rule}' AS rule_id, '{sev}' AS severity, CAST({path} AS VARCHAR) AS path, '{msg}' AS message FROM {src}"
FINDINGS_SQL = " UNION ALL ".join([
    _F("C1.order", "error", "l_orderkey || '/' || l_linenumber", "out of order", "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE l_linenumber <> n"),
    _F("C1.quote", "warning", "item_id", "text over 120", "benchmark WHERE length(text) > 120"),
    _F("C2.unique", "error", "sha", "not unique", "(SELECT sha256(text) AS sha, count(*) AS c FROM documents GROUP BY 1) WHERE c > 1"),
    _F("C2.lang", "error", "doc_id", "lang not allowed", "documents WHERE lang NOT IN ('en', 'fr', 'de')"),
    _F("C3.count", "error", "'labels'", "count not in 1..10", "(SELECT count(*) AS n FROM labels) WHERE n NOT BETWEEN 1 AND 10"),
    _F("C6.known", "error", "doc_id", "unknown key", "(SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"),
])


def findings(spark, d):
    docs = table(spark, d, "documents")
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return C.union([
        C.consecutive(li, "C1.order", "l_orderkey", "l_linenumber"),
        C.longest(table(spark, d, "benchmark"), "C1.quote", F.col("item_id"), "text", 120),
        C.unique(docs.select(F.sha2("text", 256).alias("sha")), "C2.unique", "sha"),
        C.allowed(docs, "C2.lang", F.col("doc_id"), "lang", ("en", "fr", "de")),
        C.count_between(table(spark, d, "labels"), "C3.count", "labels", 1, 10),
        C.present(docs.select("doc_id"), table(spark, d, "labels"), "C6.known", "doc_id"),
    ])


query("c_findings", FINDINGS_SQL)(findings)


@query("c16_release_verdict", f"WITH f AS ({FINDINGS_SQL}) SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS passed FROM f")
def c16(spark, d):
    return C.verdict(findings(spark, d))


@query("c8_mirror", "SELECT 'C8' AS rule_id, 'error' AS severity, CAST(n_nationkey AS VARCHAR) AS path, 'not mirrored' AS message FROM nation WHERE n_nationkey % 5 = 0")
def c8(spark, d):
    n = table(spark, d, "nation")
    return C.mirrored(n, n.where("n_nationkey % 5 <> 0"), "C8", F.col("n_nationkey"))


@query("c4_required", "SELECT 'C4' AS rule_id, 'error' AS severity, doc_id || '.ref' AS path, 'required' AS message FROM documents WHERE doc_id % 9 = 0")
def c4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("ref"))
    return C.required(docs, "C4", F.col("doc_id"), ["source", "ref"])
