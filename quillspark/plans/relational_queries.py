"""Filters, joins, aggregations, windows, sorts, sets and arrays, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import aggregates as A
from quillspark.operators import chunks as C
from quillspark.operators import joins as J
from quillspark.operators import windows as W
from quillspark.plans.registry import query, table
from quillspark.plans.text_queries import numbered_sql


def t(name):
    return lambda spark, d: table(spark, d, name)


# filters


@query("f2_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')")
def f2(spark, d):
    q = F.lower(F.trim(F.lit(" BUILD ")))
    return table(spark, d, "customer").where(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), q)).select("c_custkey")


@query("f3_status_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
def f3(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")).select("o_orderkey")


@query("f4_ready_filter", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'public' WHEN s_acctbal > 0 THEN 'pending' ELSE 'none' END AS state FROM supplier WHERE s_acctbal > 0")
def f4(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").where(b > 0).select("s_suppkey", F.when(b > 5000, "public").when(b > 0, "pending").otherwise("none").alias("state"))


@query("f7_range", "SELECT doc_id FROM documents WHERE doc_id BETWEEN 6 AND 30")
def f7(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").between(6, 30)).select("doc_id")


@query("f12_toc_runs", """WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, CASE WHEN regexp_matches(text, '^The') THEN 5 ELSE 0 END + least(len(regexp_extract_all(text, '\\n')), 5) + least(len(regexp_extract_all(text, '\\d+')), 4) AS score FROM documents),
  w AS (SELECT *, page - row_number() OVER (PARTITION BY source ORDER BY page) AS isl FROM s WHERE page <= 60 AND score >= 5),
  m AS (SELECT *, max(CASE WHEN score >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY source, isl ORDER BY page) AS hit FROM w) SELECT source, doc_id FROM m WHERE hit = 1""")
def f12(spark, d):
    """The survey's rule looks at the first 60 pages of a book; a source's documents are its pages here."""
    docs = table(spark, d, "documents")
    first = W.first_rows(docs.select("source", "doc_id"), ["source"], ["doc_id"], 60, "doc_id")
    score = T.toc_score(F.col("text"), "^The", (("\n", 5), (r"\d+", 4)))
    pages = first.withColumn("page", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).join(docs.select("doc_id", score.alias("score")), "doc_id")
    return W.runs_with_start(pages, "page", "score", 8, 5, ["source"]).select("source", "doc_id")


# joins


@query("j1_lookup_inner", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)")
def j1(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("j1_unknown_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j1u(spark, d):
    return J.unknown_keys(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("j2_lookup_default", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 9) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j2(spark, d):
    return J.lookup(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", {"quality": F.lit(-1), "toxic": F.lit(9)})


@query("j3_group_join", """SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def j3(spark, d):
    item = F.struct("l_linenumber", "l_partkey")
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    joined = table(spark, d, "orders").select("o_orderkey").join(parts, "o_orderkey", "left")
    return joined.select("o_orderkey", F.array_join(F.transform("xs", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"), F.coalesce(F.size("xs"), F.lit(0)).cast("long").alias("n"))


@query("s4_last_wins_map", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def s4(spark, d):
    return J.last_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


@query("j5_exact_gazetteer", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j5(spark, d):
    n = table(spark, d, "nation").join(J.small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(J.small(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


_GAZ = """gaz AS (SELECT n_nationkey AS ord, 'Customer#0000000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS entry FROM nation)"""


@query("j6_substring_gazetteer", f"""WITH {_GAZ}, n AS (SELECT DISTINCT c_name AS name FROM customer),
  e AS (SELECT name, (SELECT min(ord) FROM gaz WHERE entry = name) AS o FROM n), x AS (SELECT name, arg_min(entry, ord) AS near FROM n JOIN gaz ON contains(name, entry) OR contains(entry, name) GROUP BY name)
  SELECT name, CASE WHEN o IS NOT NULL THEN name ELSE near END AS entry, CASE WHEN o IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'substring' ELSE 'missing' END AS how FROM e LEFT JOIN x USING (name)""")
def j6(spark, d):
    gaz = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("Customer#0000000"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("entry"))
    return J.gazetteer_match(table(spark, d, "customer").select(F.col("c_name").alias("name")), gaz)


@query("j7_containment", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def j7(spark, d):
    return J.containment(table(spark, d, "benchmark").withColumnRenamed("text", "quote"), table(spark, d, "documents").select("doc_id", "text"), "item_id", "quote", "doc_id", "text")


@query("j9_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j9s(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("j9_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j9a(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti")


@query("j12_template_defaults", "SELECT n_nationkey, coalesce(c.n, 0) AS n, coalesce(c.top, 'none') AS top FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, max(c_mktsegment) AS top FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON n_nationkey = c_nationkey")
def j12(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.max("c_mktsegment").alias("top"))
    return J.lookup(table(spark, d, "nation").select("n_nationkey"), rich, "n_nationkey", {"n": F.lit(0), "top": F.lit("none")}).select("n_nationkey", "n", "top")


@query("j15_placement", "SELECT doc_id, CASE WHEN quality = 1 THEN 'core' WHEN toxic = 1 THEN 'extra' ELSE 'source' END AS placement FROM documents LEFT JOIN labels USING (doc_id)")
def j15(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality") == 1, "core").when(F.col("toxic") == 1, "extra").otherwise("source").alias("placement"))


@query("j16_polymorphic_key", "SELECT e.event_id, CASE WHEN event_type = 'click' THEN c.c_name WHEN event_type = 'error' THEN s.s_name END AS target FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN supplier s ON e.user_id = s.s_suppkey WHERE event_type IN ('click', 'error')")
def j16(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("target"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("target"))
    side = lambda kind, dim: e.where(F.col("event_type") == kind).join(dim, "user_id", "left").select("event_id", "target")
    return side("click", c).unionByName(side("error", s))


# aggregations


@query("a1_group_count", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def a1(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("a2_most_common", "WITH c AS (SELECT source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY source) SELECT *, row_number() OVER (ORDER BY n DESC, first_seen) AS place FROM c")
def a2(spark, d):
    return A.most_common(table(spark, d, "documents"), "source", "doc_id")


@query("a3_zero_filled", "SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def a3(spark, d):
    return A.zero_filled(table(spark, d, "orders"), "o_orderstatus", ("F", "O", "P", "X"))


@query("a4_conditional_counts", "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS high, count(*) FILTER (l_tax = 0) AS untaxed FROM lineitem GROUP BY l_returnflag")
def a4(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("high"), F.count_if(F.col("l_tax") == 0).alias("untaxed"))


_TASKS = """tasks AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'P0' WHEN doc_id % 10 < 8 THEN 'P1' ELSE 'P2' END AS priority, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN CASE WHEN toxic = 1 THEN 'odd' ELSE 'fail' END ELSE '' END AS result FROM documents LEFT JOIN labels USING (doc_id))"""


def tasks(spark, d):
    """Review tasks: documents with their labels as results, blank where there is none."""
    k = F.col("doc_id")
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    result = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "odd").otherwise("fail")).otherwise("")
    return joined.select("doc_id", F.when(k % 10 == 0, "P0").when(k % 10 < 8, "P1").otherwise("P2").alias("priority"), result.alias("result"))


@query("a5_result_pivot", f"""WITH {_TASKS} SELECT p AS priority, count(priority) AS total, count(*) FILTER (priority IS NOT NULL AND result = '') AS blank, count(*) FILTER (result NOT IN ('', 'pass', 'fail', 'deferred')) AS invalid,
  count(*) FILTER (result = 'pass') AS pass, count(*) FILTER (result = 'fail') AS fail, count(*) FILTER (result = 'deferred') AS deferred FROM (VALUES ('P0'), ('P1'), ('P2'), ('P3')) v(p) LEFT JOIN tasks ON priority = p GROUP BY p""")
def a5(spark, d):
    return A.result_pivot(tasks(spark, d), "priority", "result", ("P0", "P1", "P2", "P3"), ("pass", "fail", "deferred"))


@query("a6_coverage", "SELECT count(*) AS total, count(DISTINCT source) AS sources, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS blank FROM documents")
def a6(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("source").alias("sources"), F.count_if(F.col("quality").isNull()).alias("blank"))


@query("a7_min_max_avg", "SELECT source, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total, CAST(floor(avg(n_chars)) AS BIGINT) AS mean FROM documents GROUP BY source")
def a7(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("source").agg(F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"), F.floor(F.avg(n)).cast("long").alias("mean"))


@query("a8_page_stats", f"""SELECT source AS book_id, count(*) AS pages, count(*) FILTER (length(text) = 0) AS empty, count(*) FILTER (length(text) > 0 AND length(text) < 80) AS short, CAST(floor(avg(length(text))) AS BIGINT) AS mean_chars,
  coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (length(text) < 80), '') AS short_pages FROM documents GROUP BY source""")
def a8(spark, d):
    n = F.length("text")
    short = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(n < 80, F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return table(spark, d, "documents").groupBy(F.col("source").alias("book_id")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < 80)).alias("short"), F.floor(F.avg(n)).cast("long").alias("mean_chars"), short.alias("short_pages"))


_WORDS4 = "list_distinct(string_split(text, ' '))"


@query("a9_distinct_exploded", f"SELECT lang, count(DISTINCT w) AS words FROM (SELECT lang, unnest({_WORDS4}) AS w FROM documents) GROUP BY lang")
def a9(spark, d):
    return table(spark, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("w")).groupBy("lang").agg(F.countDistinct("w").alias("words"))


@query("a10_inverted_index", f"""WITH p AS (SELECT unnest({_WORDS4}) AS label, doc_id FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS i FROM p),
  g AS (SELECT label, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (i <= 5) AS refs FROM r GROUP BY label) SELECT label, n, refs, row_number() OVER (ORDER BY n DESC, label) AS place FROM g""")
def a10(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("labels"))
    return A.inverted_index(words, "labels", "doc_id", "doc_id").withColumn("refs", F.array_join(F.transform("refs", lambda x: x.cast("string")), ","))


@query("a11_first_seen_index", "SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) AS c_mktsegment, string_agg(c_name, ',' ORDER BY c_custkey) AS c_name, min(c_custkey) AS first_seen FROM customer GROUP BY c_nationkey")
def a11(spark, d):
    return A.first_seen_index(table(spark, d, "customer"), "c_nationkey", "c_custkey", ["c_mktsegment"], "c_name").withColumn("c_name", F.array_join("c_name", ","))


@query("a12_multi_set_map", """SELECT page, string_agg(DISTINCT seg, ',' ORDER BY seg) AS segs, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (
  SELECT l_suppkey AS page, l_returnflag AS seg, NULL AS kind FROM lineitem UNION ALL SELECT l_suppkey, NULL, l_linestatus FROM lineitem UNION ALL SELECT s_suppkey, NULL, 'supplier' FROM supplier) GROUP BY page""")
def a12(spark, d):
    li, none = table(spark, d, "lineitem"), F.lit(None).cast("string")
    rows = li.select(F.col("l_suppkey").alias("page"), F.col("l_returnflag").alias("seg"), none.alias("kind"))
    rows = rows.unionByName(li.select(F.col("l_suppkey").alias("page"), none.alias("seg"), F.col("l_linestatus").alias("kind")))
    rows = rows.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), none.alias("seg"), F.lit("supplier").alias("kind")))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("page").agg(F.nullif(listed("seg"), F.lit("")).alias("segs"), listed("kind").alias("kinds"))


@query("a14_status_roll_up", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_discount > 0.08) THEN 'fail' WHEN bool_or(l_returnflag = 'R') OR max(l_tax) > 0.07 THEN 'warning' ELSE 'pass' END AS status FROM lineitem GROUP BY l_orderkey")
def a14(spark, d):
    r = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(A.roll_up(F.bool_or(r & (F.col("l_discount") > 0.08)), F.bool_or(r) | (F.max("l_tax") > 0.07)).alias("status"))


@query("a15_readiness", f"""WITH {_TASKS}, r AS (SELECT bool_or(priority = 'P0' AND result = '') AS a, bool_or(result NOT IN ('', 'pass', 'fail')) AS b, bool_or(priority = 'P9') AS c FROM tasks)
  SELECT NOT (a OR b OR c) AS ready, concat_ws('|', CASE WHEN a THEN 'p0 blank' END, CASE WHEN b THEN 'invalid result' END, CASE WHEN c THEN 'unknown priority' END) AS blockers FROM r""")
def a15(spark, d):
    r, p = F.col("result"), F.col("priority")
    return A.blockers(tasks(spark, d), {"p0 blank": (p == "P0") & (r == ""), "invalid result": ~r.isin("", "pass", "fail"), "unknown priority": p == "P9"})


@query("a18_dashboard_stats", "SELECT count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 300000) AS dear, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) AS n FROM orders")
def a18(spark, d):
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 300000).alias("dear"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count(F.lit(1)).alias("n"))


@query("a20_severity_counts", "SELECT CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM labels GROUP BY 1")
def a20(spark, d):
    s = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("info")
    return table(spark, d, "labels").groupBy(s.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("a21_length_gap", "SELECT (SELECT avg(length(text)) FROM documents) >= greatest(90, (SELECT avg(length(text)) FROM benchmark) + 35) AS wide_enough")
def a21(spark, d):
    mean = lambda n, c: table(spark, d, n).agg(F.avg(F.length("text")).alias(c))
    return mean("documents", "a").crossJoin(mean("benchmark", "b")).select((F.col("a") >= F.greatest(F.lit(90.0), F.col("b") + 35)).alias("wide_enough"))


@query("a22_suitability", "SELECT source, count(*) BETWEEN 5 AND 60 AND count(*) FILTER (n_chars < 40) < 50 AS suitable FROM documents GROUP BY source")
def a22(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "documents").groupBy("source").agg(((n >= 5) & (n <= 60) & (F.count_if(F.col("n_chars") < 40) < 50)).alias("suitable"))


# windows


@query("w1_ordinal", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents")
def w1(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("page"))


@query("w2_navigation", """SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(lag(turn) OVER w AS BIGINT) AS previous, CAST(lead(turn) OVER w AS BIGINT) AS following, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w2(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"))
    return W.navigation(c, ["conv_id"], "turn", "turn").select("conv_id", "turn", "previous", "following", "position", "total")


@query("w3_fixed_bucket", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(least((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2, 2) AS BIGINT) AS bucket FROM conversations")
def w3(spark, d):
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), W.fixed_bucket(rank, 2, 3).alias("bucket"))


_FOLD = r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]+|[\s\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
  f AS (SELECT doc_id, 0 AS i, 0 AS chunk, 0 AS n, CAST(0 AS BIGINT) AS size FROM p UNION ALL
        SELECT f.doc_id, i + 1, CASE WHEN n > 0 AND size + length(ps[i + 1]) > 1200 THEN chunk + 1 ELSE chunk END, CASE WHEN n > 0 AND size + length(ps[i + 1]) > 1200 THEN 1 ELSE n + 1 END,
          CASE WHEN n > 0 AND size + length(ps[i + 1]) > 1200 THEN length(ps[i + 1]) ELSE size + length(ps[i + 1]) END FROM f JOIN p USING (doc_id) WHERE i < len(ps))"""


@query("w5_chunk_per_doc", _FOLD + """ SELECT doc_id, CAST(chunk + 1 AS BIGINT) AS chunk, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS text FROM f JOIN p USING (doc_id) WHERE i > 0 GROUP BY doc_id, chunk""")
def w5(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(W.chunk_plain(T.paragraphs(F.col("text"), "\n"), 1200)).alias("i", "text"))
    return chunks.select("doc_id", (F.col("i") + 1).cast("long").alias("chunk"), "text")


_ACROSS = _FOLD.split("p AS (SELECT doc_id,")[1].split(" AS ps FROM documents")[0]


@query("w4_chunk_across_pages", f"""WITH RECURSIVE d AS (SELECT source, doc_id,{_ACROSS} AS ps FROM documents), u AS (SELECT source, doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS k, length(p) AS s FROM u), b AS (SELECT source, list(s ORDER BY k) AS ss FROM r GROUP BY source),
  f AS (SELECT source, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS n FROM b UNION ALL
        SELECT source, k + 1, CASE WHEN ss[k + 1] <= 3500 AND n > 0 AND n + ss[k + 1] + 2 <= 3500 THEN last ELSE last + 1 END, CASE WHEN ss[k + 1] > 3500 THEN last + (ss[k + 1] + 3499) // 3500 WHEN n > 0 AND n + ss[k + 1] + 2 <= 3500 THEN last ELSE last + 1 END,
          CASE WHEN ss[k + 1] > 3500 THEN 0 WHEN n > 0 AND n + ss[k + 1] + 2 <= 3500 THEN n + ss[k + 1] + 2 ELSE ss[k + 1] END FROM f JOIN b USING (source) WHERE k < len(ss)),
  c AS (SELECT source, k, doc_id, no, p, unnest(range((s + 3499) // 3500)) AS cut FROM f JOIN r USING (source, k)),
  t AS (SELECT source, no + cut AS chunk, min(doc_id) AS first_page, max(doc_id) AS last_page, string_agg(substr(p, cut * 3500 + 1, 3500), chr(10) || chr(10) ORDER BY k) AS text FROM c GROUP BY ALL)
  SELECT source, {numbered_sql('chunk-', 'chunk', 4)} AS chunk_id, first_page, last_page, length(text) AS char_count, sha256(text) AS text_sha FROM t""")
def w4(spark, d):
    pages = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), T.paragraphs(F.col("text"), "\n").alias("parts"))
    chunks = C.pages_chunked(pages, 3500)
    return chunks.select(F.col("book").alias("source"), T.numbered("chunk-", F.col("chunk"), 4).alias("chunk_id"), "first_page", "last_page", F.length("text").cast("long").alias("char_count"), F.sha2("text", 256).alias("text_sha"))


@query("w7_keep_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY text")
def w7(spark, d):
    return W.keep_first(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), ["sha"], ["doc_id"])


@query("w8_duplicates_in_order", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i FROM documents) WHERE i > 1")
def w8(spark, d):
    return W.duplicates_in_order(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), ["sha"], ["doc_id"]).select("doc_id")


@query("w14_sample_rows", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) WHERE i IN (0, 6, 12, 18, 24)")
def w14(spark, d):
    first = W.first_rows(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 25, "doc_id")
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return first.select("source", "doc_id", i.alias("i")).where(F.col("i").isin(0, 6, 12, 18, 24)).select("source", "doc_id")


@query("w15_nth_alias", f"WITH {_TASKS}, n AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY doc_id) AS i FROM tasks) SELECT priority || {numbered_sql('-', 'i', 3)} AS alias, doc_id FROM n")
def w15(spark, d):
    n = F.row_number().over(Window.partitionBy("priority").orderBy("doc_id"))
    return tasks(spark, d).select(F.concat("priority", T.numbered("-", n, 3)).alias("alias"), "doc_id")


@query("w16_out_of_order", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, expected FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS expected FROM lineitem) WHERE l_linenumber <> expected")
def w16(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return W.out_of_order(li, ["l_orderkey"], "l_linenumber")


@query("w17_role_by_place", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN n = 1 THEN 'core' WHEN i = 1 THEN 'start' WHEN i = n THEN 'end' ELSE 'via' END AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def w17(spark, d):
    w = Window.partitionBy("conv_id")
    i, n = F.row_number().over(w.orderBy("turn")) - 1, F.count(F.lit(1)).over(w)
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), W.role_by_place(i, n).alias("place"))


_KIND = "CASE WHEN l_returnflag = 'R' THEN 'back' WHEN l_discount > 0.07 THEN 'cheap' WHEN l_quantity > 40 THEN 'bulk' ELSE 'plain' END"


@query("w9_diversified_top_k", f"""WITH c AS (SELECT l_suppkey AS part, {_KIND} AS kind, CAST(l_quantity AS BIGINT) AS score, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS ord FROM lineitem),
  b AS (SELECT *, row_number() OVER (PARTITION BY part, kind ORDER BY score DESC, ord) AS best FROM c),
  u AS (SELECT *, CASE WHEN best = 1 AND kind <> 'plain' THEN list_position(['back', 'cheap', 'bulk'], kind) ELSE 4 END AS turn FROM b),
  r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY turn, CASE WHEN turn > 3 THEN -score END NULLS FIRST, ord) AS place FROM u) SELECT part, kind, score, ord, place FROM r WHERE place <= 5""")
def w9(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "back").when(F.col("l_discount") > 0.07, "cheap").when(F.col("l_quantity") > 40, "bulk").otherwise("plain")
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("part"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("score"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"))
    return W.diversified(c, ["part"], "kind", ("back", "cheap", "bulk"), "score", "ord", 5).select("part", "kind", "score", "ord", "place")


# sorts, limits, sets


@query("o2_custom_rank", "SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, source, doc_id) AS place FROM documents")
def o2(spark, d):
    rank = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "de", 1).otherwise(2)
    ranked = table(spark, d, "documents").select("doc_id", "source", rank.alias("rank"))
    return W.numbered_rows(ranked, "place", ["rank", "source", "doc_id"], [F.col("rank"), F.col("source"), F.floor(F.col("doc_id") / W.NUMBERED_TOGETHER)]).select("doc_id", "place")


@query("o3_first_element_sort", "SELECT doc_id, coalesce(try_cast(string_split(text, ' ')[1] AS BIGINT), 999) AS first FROM documents")
def o3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.try_element_at(F.split("text", " "), F.lit(1)).try_cast("long"), F.lit(999)).alias("first"))


@query("o4_numeric_suffix", "SELECT source, coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS BIGINT), 0) AS suffix, count(*) AS n FROM documents GROUP BY 1, 2")
def o4(spark, d):
    suffix = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    return table(spark, d, "documents").groupBy("source", suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query("o5_longest_first", "SELECT DISTINCT p_name, CAST(length(p_name) AS BIGINT) AS n FROM part ORDER BY n DESC, p_name LIMIT 20")
def o5(spark, d):
    return table(spark, d, "part").select("p_name", F.length("p_name").cast("long").alias("n")).distinct().orderBy(F.desc("n"), "p_name").limit(20)


@query("u1_union_families", "SELECT 'fixed' AS family, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 'sample', c_custkey FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT 'label', doc_id FROM labels WHERE toxic = 1")
def u1(spark, d):
    fam = lambda df, name, c: df.select(F.lit(name).alias("family"), F.col(c).cast("long").alias("id"))
    return fam(table(spark, d, "nation"), "fixed", "n_nationkey").unionByName(fam(table(spark, d, "customer").where("c_custkey % 100 = 0"), "sample", "c_custkey")).unionByName(fam(table(spark, d, "labels").where("toxic = 1"), "label", "doc_id"))


@query("u2_difference", "SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def u2(spark, d):
    return table(spark, d, "customer").select("c_nationkey").subtract(table(spark, d, "supplier").select("s_nationkey"))


@query("u2_unlabelled", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u2_unlabelled(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("u5_ordered_distinct", "SELECT conv_id, string_agg(role, '|' ORDER BY t DESC) AS roles FROM (SELECT conv_id, role, max(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def u5(spark, d):
    """The roles of a conversation, read from its end."""
    turns = table(spark, d, "conversations").select("conv_id", "role", (-F.col("turn")).alias("back"))
    return A.ordered_distinct(turns, ["conv_id"], "role", "back", "roles").withColumn("roles", F.array_join("roles", "|"))


@query("u3_intersection", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u3(spark, d):
    return table(spark, d, "customer").select("c_nationkey").intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("u4_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u4(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u6_ordered_equality", "SELECT conv_id, array_to_string(list(turn ORDER BY turn), ',') = array_to_string(range(count(*)), ',') AS covered FROM conversations GROUP BY conv_id")
def u6(spark, d):
    listed = F.array_sort(F.collect_list(F.col("turn").cast("long")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(listed.alias("x")).select("conv_id", (F.col("x") == F.sequence(F.lit(0).cast("long"), F.size("x").cast("long") - 1)).alias("covered"))


@query("u9_difference_keeps_repeats", "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w NOT IN ('the', 'of', 'de')), ' ') AS rest FROM documents")
def u9(spark, d):
    drop = F.array(*[F.lit(w) for w in ("the", "of", "de")])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(F.split("text", " "), lambda w: ~F.array_contains(drop, w)), " ").alias("rest"))


# arrays and JSON


@query("n1_posexplode", "SELECT conv_id, turn::BIGINT AS turn, i - 1 AS i, ws[i] AS w FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations)")
def n1(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.posexplode(F.split("text", " ")).alias("i", "w")).withColumn("i", F.col("i").cast("long"))


@query("n4_json_blob_scan", "SELECT event_id, contains(props, '\"k\": 6') AS hit FROM events")
def n4(spark, d):
    return table(spark, d, "events").select("event_id", F.contains("props", F.lit('"k": 6')).alias("hit"))


@query("n7_stable_merge", "SELECT doc_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS merged FROM (SELECT doc_id, ['the', source, 'de'] AS a, string_split(text, ' ') AS b FROM documents)")
def n7(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.array(F.lit("the"), F.col("source"), F.lit("de")).alias("a"), F.split("text", " ").alias("b"))
    return s.select("doc_id", F.array_join(F.concat("a", F.filter("b", lambda x: ~F.array_contains(F.col("a"), x))), " ").alias("merged"))


@query("n9_sorted_set", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def n9(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("n10_sorted_map", "SELECT o_custkey, string_agg(s || '=' || n, ',' ORDER BY s) AS counts FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def n10(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.map_entries(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n")))))
    return c.groupBy("o_custkey").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("n11_enum_merge", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'O' END AS merged, o_orderstatus NOT IN ('F', 'O') AS changed FROM orders")
def n11(spark, d):
    valid = F.col("o_orderstatus").isin("F", "O")
    return table(spark, d, "orders").select("o_orderkey", F.when(valid, F.col("o_orderstatus")).otherwise(F.lit("O")).alias("merged"), (~valid).alias("changed"))


@query("json_key_value", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jkv(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("event_window_counts", "SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ev(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


@query("nav_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages) SELECT page_id, href, label FROM l WHERE label <> '' AND length(label) <= 200""")
def nav(spark, d):
    got = lambda i: F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(i))
    links = table(spark, d, "pages").select("page_id", F.explode(F.arrays_zip(got(1).alias("href"), got(2).alias("label"))).alias("x"))
    return links.select("page_id", "x.href", "x.label").where((F.col("label") != "") & (F.length("label") <= 200))
