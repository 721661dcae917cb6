"""Excerpt choice, walks through JSON, rule and cascade joins, identity: each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.identity import identity
from quillspark.operators import books as B
from quillspark.operators import joins as J
from quillspark.operators import selection as S
from quillspark.operators import walks as K
from quillspark.plans.registry import query, table
from quillspark.plans.relational_queries import _KIND
from quillspark.plans.text_queries import count_sql, squash_sql, strip_sql

# roles, scores, choice

_RULES = (("asks", "[?]"), ("place", None), ("lists", ",.*,"))


@query("w11_roles", """SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN i = 0 THEN 'opening_scene' WHEN i >= n - 2 THEN 'closing_moment' WHEN regexp_matches(text, '[?]') THEN 'asks'
    WHEN contains(text, 'the') OR contains(text, 'und') THEN 'place' WHEN regexp_matches(text, ',.*,') THEN 'lists' ELSE 'other' END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def w11(spark, d):
    w = Window.partitionBy("conv_id")
    i, n = F.row_number().over(w.orderBy("turn")) - 1, F.count(F.lit(1)).over(w)
    named = S.names_any(F.col("text"), F.array(F.lit("the"), F.lit("und"), F.lit("")))
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text", i.alias("i"), n.alias("n"))
    return turns.select("conv_id", "turn", S.role_of(F.col("text"), named, F.col("i"), F.col("n"), _RULES, last=2).alias("role"))


@query("w12_scores", "SELECT doc_id, CAST(least(length(text), 120) + CASE WHEN contains(text, 'the') THEN 45 ELSE 0 END + CASE WHEN regexp_matches(text, '[?]') THEN 35 ELSE 0 END - CASE WHEN lang = 'de' THEN 200 ELSE 0 END AS BIGINT) AS score FROM documents")
def w12(spark, d):
    t = F.col("text")
    gains = ((S.names_any(t, F.array(F.lit("the"))), 45), (t.rlike("[?]"), 35), (F.col("lang") == "de", -200))
    return table(spark, d, "documents").select("doc_id", S.score_of(t, 120, gains).cast("long").alias("score"))


@query("w10_reading_blocks", f"""WITH c AS (SELECT l_suppkey AS part, {_KIND} AS role, 'T' || (l_partkey % 13) AS text, CAST(l_quantity AS BIGINT) AS score, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS ord FROM lineitem),
  t AS (SELECT *, list_position(['back', 'cheap', 'bulk'], role) AS turn FROM c WHERE role <> 'plain' UNION ALL SELECT *, 4 AS turn FROM c),
  g AS (SELECT part, list({{'turn': turn, 'text': text, 'role': role, 'score': score, 'ord': ord}} ORDER BY turn, score DESC, ord) AS tries FROM t GROUP BY part),
  f AS (SELECT part, list_reduce(tries, lambda a, x: CASE WHEN len(a.taken) < 5 AND (x.turn = 4 OR x.turn <> a.turn) AND NOT list_contains(list_transform(a.taken, lambda y: y.text), x.text)
      THEN {{'taken': list_append(a.taken, x), 'turn': x.turn}} ELSE a END, {{'taken': tries[1:0], 'turn': tries[1].turn - 9}}).taken AS taken FROM g),
  u AS (SELECT part, unnest(taken) AS x FROM f)
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY x.ord) AS place, x.text AS text, x.role AS role, x.score AS score, x.ord AS ord FROM u""")
def w10(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "back").when(F.col("l_discount") > 0.07, "cheap").when(F.col("l_quantity") > 40, "bulk").otherwise("plain")
    ord_ = F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("part"), kind.alias("role"), F.concat(F.lit("T"), (F.col("l_partkey") % 13).cast("string")).alias("text"), F.col("l_quantity").cast("long").alias("score"), ord_.alias("ord"))
    return S.choose(rows, ["part"], "text", "role", "score", "ord", ("back", "cheap", "bulk"), 5, by_order=True)


@query("g9_excerpts_around", """WITH p AS (SELECT doc_id, text, list_filter(['eau', 'the', 'und', 'zz'], lambda w: contains(text, w)) AS ws FROM documents),
  s AS (SELECT doc_id, text, list_transform(ws, lambda w: substr(substr(text, greatest(strpos(text, w) - 10, 1), least(strpos(text, w) - 1, 10) + length(w) + 16), 1, 42)) AS xs FROM p),
  k AS (SELECT doc_id, text, list_filter(xs, lambda x, i: list_position(xs, x) = i)[1:2] AS xs FROM s) SELECT doc_id, CASE WHEN len(xs) > 0 THEN array_to_string(xs, '¶') ELSE substr(text, 1, 28) END AS found FROM k""")
def g9(spark, d):
    probes = F.array(*[F.lit(w) for w in ("eau", "the", "", "und", "zz")])
    return table(spark, d, "documents").select("doc_id", F.array_join(S.excerpts_around(F.col("text"), probes, F.col("text")), "¶").alias("found"))


@query("g19_filled_clues", """SELECT p_partkey, array_to_string(list_reduce([p_brand, p_name, p_type, 'part', p_name || '!'], lambda a, x: CASE WHEN len(a) < 4 AND NOT list_contains(a, x) THEN list_append(a, x) ELSE a END,
    CASE WHEN p_size % 3 = 0 THEN [p_name, p_name] WHEN p_size % 3 = 1 THEN [p_type, 'part'] ELSE ['a', 'b', 'c', 'd', 'e'] END)[1:4], '|') AS clues FROM part""")
def g19(spark, d):
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size")
    there = F.when(size % 3 == 0, F.array(name, name)).when(size % 3 == 1, F.array(kind, F.lit("part"))).otherwise(F.array(*[F.lit(c) for c in "abcde"]))
    spare = F.array(F.col("p_brand"), name, kind, F.lit("part"), F.concat(name, F.lit("!")))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.filled(there, spare, lambda x: x, 4), "|").alias("clues"))


@query("u7_append_unique", "SELECT p_partkey, p_name || '|' || p_name || CASE WHEN p_name = 'cold widget' THEN '' ELSE '|cold widget' END AS items FROM part")
def u7(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.appended(F.array(name, name), F.lit("cold widget")), "|").alias("items"))


# walks through JSON

_JSON = """'{"name":"' || c_name || '","refs":[{"page":' || c_nationkey || ',"quote":"' || c_mktsegment || '"},{"page":1}],"deep":{"page":"x","quote":null,"more":[["a",{"quote":"q","page":[1,2]}],3.5,true]}}'"""


def _json(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", f"{_JSON} AS j")


@query("n3_json_strings", f"""WITH c AS (SELECT c_custkey, CAST({_JSON} AS JSON) AS j FROM customer)
  SELECT c_custkey, t.fullkey AS path, t.atom ->> '$' AS value FROM c, json_tree(c.j) t WHERE t.type = 'VARCHAR'""")
def n3(spark, d):
    return K.json_strings(_json(spark, d), "c_custkey", "j").select("c_custkey", "path", "value")


@query("n2_json_objects", f"""WITH c AS (SELECT c_custkey, CAST({_JSON} AS JSON) AS j FROM customer)
  SELECT c_custkey, t.fullkey AS path, t.value ->> '$.page' AS page, t.value ->> '$.quote' AS quote FROM c, json_tree(c.j) t WHERE t.type = 'OBJECT' AND json_exists(t.value, '$.page') AND json_exists(t.value, '$.quote')""")
def n2(spark, d):
    return K.json_objects(_json(spark, d), "c_custkey", "j", ("page", "quote")).select("c_custkey", "path", "page", "quote")


# joins


@query("j10_by_array_key", "WITH m AS (SELECT l_partkey AS p_partkey, max(l_orderkey) AS block FROM lineitem GROUP BY 1) SELECT p_partkey, block, o_orderstatus AS status FROM part LEFT JOIN m USING (p_partkey) LEFT JOIN orders ON block = o_orderkey")
def j10(spark, d):
    members = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("block")).agg(F.collect_set("l_partkey").alias("members"))
    blocks = table(spark, d, "orders").select(F.col("o_orderkey").alias("block"), F.col("o_orderstatus").alias("status")).join(members, "block").withColumn("ord", F.col("block"))
    return J.by_array_key(table(spark, d, "part").select("p_partkey"), "p_partkey", blocks, "members", "ord").select("p_partkey", "block", "status")


@query("j11_memberships", """SELECT DISTINCT l_orderkey AS o_orderkey, s_suppkey FROM (SELECT l_orderkey, l_suppkey AS s_suppkey FROM lineitem UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') JOIN supplier USING (s_suppkey)""")
def j11(spark, d):
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_suppkey").alias("a"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("b"))
    return J.memberships(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", lists, ["a", "b"]).select("o_orderkey", "s_suppkey")


@query("j13_by_rule", """WITH r AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][r_regionkey + 1] AS prio, CASE WHEN r_regionkey % 2 = 0 THEN 'F' ELSE 'O' END AS status, r_name AS action, CASE WHEN r_regionkey <> 2 THEN 'n' || r_regionkey END AS note, TRUE AS hit FROM region)
  SELECT o_orderkey, CASE WHEN hit THEN action ELSE 'keep' END AS action, CASE WHEN hit THEN note ELSE 'none' END AS note FROM orders LEFT JOIN r ON prio = o_orderpriority AND status = o_orderstatus""")
def j13(spark, d):
    names = F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    k = F.col("r_regionkey")
    rules = table(spark, d, "region").select(F.get(names, k.cast("int")).alias("o_orderpriority"), F.when(k % 2 == 0, "F").otherwise("O").alias("o_orderstatus"), F.col("r_name").alias("action"), F.when(k != 2, F.concat(F.lit("n"), k.cast("string"))).alias("note"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return J.by_rule(orders, rules, ["o_orderpriority", "o_orderstatus"], {"action": F.lit("keep"), "note": F.lit("none")}).select("o_orderkey", "action", "note")


#: Questions of the benchmark tables: an order asks about the letter of its customer and links two more.
_QUESTIONS = """q AS (SELECT 'Q-' || printf('%03d', o_orderkey) AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN 'L' || (o_custkey * 7) END AS letter_id,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['L' || (o_custkey * 5), 'L' || (o_custkey * 3 + 1)] END AS linked, CASE WHEN o_orderstatus = 'F' THEN 'letter' ELSE 'book' END AS scope, o_orderkey AS ord FROM orders),
  ch AS (SELECT c_custkey AS chapter_id, CASE WHEN c_custkey % 11 > 0 THEN 'L' || c_custkey END AS letter_id, c_custkey AS number, c_mktsegment AS position_label, c_custkey - 1 AS previous, c_custkey AS ord FROM customer)"""


def _questions(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    letter = lambda n: F.concat(F.lit("L"), n.cast("string"))
    linked = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(letter(c * 5), letter(c * 3 + 1)))
    return table(spark, d, "orders").select(T.numbered("Q-", k, 3).alias("question_id"), F.when(k % 3 == 0, letter(c * 7)).alias("letter_id"), linked.alias("linked"), F.when(F.col("o_orderstatus") == "F", "letter").otherwise("book").alias("scope"), k.alias("ord"))


def _chapters(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("chapter_id"), F.when(k % 11 > 0, F.concat(F.lit("L"), k.cast("string"))).alias("letter_id"), k.alias("number"), F.col("c_mktsegment").alias("position_label"), (k - 1).alias("previous"), k.alias("ord"))


@query("j14_question_of", f"""WITH {_QUESTIONS}, own AS (SELECT letter_id, question_id, ord FROM q UNION ALL SELECT unnest(linked), question_id, ord FROM q WHERE scope = 'letter'),
  f AS (SELECT letter_id, arg_min(question_id, ord) AS own FROM own GROUP BY 1), e AS (SELECT chapter_id, letter_id, printf('%03d', number) AS ending FROM ch),
  n AS (SELECT chapter_id, arg_min(question_id, ord) AS numbered FROM e JOIN q ON question_id LIKE '%' || ending GROUP BY 1)
  SELECT e.chapter_id, coalesce(own, numbered) AS question_id FROM e LEFT JOIN f ON e.letter_id IS NOT DISTINCT FROM f.letter_id LEFT JOIN n ON e.chapter_id = n.chapter_id""")
def j14(spark, d):
    return J.question_of(_chapters(spark, d), _questions(spark, d))


@query("j17_navigation", f"""WITH {_QUESTIONS}, a AS (SELECT question_id, coalesce(letter_id, linked[1]) AS asked FROM q)
  SELECT question_id, letter_id, previous, CASE WHEN letter_id IS NULL THEN 'whole' ELSE position_label END AS position_label FROM a LEFT JOIN ch ON asked = letter_id""")
def j17(spark, d):
    found = J.navigation_of(_questions(spark, d).select("question_id", "letter_id", "linked"), _chapters(spark, d), ["previous", "position_label"], "position_label", "whole")
    return found.select("question_id", "letter_id", "previous", "position_label")


# identity

_HEAD = "CASE doc_id % 5 WHEN 0 THEN '远行/张三 著' || chr(10) || '北京：人民出版社，2001.5' || chr(10) || 'ISBN 978-7-1234-5678-9' || chr(10) WHEN 1 THEN '# Name ' || source || ' OCR 文本' || chr(10) || '李四 — 著' || chr(10) WHEN 2 THEN 'ISBN 12' || chr(10) || '上海文艺出版社' || chr(10) ELSE '' END || text"
_HAN = "[\\x{4e00}-\\x{9fff}·]"


#: The identity of documents as books, by the heads above: m has what was found, _TOLD names it.
_FOUND = f"""x AS (SELECT doc_id, {_HEAD} AS raw FROM documents), l AS (SELECT doc_id, raw, list_filter(list_transform(regexp_split_to_array(raw, '[\\r\\n]+'), lambda s: {strip_sql('s')}), lambda s: s <> '') AS ls FROM x),
  j AS (SELECT *, array_to_string(ls, chr(10)) AS t, list_transform(ls, lambda s: {squash_sql("replace(s, 'OCR 文本', '')")}) AS cs FROM l),
  m AS (SELECT *, nullif(regexp_extract(t, '([^\\n/]{{2,100}})/({_HAN}{{2,12}})\\s*著', 1), '') AS first, nullif(regexp_extract(raw, '(?m)^#\\s*(.+?)\\s+OCR\\s*文本', 1), '') AS heading,
    list_filter(cs[1:20], lambda c: length(c) BETWEEN 2 AND 50 AND NOT regexp_matches(c, 'ISBN|出版社|NEWSTAR|定价|上架建议'))[1] AS line, list_filter(ls[1:80], lambda s: regexp_matches(s, '^{_HAN}{{2,12}}\\s*[—\\-－]*\\s*著$'))[1] AS signed,
    nullif(regexp_extract(t, '[\\x{{4e00}}-\\x{{9fff}}]{{2,12}}[：:]\\s*([^，,\\n]{{2,40}}出版社)[，,]\\s*\\d{{4}}(?:\\.\\d+)?', 1), '') AS press, nullif(regexp_extract(t, '[\\x{{4e00}}-\\x{{9fff}}]{{2,12}}[：:]\\s*[^，,\\n]{{2,40}}出版社[，,]\\s*(\\d{{4}}(?:\\.\\d+)?)', 1), '') AS day FROM j)"""
_TOLD = f"""coalesce(first, heading, line, 'none') AS title, coalesce(nullif(regexp_extract(t, '[^\\n/]{{2,100}}/({_HAN}{{2,12}})\\s*著', 1), ''), nullif(regexp_extract(signed, '^({_HAN}{{2,12}})', 1), '')) AS author,
    coalesce(press, nullif(regexp_extract(t, '[\\x{{4e00}}-\\x{{9fff}}]{{2,30}}出版社'), '')) AS publisher, day AS publication_date, nullif(regexp_extract(t, 'ISBN\\s*([0-9\\-]{{10,20}})', 1), '') AS isbn"""


@query("t24_identity", f"WITH {_FOUND} SELECT doc_id, {_TOLD} FROM m")
def t24(spark, d):
    book = table(spark, d, "documents").selectExpr("doc_id", f"{_HEAD} AS raw").select("doc_id", identity(F.col("raw"), F.lit("none")).alias("x"))
    return book.select("doc_id", "x.title", "x.author", "x.publisher", "x.publication_date", "x.isbn")


def _occurs(word: str) -> str:
    return f"(length(raw) - length(replace(raw, '{word}', ''))) // {len(word)}"


_WORDS = {"route": (("tion", 3), ("ing", 1)), "letters": (("lich", 3), ("und", 1))}


@query("g21_book_summary", f"""WITH {_FOUND}, t AS (SELECT m.doc_id, {_TOLD} FROM m), b AS (SELECT x.doc_id, raw, d.text, lang, source FROM x JOIN documents d USING (doc_id)),
  h AS (SELECT b.*, doc_id % 3 = 0 AS opf, CASE WHEN length(t.title) <= 8 AND NOT contains(t.title, lang || '!') THEN lang || '!' WHEN t.title = 'none' THEN lang || '!' ELSE t.title END AS found, t.author AS by_line, t.publisher AS press, t.isbn AS num FROM b JOIN t USING (doc_id)),
  r AS (SELECT doc_id, CASE WHEN opf THEN source ELSE found END AS title, CASE WHEN opf THEN CASE WHEN doc_id % 2 = 0 THEN lang END ELSE by_line END AS author, CASE WHEN NOT opf THEN press END AS publisher, CASE WHEN opf THEN 'id' || doc_id ELSE num END AS isbn, raw,
    CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_scanned_likely, CASE WHEN doc_id % 4 < 2 THEN 12 ELSE 1 END AS total_pages FROM h),
  y AS (SELECT *, {count_sql("substr(raw, 1, 200000)", "[\\x{4e00}-\\x{9fff}]")} AS cjk, {count_sql("substr(raw, 1, 200000)", "[A-Za-z]")} AS lat, {_occurs('tion')} * 3 + {_occurs('ing')} AS a, {_occurs('lich')} * 3 + {_occurs('und')} AS b FROM r)
  SELECT doc_id, CASE WHEN title IS NOT NULL AND author IS NOT NULL THEN 'identified' ELSE 'partial' END AS identity_status, title, author, publisher, isbn, is_scanned_likely, total_pages,
    CASE doc_id % 4 WHEN 0 THEN 'scanned_pdf' WHEN 2 THEN 'epub' ELSE CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'pdf' END END AS source_type, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 2 END AS chapter_candidates, round_even(CAST(length(raw) AS DOUBLE), 2) AS average_chars, CASE WHEN doc_id % 7 = 0 THEN '1' ELSE '' END AS review,
    CASE WHEN cjk + lat = 0 THEN 'unknown' WHEN cjk > 0.7 * (cjk + lat) THEN 'zh-Hans' WHEN lat > 0.7 * (cjk + lat) THEN 'en' ELSE 'mixed' END AS language,
    concat_ws('|', CASE WHEN a > b AND a >= 50 THEN 'route' WHEN b >= a AND b >= 50 THEN 'letters' END, CASE WHEN b >= a AND a >= greatest(50, floor(0.08 * b)) THEN 'route' WHEN a > b AND b >= greatest(50, floor(0.08 * a)) THEN 'letters' END) AS types FROM y""")
def g21(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").selectExpr("doc_id", "lang", "source", f"{_HEAD} AS raw")
    none = F.lit(None).cast("string")
    opf = F.when(k % 3 == 0, F.struct(F.col("source").alias("title"), F.when(k % 2 == 0, F.col("lang")).alias("creator"), none.alias("language"), F.lit("").alias("publisher"), none.alias("date"), F.concat(F.lit("id"), k.cast("string")).alias("identifier"), none.alias("description")))
    page = F.struct(F.lit(1).cast("long").alias("page"), F.col("raw").alias("text"), F.length("raw").cast("long").alias("char_count"), (k % 7 == 0).alias("needs_review"))
    pdf = F.when(k % 4 < 2, F.array_repeat(F.when(k % 4 == 0, 29).otherwise(30), 12))
    titles = F.when(k % 4 != 3, F.array(F.lit("one"), F.lit(" "), none, F.lit("two")))
    made = rows.select("doc_id", F.concat("lang", F.lit("!")).alias("title"), F.col("raw").alias("text"), F.array(page).alias("pages"), opf.alias("metadata"), titles.alias("chapters"), F.when(k % 5 != 0, "pdf").alias("source_type"), pdf.alias("pdf_chars"), (k % 4 == 2).alias("epub"))
    s = B.summaries(made, "doc_id", _WORDS)
    return s.select("doc_id", "identity_status", "title", "author", "publisher", "isbn", "is_scanned_likely", "total_pages", "source_type", "chapter_candidates", F.col("ocr_status.average_chars").alias("average_chars"), F.array_join(F.transform("ocr_status.needs_review_pages", lambda p: p.cast("string")), ",").alias("review"), "language", F.array_join("content_types", "|").alias("types"))
