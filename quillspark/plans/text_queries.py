"""Text functions over documents, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udf
from quillspark.plans.registry import query, table

WS = r"[\s\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squash_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def count_sql(x: str, cls: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{cls}')) AS BIGINT)"


#: The ends of lines of Python's splitlines, as code points; then what becomes a blank and what goes.
_ENDS = " || ".join(f"chr({c})" for c in (13, 11, 12, 28, 29, 30, 0x85, 0x2028, 0x2029))
_LINES = f"""list_transform(string_split(translate(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), {_ENDS} || chr(160) || chr(8203), repeat(chr(10), 9) || ' '), chr(10)),
  lambda x: {strip_sql("regexp_replace(x, '[ \\t\\x{3000}]+', ' ', 'g')")})"""
_NUM, _ORN = r"regexp_matches(x, '^\s*[-—–]?\s*\d{1,4}\s*[-—–]?\s*$')", "x IN ('|', '||', '_', '__', '·', '•')"
_KEPT = f"array_to_string(list_filter(lines, lambda x: NOT {_NUM} AND NOT {_ORN}), chr(10))"
_MARKS = "，。；：、！？"
_JOINED = f"regexp_replace(regexp_replace({_KEPT}, '([{_MARKS}]){WS}+', '\\1', 'g'), '{WS}+([{_MARKS}])', '\\1', 'g')"
CLEAN_SQL = f"""
WITH l AS (SELECT doc_id, source, text, {_LINES} AS lines FROM documents),
c AS (SELECT *, {strip_sql("regexp_replace(" + _JOINED + ", '\\n{3,}', chr(10) || chr(10), 'g')")} AS cleaned FROM l)
"""


def numbered_sql(prefix: str, n: str, width: int) -> str:
    """The number with zeros up to the width, and whole where it is longer."""
    return f"'{prefix}' || CASE WHEN length(CAST({n} AS VARCHAR)) >= {width} THEN CAST({n} AS VARCHAR) ELSE lpad(CAST({n} AS VARCHAR), {width}, '0') END"


def key_sql(x: str) -> str:
    cls = T.KEY_PUNCTUATION.replace("'", "''")
    return f"regexp_replace(regexp_replace(lower({x}), '{WS}+', '', 'g'), '{cls}', '', 'g')"


@query("t1_clean_text", CLEAN_SQL + f"""SELECT doc_id, cleaned, concat_ws('|', CASE WHEN length(text) > 200 AND length(cleaned) < length(text) * 0.5 THEN 'large cleanup delta' END,
  CASE WHEN len(list_filter(lines, lambda x: {_NUM})) > 0 THEN 'removed isolated page number' END, CASE WHEN len(list_filter(lines, lambda x: {_ORN})) > 0 THEN 'removed ornamental noise' END) AS notes FROM c""")
def t1(spark, d):
    done = table(spark, d, "documents").select("doc_id", F.inline(F.array(T.cleaned_with_notes(F.col("text")))))
    return done.select("doc_id", "cleaned", F.array_join("notes", "|").alias("notes"))


#: Every third document ends in a page number, every fifth in an ornament, every seventh has more white space than text.
_NOTED = "(SELECT * EXCLUDE (text), text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '- 12 -' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '||' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN repeat(' ', length(text) + 300) ELSE '' END AS text FROM documents)"


@query("a13_note_counts", CLEAN_SQL.replace("FROM documents", "FROM " + _NOTED) + f"""SELECT note, count(*) AS documents FROM (SELECT unnest([CASE WHEN length(text) > 200 AND length(cleaned) < length(text) * 0.5 THEN 'large cleanup delta' END,
  CASE WHEN len(list_filter(lines, lambda x: {_NUM})) > 0 THEN 'removed isolated page number' END, CASE WHEN len(list_filter(lines, lambda x: {_ORN})) > 0 THEN 'removed ornamental noise' END]) AS note FROM c) WHERE note IS NOT NULL GROUP BY note""")
def a13(spark, d):
    k = F.col("doc_id")
    end = lambda by, t: F.when(k % by == 0, t).otherwise("")
    noted = F.concat("text", end(3, "\n- 12 -"), end(5, "\n||"), end(7, F.repeat(F.lit(" "), F.length("text") + 300)))
    return table(spark, d, "documents").select(F.explode(T.cleaning_notes(noted)).alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("documents"))


@query("t2_suspect_text", f"""SELECT doc_id, length({strip_sql("text")}) < 80 OR {count_sql("text", "[�□■◆◇]")} > 5
  OR ({count_sql("text", "[A-Za-z]")} > 1.2 * {count_sql("text", "[\\x{4e00}-\\x{9fff}]")} AND {count_sql("text", "[\\x{4e00}-\\x{9fff}]")} < 50) AS suspect FROM documents""")
def t2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_suspect(F.col("text")).alias("suspect"))


@query("t3_needs_review", f"""WITH s AS (SELECT doc_id, {strip_sql("text")} AS t FROM documents)
  SELECT doc_id, length(t) < 80 OR {count_sql("t", "[�□■◆◇]")} > 5 OR {count_sql("t", "[|~`^_]")} > length(t) * 0.04 AS review FROM s""")
def t3(spark, d):
    return table(spark, d, "documents").select("doc_id", T.needs_review(F.col("text")).alias("review"))


@query("t4_normalize_key", f"SELECT doc_id, sha256({key_sql('text')}) AS key_sha FROM documents")
def t4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(udf.match_key(F.col("text")), 256).alias("key_sha"))


@query("t5_normalize_space", f"SELECT doc_id, {squash_sql('text')} AS squashed FROM documents")
def t5(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squash(F.col("text")).alias("squashed"))


@query("t6_strip_space", f"SELECT doc_id, CAST(length(regexp_replace(text, '{WS}+', '', 'g')) AS BIGINT) AS n, sha256(regexp_replace(text, '{WS}+', '', 'g')) AS bare_sha FROM documents")
def t6(spark, d):
    bare = T.without_space(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(bare).cast("long").alias("n"), F.sha2(bare, 256).alias("bare_sha"))


@query("t7_place_name", f"SELECT c_custkey, {strip_sql('''split_part(replace(c_name || ' （' || c_mktsegment || '）', '（', '('), '(', 1)''')} AS place FROM customer")
def t7(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.place_name(F.concat("c_name", F.lit(" （"), "c_mktsegment", F.lit("）"))).alias("place"))


@query("t8_short_text", f"WITH s AS (SELECT doc_id, {squash_sql('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END AS short FROM s")
def t8(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short_text(F.col("text"), 120).alias("short"))


@query("t9_first_sentence", f"""WITH s AS (SELECT doc_id, {squash_sql('text')} AS t FROM documents)
  SELECT doc_id, substr(CASE WHEN regexp_matches(t, '[。！？!?.]') THEN regexp_extract(t, '^[^。！？!?.]*[。！？!?.]') ELSE t END, 1, 150) AS first,
  CASE WHEN strpos(t, '?') > 0 THEN substr(t, 1, strpos(t, '?')) WHEN strpos(t, '.') > 0 THEN substr(t, 1, strpos(t, '.')) ELSE t END AS by_mark FROM s""")
def t9(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text"), 150).alias("first"), T.first_sentence_by_mark(F.col("text"), "?.").alias("by_mark"))


@query("t10_split_lines", f"""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, array_to_string(l, '¶') AS lines FROM
  (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM documents)""")
def t10(spark, d):
    found = table(spark, d, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    return found.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_join("l", "¶").alias("lines"))


@query("t11_split_paragraphs", f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda x: {strip_sql('x')} <> '')) AS BIGINT) AS blank_line,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: {strip_sql('x')} <> '')) AS BIGINT) AS single_line FROM documents""")
def t11(spark, d):
    n = lambda at: F.size(T.paragraphs(F.col("text"), at)).cast("long")
    return table(spark, d, "documents").select("doc_id", n(r"\n\s*\n+").alias("blank_line"), n("\n").alias("single_line"))


_PARAS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query("t12_usable_paragraphs", f"""WITH p AS (SELECT doc_id, list_transform({_PARAS}, lambda x: {squash_sql('x')}) AS ps, substr(text, 1, 12) AS title FROM documents)
  SELECT doc_id, CAST(len(list_filter(ps, lambda x: NOT starts_with(x, title) AND NOT regexp_matches(x, '^第\\d+封\\s') AND NOT (length(x) <= 18 AND regexp_matches(x, '[：:]$')))) AS BIGINT) AS usable FROM p""")
def t12(spark, d):
    kept = T.usable_paragraphs(F.col("text"), F.substring("text", 1, 12))
    return table(spark, d, "documents").select("doc_id", F.size(kept).cast("long").alias("usable"))


@query("t13_sentences", f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '¶') AS parts FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?]*[。！？；.!?]|[^。！？；.!?]+'), lambda x: {strip_sql('x')}), lambda x: length(x) >= 12) AS s FROM documents)""")
def t13(spark, d):
    parts = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text"), least=12).alias("s"))
    return parts.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "¶").alias("parts"))


@query("t14_clip_piece", """WITH p AS (SELECT doc_id, text AS t FROM documents),
  m AS (SELECT doc_id, t, list_filter(list_transform([';', ',', '.'], lambda k: CASE WHEN strpos(substr(t, 49), k) > 0 THEN strpos(substr(t, 49), k) + 48 ELSE 0 END), lambda x: x > 48 AND x <= 151) AS cuts FROM p)
  SELECT doc_id, CASE WHEN len(cuts) > 0 THEN substr(t, 1, cuts[1]) WHEN length(t) >= 80 THEN substr(t, 1, 120) END AS clipped FROM m""")
def t14(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip(F.col("text"), ";,.").alias("clipped"))


@query("t15_block_from_paragraph", f"""WITH RECURSIVE w AS (SELECT doc_id, {_PARAS} AS ps FROM documents), p AS (SELECT doc_id, unnest(ps) AS whole, unnest(range(len(ps))) AS place FROM w),
  s AS (SELECT doc_id, place, whole, list_filter(list_transform(regexp_extract_all(whole, '[^.]*[.]|[^.]+'), lambda x: {strip_sql('x')}), lambda x: length(x) >= 1) AS parts FROM p),
  f AS (SELECT doc_id, place, 0 AS i, '' AS acc, FALSE AS done FROM s UNION ALL
        SELECT f.doc_id, f.place, i + 1, CASE WHEN NOT done AND length(acc) + length(parts[i + 1]) <= 320 THEN acc || parts[i + 1] ELSE acc END,
          done OR length(acc) + length(parts[i + 1]) > 320 OR length(CASE WHEN NOT done AND length(acc) + length(parts[i + 1]) <= 320 THEN acc || parts[i + 1] ELSE acc END) >= 160
        FROM f JOIN s USING (doc_id, place) WHERE i < len(parts)),
  j AS (SELECT doc_id, place, arg_max(acc, i) AS joined FROM f GROUP BY doc_id, place)
  SELECT doc_id, place, CASE WHEN length(whole) BETWEEN 80 AND 320 THEN whole WHEN length(joined) >= 80 THEN joined ELSE substr(whole, 1, 260) END AS block FROM s JOIN j USING (doc_id, place)""")
def t15(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"), r"\n+")).alias("place", "whole"))
    return each.select("doc_id", F.col("place").cast("long").alias("place"), T.block_of(T.sentences(F.col("whole"), "."), F.col("whole")).alias("block"))


_STOP = ", ".join(f"'{x}'" for x in T.CLAIM_STOP)
CLAIMS_SQL = f"""h AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '{T.CLAIM_HARD}'), lambda x: {strip_sql('x')}), lambda x: x <> '')) AS p FROM documents),
  q AS (SELECT doc_id, p, list_filter(list_transform(regexp_split_to_array(p, '{T.CLAIM_SOFT}'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS xs FROM h),
  s AS (SELECT doc_id, unnest(CASE WHEN length(p) <= 42 OR len(xs) = 0 THEN [p] ELSE xs END) AS c FROM q),
  t AS (SELECT doc_id, regexp_replace(c, '^[{T.CLAIM_ENDS}]+|[{T.CLAIM_ENDS}]+$', '', 'g') AS t FROM s),
  claim AS (SELECT doc_id, t FROM t WHERE t <> '' AND {key_sql('t')} NOT IN ({_STOP}))"""


@query("t16_split_claims", f"WITH {CLAIMS_SQL} SELECT doc_id, count(*) AS n_claims, CAST(sum(length(t)) AS BIGINT) AS chars FROM claim GROUP BY doc_id")
def t16(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(T.claims(F.col("text"))).alias("t"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_claims"), F.sum(F.length("t")).cast("long").alias("chars"))


_NAMES = ("tion", "ment", "lich", "aire", "ous")


def anchors_sql(source: str, text: str, names: tuple) -> str:
    """Rows (every column of source, x, i): the anchors of text, each key's first."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""a AS (SELECT *, list_concat(list_filter([{listed}], lambda n: contains({key_sql(text)}, n)),
    list_concat(list_transform(regexp_extract_all({text}, '(?i)\\b(?:G|S|X)\\s*\\d{{2,4}}\\b|\\b\\d{{3}}\\b'), lambda c: replace(upper(c), ' ', '')), list_filter(regexp_extract_all({text}, '\\d+(?:\\.\\d+)?'), lambda n: n NOT IN ('1', '2', '3')))) AS xs FROM {source}),
  k AS (SELECT *, list_transform(xs, lambda x: {key_sql('x')}) AS keys FROM a),
  f AS (SELECT *, list_filter(xs, lambda x, i: keys[i] <> '' AND list_position(keys, keys[i]) = i) AS anchors FROM k)"""


@query("t17_extract_anchors", f"WITH {anchors_sql('documents', 'text', _NAMES)} SELECT doc_id, array_to_string(anchors, '|') AS anchors FROM f WHERE len(anchors) > 0")
def t17(spark, d):
    found = table(spark, d, "documents").select("doc_id", T.anchors(F.col("text"), _NAMES).alias("a"))
    return found.where(F.size("a") > 0).select("doc_id", F.array_join("a", "|").alias("anchors"))


@query("t18_page_numbers", """WITH t AS (SELECT o_orderkey, 'see p' || (o_orderkey % 50 + 1) || ' and 第 ' || (o_orderkey % 7 + 3) || ' 页, p' || (o_orderkey % 50 + 1) AS x FROM orders)
  SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(x, '(\\d{1,3})\\s*页', 1), regexp_extract_all(x, 'p(\\d{1,3})', 1)), lambda v: CAST(v AS INTEGER)))), ',') AS pages FROM t""")
def t18(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("see p"), (k % 50 + 1).cast("string"), F.lit(" and 第 "), (k % 7 + 3).cast("string"), F.lit(" 页, p"), (k % 50 + 1).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.page_numbers(text).cast("array<string>"), ",").alias("pages"))


@query("t19_derive_places", r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[，,、/／—\-→：:\s]+'), lambda x: length(x) >= 4) AS xs FROM documents),
  u AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM s), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
  SELECT doc_id, string_agg(x, '|' ORDER BY i) AS places FROM r WHERE rn <= 6 GROUP BY doc_id""")
def t19(spark, d):
    found = table(spark, d, "documents").select("doc_id", T.name_parts(F.col("text"), least=4).alias("p"))
    return found.where(F.size("p") > 0).select("doc_id", F.array_join("p", "|").alias("places"))


_GROUPS = {"water": ("eau", "oui"), "road": ("route", "weg", "road"), "town": ("stadt", "ville", "town", "tion")}


@query("t21_scene_tags", "SELECT doc_id, concat_ws('|', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(text, '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in _GROUPS.items()) + ") AS tags FROM documents")
def t21(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.labels_by_keywords(F.col("text"), _GROUPS), "|").alias("tags"))


@query("t20_derive_themes", "SELECT doc_id, concat_ws('|', 'base', CASE WHEN n_chars >= 5000 THEN 'long' END, CASE WHEN n_chars // 1200 >= 5 THEN 'many parts' END, " + ", ".join("CASE WHEN " + " OR ".join(f"contains(text, '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in _GROUPS.items()) + ") AS themes FROM documents")
def t20(spark, d):
    head = F.array(F.lit("base"), F.when(F.col("n_chars") >= 5000, "long"), F.when(F.floor(F.col("n_chars") / 1200) >= 5, "many parts"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.concat(head, T.labels_by_keywords(F.col("text"), _GROUPS)), "|").alias("themes"))


@query("t22_category_by_token", "SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') OR contains(p_type, 'TIN') THEN 'hard' WHEN contains(p_type, 'BRASS') OR contains(p_type, 'COPPER') THEN 'soft' ELSE 'other' END AS kind FROM part")
def t22(spark, d):
    return table(spark, d, "part").select("p_partkey", T.category_by_token(F.col("p_type"), {"hard": ("STEEL", "TIN"), "soft": ("BRASS", "COPPER")}, "other").alias("kind"))


@query("t23_detect_language", f"""WITH c AS (SELECT doc_id, {count_sql("substr(text, 1, 200000)", "[\\x{4e00}-\\x{9fff}]")} AS cjk, {count_sql("substr(text, 1, 200000)", "[A-Za-z]")} AS lat FROM documents)
  SELECT doc_id, CASE WHEN cjk + lat = 0 THEN 'unknown' WHEN cjk > 0.7 * (cjk + lat) THEN 'zh-Hans' WHEN lat > 0.7 * (cjk + lat) THEN 'en' ELSE 'mixed' END AS script FROM c""")
def t23(spark, d):
    return table(spark, d, "documents").select("doc_id", T.script_language(F.col("text")).alias("script"))


@query("t25_toc_score", f"""SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '^The') THEN 5 ELSE 0 END + least({count_sql("text", "\\n")}, 5) + least({count_sql("text", "\\d+")}, 4) AS BIGINT) AS score FROM documents""")
def t25(spark, d):
    return table(spark, d, "documents").select("doc_id", T.toc_score(F.col("text"), "^The", (("\n", 5), (r"\d+", 4))).cast("long").alias("score"))


_KINDS = {"route": (("tion", 3), ("ing", 1)), "letters": (("lich", 3), ("und", 1)), "guide": (("eau", 3), ("les", 1)), "history": (("ado", 2), ("que", 1))}


@query("t26_content_types", "WITH k(kind, word, weight) AS (VALUES " + ", ".join(f"('{k}', '{w}', {n})" for k, ws in _KINDS.items() for w, n in ws) + """),
  s AS (SELECT source, kind, CAST(sum((length(text) - length(replace(text, word, ''))) // length(word) * weight) AS BIGINT) AS score FROM documents, k GROUP BY source, kind),
  m AS (SELECT *, max(score) OVER (PARTITION BY source) AS top FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, kind) AS rn FROM m WHERE score >= greatest(50, CAST(floor(0.08 * top) AS BIGINT)))
  SELECT source, kind, score, CAST(rn AS BIGINT) AS place FROM r WHERE rn <= 5""")
def t26(spark, d):
    from quillspark.operators import scoring

    return scoring.suggest_types(scoring.type_scores(table(spark, d, "documents"), "source", "text", _KINDS), "source").select("source", "kind", "score", "place")


@query("t27_reading_hint", "SELECT doc_id, CASE WHEN n_chars // 1200 >= 6 OR n_chars >= 4500 THEN 'long' WHEN n_chars > 0 AND n_chars <= 2200 THEN 'short' ELSE 'medium' END AS hint FROM documents")
def t27(spark, d):
    return table(spark, d, "documents").select("doc_id", T.reading_hint(F.floor(F.col("n_chars") / 1200), F.col("n_chars")).alias("hint"))


@query("t29_value_text", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN 'not stated' ELSE o_orderpriority END AS shown FROM orders")
def t29(spark, d):
    value = F.when(~F.startswith("o_orderpriority", F.lit("5")), F.col("o_orderpriority")).otherwise(F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", T.value_text(value, "not stated").alias("shown"))


@query("t32_slug_valid", "SELECT c_custkey, regexp_full_match(lower(replace(c_name, '#', '-')), '[a-z0-9]+(?:-[a-z0-9]+)*') AS lower_ok, regexp_full_match(c_name, '[a-z0-9]+(?:-[a-z0-9]+)*') AS raw_ok FROM customer")
def t32(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).rlike(T.SLUG).alias("lower_ok"), F.col("c_name").rlike(T.SLUG).alias("raw_ok"))


@query("t33_number_ids", "SELECT doc_id, 'chunk-' || CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 4 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 4, '0') END AS chunk_id FROM documents")
def t33(spark, d):
    return table(spark, d, "documents").select("doc_id", T.numbered("chunk-", F.col("doc_id"), 4).alias("chunk_id"))


@query("t34_xml_escape", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_sha FROM pages")
def t34(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.xml_escape(F.col("html")), 256).alias("escaped_sha"))


@query("t35_route_parse", r"""SELECT page_id, regexp_extract(url, '://[^/?#]*/([a-z]{2})/(\d+)', 1) AS section, try_cast(regexp_extract(url, '://[^/?#]*/([a-z]{2})/(\d+)', 2) AS BIGINT) AS item,
  CASE WHEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) IN ('x', 'feed') THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) END AS ref FROM pages""")
def t35(spark, d):
    path, ref = r"://[^/?#]*/([a-z]{2})/(\d+)", F.regexp_extract("url", r"[?&]ref=([^&#]*)", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", path, 1).alias("section"), F.regexp_extract("url", path, 2).try_cast("long").alias("item"), F.when(ref.isin("x", "feed"), ref).alias("ref"))


@query("t36_try_int", "SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS BIGINT) AS rank, try_cast(o_orderpriority AS BIGINT) AS none FROM orders")
def t36(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring_index("o_orderpriority", "-", 1).try_cast("long").alias("rank"), F.col("o_orderpriority").try_cast("long").alias("none"))


@query("t37_first_truthy", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END), ''), CASE WHEN doc_id % 3 = 0 THEN lang END, source) AS named FROM documents")
def t37(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", T.first_truthy(T.strip(F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit(""))), F.when(k % 3 == 0, F.col("lang")), F.col("source")).alias("named"))


@query("t30_section_title", r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '<h[12][^>]*>([^<]*)<', 1), ''), nullif(regexp_extract(html, '<h[3-6][^>]*>([^<]*)<', 1), ''), url) AS title FROM pages""")
def t30(spark, d):
    major, any_ = F.regexp_extract("html", "<h[12][^>]*>([^<]*)<", 1), F.regexp_extract("html", "<h[3-6][^>]*>([^<]*)<", 1)
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(major, F.lit("")), F.nullif(any_, F.lit("")), F.col("url")).alias("title"))


@query("t31_resolve_href", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'OEBPS/text/a' || page_id || '.xhtml' WHEN 1 THEN 'OEBPS/a' || page_id || '.xhtml' ELSE 'OEBPS/text/img/a' || page_id || '.xhtml' END AS resolved FROM pages")
def t31(spark, d):
    name = F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit(".xhtml"))
    href = F.when(F.col("page_id") % 3 == 0, name).when(F.col("page_id") % 3 == 1, F.concat(F.lit("./../"), name)).otherwise(F.concat(F.lit("img/x/../"), name))
    return table(spark, d, "pages").select("page_id", T.resolve_href(F.lit("OEBPS/text/ch1.xhtml"), href).alias("resolved"))


@query("t28_label_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' ELSE o_orderstatus END AS label FROM orders")
def t28(spark, d):
    labels = F.create_map(*[F.lit(x) for kv in {"F": "finished", "O": "open", "P": "partial"}.items() for x in kv])
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(labels, F.col("o_orderstatus")), F.col("o_orderstatus")).alias("label"))


@query("f9_forbidden_markers", "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'lorem') AS marked FROM documents")
def f9(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_marker(F.col("text"), ("License", "LOREM")).alias("marked"))


@query("f10_long_marked_line", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 180 AND (contains(lower(x), 'the') OR contains(lower(x), 'le')))) > 0 AS long_line FROM documents")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", T.long_marked_line(F.col("text"), ("the", "le")).alias("long_line"))


@query("f11_quote_too_long", f"SELECT item_id, length(regexp_replace(text, '{WS}+', '', 'g')) > 120 AS too_long FROM benchmark")
def f11(spark, d):
    return table(spark, d, "benchmark").select("item_id", (F.length(T.without_space(F.col("text"))) > 120).alias("too_long"))
