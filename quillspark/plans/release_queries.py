"""Release suites on compiled rule tables, and rules on lines of text files, each beside the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import release as R
from quillspark.plans.guide_queries import _all
from quillspark.plans.registry import query, table
from quillspark.plans.text_queries import WS, strip_sql
from quillspark.sources import readers, sinks
from quillspark.sources.kept import shared_folder

# C27: documents as text files, a file for each range of ids, and what their lines hold

#: Documents of a file.
IN_A_FILE = 20_000
#: Patterns that lines of the tables do hold, beside those of the web pages.
LINE_RULES = R.WEB_PATHS | {"year": r"\b(19|20)\d\d\b", "license": "(?i)licen[sc]e", "capitals": "[A-Z]{6,}"}
_LABELS = ", ".join(f"('{k}', '{p}')" for k, p in ((k.replace("'", "''"), p.replace("'", "''")) for k, p in LINE_RULES.items()))


@query("c27_line_rules", f"""WITH l AS (SELECT doc_id // {IN_A_FILE} AS file, doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13), ' '), chr(10))) AS x, unnest(range(len(string_split(replace(coalesce(text, ''), chr(13), ' '), chr(10))))) AS i FROM documents),
  n AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY doc_id, i) AS line, x FROM l), r(label, pattern) AS (VALUES {_LABELS})
  SELECT file, line, label, {strip_sql('x')} AS text FROM n JOIN r ON regexp_matches(x, pattern)""")
def c27(spark, d):
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex[:12]}"
    docs = table(spark, d, "documents").select(F.expr(f"doc_id div {IN_A_FILE}").alias("file"), "doc_id", F.translate(F.coalesce("text", F.lit("")), "\r", " ").alias("text"))
    docs.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text").write.partitionBy("file").text(path)
    found = readers.line_findings(readers.numbered_lines(spark, path), LINE_RULES)
    return found.withColumn("file", F.regexp_extract("file", r"file=(\d+)/", 1).cast("long"))


# G22: documents as files of a release, nations as its projects and its ignore file, turns as quotes

_PATHS = [
    "'web/public/projects/p' || k % 5 || '/project.json'", "'web/public/projects/p' || k % 5 || '/Book.md'", "'projects/x/public/review_pack/pages/page_' || k || '.png'", "'web/public/img/page_' || k || '.PNG'", "'web/src/a' || k || '.tsx'", "'docs/n' || k || '.md'",
    "'web/public/projects/p' || k % 5 || '/review_index.md'", "'web/public/big' || k || '.jpg'", "'data/ocr/t' || k || '.md'", "'web/public/projects/p1/odd' || k || '.json'", "'README.md'", "'scripts/s' || k || '.py'",
]
_PATH_SQL = "CASE k % 12 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PATHS)) + " END"
_TEXT_SQL = "CASE k % 7 WHEN 0 THEN text || ' MEMORY.md' WHEN 1 THEN text || '官方路线' WHEN 2 THEN 'quote ' || text WHEN 3 THEN NULL ELSE text END"
_IGNORE = {0: " projects/*/private/ ", 1: "data\\ocr\\", 2: "*.pyc", 3: "web/dist"}
_LINE_SQL = "CASE n_nationkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _IGNORE.items()) + " ELSE '# ' || n_name END"
_FILES = f"""f AS (SELECT *, lower(string_split(path, '/')[-1]) AS name, CASE WHEN contains(name, '.') THEN '.' || string_split(name, '.')[-1] ELSE '' END AS suffix, path LIKE 'web/public/%' OR path LIKE 'projects/%/public/%' AS public, regexp_matches(path, '^web/public/projects/[^/]+/.') AS project
    FROM (SELECT {_PATH_SQL} AS path, n_chars * 300 AS bytes, {_TEXT_SQL} AS text FROM (SELECT *, doc_id AS k FROM documents))),
  sc AS (SELECT * FROM f WHERE suffix IN ('.md', '.json', '.tsx') AND (path = 'README.md' OR regexp_matches(path, '^(docs|scripts|web/src|web/public|projects|data)/')) AND path NOT LIKE 'data/ocr/%'),
  ig AS (SELECT replace({strip_sql(_LINE_SQL)}, '\\', '/') AS line FROM nation), pj AS (SELECT CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE 'p' || n_nationkey END AS slug, CASE WHEN n_nationkey % 5 <> 0 THEN ['route.gpx', 'review_index.md', CASE WHEN n_nationkey % 4 <> 0 THEN 'project.json' END] END AS fs FROM nation),
  asked AS (SELECT DISTINCT 'web/public/projects/' || slug || '/project.json' AS path, 'missing project.json' AS m FROM pj WHERE slug <> '' UNION SELECT 'web/public/projects/' || slug || '/' || x, 'public file is missing' FROM (SELECT slug, unnest(fs) AS x FROM pj WHERE slug <> '') WHERE x IS NOT NULL),
  need AS (SELECT unnest({list(R.IGNORED)}) AS p)"""


@query("g22_release_boundary", f"WITH {_FILES} " + _all([
    ("G22.private", "error", "path", "private file in a public folder", "f WHERE public AND name IN ('book.md')"), ("G22.scan", "error", "path", "rendered review page in a public folder", "f WHERE public AND contains(lower(path), '/review_pack/pages/') AND suffix = '.png'"),
    ("G22.image", "error", "path", "large or page-numbered image in a public folder", "f WHERE public AND suffix IN ('.png', '.jpg') AND (bytes >= 500000 OR regexp_matches(name, '^page_\\d+\\.(png|jpg|jpeg|webp)$'))"),
    ("G22.unexpected", "error", "path", "unexpected file in a public project", "f WHERE project AND string_split(path, '/')[-1] NOT IN ('project.json', 'review_index.md')"),
    ("G22.excerpt", "warning", "path", "may contain long source excerpts", f"f WHERE project AND name = 'review_index.md' AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '摘|quote|引文|原文') AND length({strip_sql('x')}) > 180)) > 0"),
    ("G22.marker", "error", "path", "internal marker: MEMORY.md", "sc WHERE contains(text, 'MEMORY.md')"), ("G22.copy", "error", "path", "high-risk copy: 官方路线", "sc WHERE path LIKE 'web/src/%' AND contains(text, '官方路线')"),
    ("G22.ignore", "error", "'.gitignore'", "('missing ignore pattern: ' || p)", "need WHERE p NOT IN (SELECT line FROM ig)"),
    ("G22.project", "error", "'web/public/projects/index.json'", "invalid project entry", "pj WHERE slug = ''"), ("G22.list", "error", "'web/public/projects/' || slug || '/project.json'", "public_files must be a list", "pj WHERE slug <> '' AND fs IS NULL"),
    ("G22.list", "error", "'web/public/projects/' || slug || '/project.json'", "public_files holds an entry without a name", "pj WHERE slug <> '' AND len(list_filter(fs, lambda x: x IS NULL)) > 0"), ("G22.missing", "error", "path", "(m)", "asked WHERE path NOT IN (SELECT path FROM f)"),
    ("G22.quote", "warning", "'q.json'", "(coalesce(CAST(nullif(conv_id % 9, 0) AS VARCHAR), 'unknown') || ' quote is ' || length(text) || ' chars, over 120')", "conversations WHERE length(text) > 120"),
]))
def g22(spark, d):
    docs = table(spark, d, "documents").withColumn("k", F.col("doc_id"))
    case = lambda sql: F.expr(sql)
    files = docs.select(case(_PATH_SQL).alias("path"), (F.col("n_chars") * 300).alias("bytes"), case(_TEXT_SQL).alias("text"))
    nation, key = table(spark, d, "nation"), F.col("n_nationkey")
    line = F.concat(F.lit("# "), F.col("n_name"))
    for k, v in _IGNORE.items():
        line = F.when(key == k, F.lit(v)).otherwise(line)
    listed = F.when(key % 5 != 0, F.array(F.lit("route.gpx"), F.lit("review_index.md"), F.when(key % 4 != 0, "project.json")))
    projects = nation.select(F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("p"), key.cast("string"))).alias("slug"), listed.alias("public_files"))
    quotes = table(spark, d, "conversations").select(F.lit("q.json").alias("path"), F.nullif(F.col("conv_id") % 9, F.lit(0)).cast("string").alias("segment_id"), F.col("text").alias("quote"))
    return R.release_boundary(files, nation.select(line.alias("line")), projects, quotes)


# C3: nations as the guide's documents, suppliers as its cards, parts as concepts, turns as quotes and questions

_GUIDE = f"""dn AS (SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'v0' WHEN n_nationkey % 4 <> 1 THEN 'v1' END AS version, CASE WHEN n_nationkey % 3 = 0 THEN 'final' ELSE 'draft' END AS status, n_nationkey % 7 = 0 AS bare, n_nationkey % 5 = 0 AS untitled, CASE WHEN n_nationkey % 8 = 0 THEN 'see D:\\x' ELSE n_name END AS body, n_nationkey % 9 = 0 AS differs FROM nation),
  cd AS (SELECT k, CASE WHEN k % 8 <> 0 AND k <= 25 THEN 'sec-' || lpad(CAST(k + 5 AS VARCHAR), 3, '0') END AS section_id, k <= 25 AS expected, k % 5 = 0 AS untitled, k % 6 = 0 AS odd FROM (SELECT s_suppkey + 1 AS k FROM supplier)),
  cc AS (SELECT p_partkey + 1 AS k, p_partkey % 10 = 0 AS unlabelled, p_partkey % 7 AS letters FROM part), tn AS (SELECT conv_id * 100 + turn AS k, CASE WHEN turn % 2 = 0 THEN '' ELSE coalesce(text, '') END AS q, coalesce(text, '') AS t, role FROM conversations)"""
_PLACE = lambda name, rest="": f"'{name}[' || (k - 1) || ']{rest}'"


@query("c3_guide_public", f"WITH {_GUIDE} " + _all([
    ("C3.version", "error", "name", "schema_version must be v1", "dn WHERE version IS DISTINCT FROM 'v1'"), ("C3.status", "error", "name", "status must be draft", "dn WHERE status <> 'draft'"), ("C3.book", "error", "name || '.book'", "book must be there", "dn WHERE bare"),
    ("C3.book", "error", "name || '.book.title'", "missing book field: title", "dn WHERE NOT bare AND untitled"), ("C3.marker", "error", "name", "forbidden markers found", "dn WHERE contains(lower(body), 'd:\\')"), ("C3.mirror", "error", "name", "public and mirror differ", "dn WHERE differs"),
    ("C3.cards", "error", "'chapters'", "('expected 25 rows, got ' || n)", "(SELECT count(*) AS n FROM cd) WHERE n <> 25"), ("C3.section", "error", _PLACE("chapters", ".section_id"), "section out of order", "cd WHERE section_id IS NULL AND expected"),
    ("C3.field", "error", _PLACE("chapters"), "missing title", "cd WHERE untitled"), ("C3.review", "warning", _PLACE("chapters", ".review_status"), "unexpected review_status", "cd WHERE odd"),
    ("C3.concepts", "error", "'concepts'", "must not be empty", "(SELECT 1 WHERE NOT EXISTS (FROM cc))"), ("C3.field", "error", _PLACE("concepts"), "missing label", "cc WHERE unlabelled"), ("C3.letters", "error", _PLACE("concepts", ".related_letters"), "must be a non-empty list", "cc WHERE letters < 2"),
    ("C3.quotes", "error", "'quotes'", "('expected 25 rows, got ' || n)", "(SELECT count(*) AS n FROM tn) WHERE n <> 25"), ("C3.mode", "error", _PLACE("quotes", ".quote_mode"), "must be structural_no_quote", "tn WHERE role = 'system'"),
    ("C3.quote", "error", _PLACE("quotes", ".quote"), "must be empty", "tn WHERE q <> ''"), ("C3.quote", "error", _PLACE("quotes", ".quote"), "('quote too long: ' || length(q))", "tn WHERE length(q) > 80"),
    ("C3.questions", "error", "'questions'", "('expected at least 26, got ' || n)", "(SELECT count(*) AS n FROM tn) WHERE n < 26"), ("C3.field", "error", _PLACE("questions"), "missing scope", "tn WHERE role = 'user'"),
    ("C3.question", "error", _PLACE("questions", ".question"), "must not be empty", "tn WHERE t = ''"), ("C3.question", "warning", _PLACE("questions", ".question"), "('question is long: ' || length(t))", "tn WHERE length(t) > 180"),
]))
def c3(spark, d):
    k = F.col("n_nationkey")
    book = F.when(k % 7 != 0, F.struct(F.when(k % 5 == 0, "").otherwise("t").alias("title"), F.lit("a").alias("author"), F.lit("l").alias("language"), F.lit("s").alias("source_type")))
    nation = table(spark, d, "nation")
    documents = nation.select(F.col("n_name").alias("name"), F.when(k % 4 == 0, "v0").when(k % 4 != 1, "v1").alias("schema_version"), F.when(k % 3 == 0, "final").otherwise("draft").alias("status"), book.alias("book"), F.when(k % 8 == 0, "see D:\\x").otherwise(F.col("n_name")).alias("body"), k)
    mirror = documents.withColumn("body", F.when(k % 9 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    s = F.col("s_suppkey") + 1
    section = F.when((s % 8 != 0) & (s <= 25), F.concat(F.lit("sec-"), F.lpad((s + 5).cast("string"), 3, "0")))
    cards = table(spark, d, "supplier").select(s.alias("place"), section.alias("section_id"), F.when(s % 6 == 0, "x").otherwise("auto_structural_draft").alias("review_status"), F.lit("c").alias("chapter_id"), F.lit("l").alias("letter_id"), F.when(s % 5 == 0, " ").otherwise("t").alias("title"), F.lit("s").alias("summary"))
    p = F.col("p_partkey")
    letters = F.when(p % 7 == 1, F.array().cast("array<string>")).when(p % 7 != 0, F.array(F.lit("letter-001")))
    concepts = table(spark, d, "part").select((p + 1).alias("place"), F.lit("c").alias("concept_id"), F.when(p % 10 != 0, "l").alias("label"), F.lit("d").alias("description"), F.lit("r").alias("review_status"), letters.alias("related_letters"))
    turns = table(spark, d, "conversations").withColumn("place", F.col("conv_id") * 100 + F.col("turn"))
    quotes = turns.select("place", F.when(F.col("role") != "system", "structural_no_quote").alias("quote_mode"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")).alias("quote"))
    questions = turns.select("place", F.lit("q").alias("question_id"), F.when(F.col("role") == "user", "").otherwise("letter").alias("scope"), F.col("text").alias("question"), F.lit("b").alias("basis"), F.lit("r").alias("review_status"))
    return R.guide_public(documents, cards, concepts, quotes, questions, mirror, tuple(f"sec-{i:03d}" for i in range(6, 31)), "v1", "draft")


# G39: documents as public files and their mirrors, labels as review tasks

_STATE = """pu AS (SELECT source || doc_id // 2 AS name, CASE WHEN doc_id % 11 = 0 THEN 'Final' WHEN doc_id % 13 = 0 THEN NULL ELSE 'draft' END AS status, CASE WHEN doc_id % 7 <> 0 THEN 'public-preview' END AS phase, CASE WHEN doc_id % 17 = 0 THEN 'done' ELSE 'manual-review-pending' END AS review, text AS body, doc_id FROM documents),
  wb AS (SELECT name, status, phase, review, CASE WHEN doc_id % 19 = 0 THEN 'see Book.md' ELSE body END AS body FROM pu WHERE doc_id % 23 <> 0),
  bo AS (SELECT name || '.public' AS loc, lower(coalesce(status, '')) AS st, phase, review, body FROM pu UNION ALL SELECT name || '.web', lower(coalesce(status, '')), phase, review, body FROM wb),
  mi AS (SELECT DISTINCT name FROM (SELECT name, status, phase, review, body, sum(n) AS n FROM (SELECT name, status, phase, review, body, 1 AS n FROM pu UNION ALL SELECT *, -1 FROM wb) GROUP BY ALL HAVING sum(n) <> 0)),
  ta AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'tasks' ELSE 'template' END AS kind, toxic = 0 AS blank FROM labels), tc AS (SELECT k AS kind, count(*) FILTER (ta.kind = k) AS n, count(*) FILTER (ta.kind = k AND blank) AS b FROM ta, (VALUES ('tasks'), ('template')) x(k) GROUP BY k)"""
_SOURCES = " OR ".join(f"contains(lower(body), '{m.lower()}')" for m in R.SOURCE_MARKERS)


@query("g39_preview_state", f"WITH {_STATE} " + _all([
    ("G39.status", "error", "loc || '.status'", "expected draft", "bo WHERE st <> 'draft'"), ("G39.status", "error", "loc || '.status'", "('promoted status: ' || st)", "bo WHERE st = 'final'"), ("G39.phase", "error", "loc || '.release_phase'", "expected public-preview", "bo WHERE phase IS NULL"),
    ("G39.review", "error", "loc || '.review_status'", "expected manual-review-pending", "bo WHERE review = 'done'"), ("G39.marker", "error", "loc", "forbidden source markers found", f"bo WHERE {_SOURCES}"), ("G39.once", "error", "loc", "stands more than once", "(SELECT loc FROM bo GROUP BY loc HAVING count(*) > 1)"),
    ("G39.mirror", "error", "name", "public and mirror differ", "mi"), ("G39.blank", "error", "kind", "('expected 95 blank results, got rows=' || n || ' blank=' || b)", "tc WHERE n <> 95 OR b <> 95"),
]))
def g39(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    status = F.when(k % 11 == 0, "Final").when(k % 13 == 0, F.lit(None)).otherwise("draft")
    columns = [F.concat("source", F.expr("doc_id div 2").cast("string")).alias("name"), status.alias("status"), F.when(k % 7 != 0, "public-preview").alias("release_phase"), F.when(k % 17 == 0, "done").otherwise("manual-review-pending").alias("review_status")]
    public = docs.select(*columns, F.col("text").alias("body"))
    web = docs.where(k % 23 != 0).select(*columns, F.when(k % 19 == 0, "see Book.md").otherwise(F.col("text")).alias("body"))
    tasks = table(spark, d, "labels").select(F.when(k % 2 == 0, "tasks").otherwise("template").alias("kind"), k.cast("string").alias("task_id"), F.when(F.col("toxic") == 0, " ").otherwise("pass").alias("manual_result"))
    return R.preview_state(public, web, tasks)


# K9, K10: sources as books whose pages are documents; sections that are put into texts again

_PAGES_SQL = r"""SELECT source, count(*) AS pages, min(doc_id) AS first, max(doc_id) AS last, TRUE AS ordered, CAST(sum(length(doc_id::VARCHAR) * 2 + 33 + length(regexp_replace(replace(coalesce(text, ''), chr(13), ' '), '[\s\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]+$', ''))) AS BIGINT) + length(source) + 4 AS chars FROM documents GROUP BY source"""


@query("k9_book_pages", _PAGES_SQL)
def k9(spark, d):
    """The books as they are read back: their pages in order of the files' names and lines, and all their characters."""
    path = f"{shared_folder(spark)}/books-{uuid.uuid4().hex[:12]}"
    docs = table(spark, d, "documents").withColumn("text", F.translate("text", "\r", " "))
    sinks.write_books(sinks.page_entries(docs, "source", "doc_id", "text", F.col("source")), path)
    lines = readers.numbered_lines(spark, path).withColumn("source", F.regexp_extract("file", "book=([^/]+)/", 1))
    number = F.regexp_extract("text", r"^<!-- page: (\d+) -->$", 1)
    marks = lines.where(number != "").select("source", "file", "line", number.cast("long").alias("page"))
    # pages ascend in a file, and no file's begin before the last one's end
    in_file = marks.withColumn("_last", F.lag("page").over(Window.partitionBy("file").orderBy("line"))).groupBy("source", "file").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("page") > F.col("_last")), F.lit(True)).alias("ok"))
    over = in_file.withColumn("_high", F.lag("high").over(Window.partitionBy("source").orderBy("file")))
    found = over.groupBy("source").agg(F.sum("n").alias("pages"), F.min("low").alias("first"), F.max("high").alias("last"), F.bool_and(F.col("ok") & F.coalesce(F.col("low") > F.col("_high"), F.lit(True))).alias("ordered"))
    chars = lines.groupBy("source").agg(F.sum(F.length("text") + 1).alias("chars"))
    return found.join(chars, "source").select("source", "pages", "first", "last", "ordered", "chars")


@query("k10_section_upsert", f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ## Log' || chr(10) || 'old' WHEN doc_id % 3 = 1 THEN text WHEN doc_id % 6 = 2 THEN ' ' END AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(coalesce(t, ''), '## Log') THEN regexp_replace(string_split(t, '## Log')[1], '{WS}+$', '') || chr(10) || chr(10) WHEN {strip_sql("coalesce(t, '')")} <> '' THEN regexp_replace(t, '{WS}+$', '') || chr(10) || chr(10) ELSE chr(10) || chr(10) END || '## Log' || chr(10) || doc_id || chr(10) AS text FROM x""")
def k10(spark, d):
    """Put in twice: the second time changes nothing, but that a section without text before it gets its two line breaks."""
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat("text", F.lit(" ## Log\nold"))).when(k % 3 == 1, F.col("text")).when(k % 6 == 2, " ")
    section = F.concat(F.lit("## Log\n"), k.cast("string"), F.lit("\n\n"))
    once = table(spark, d, "documents").select("doc_id", sinks.with_section(text, "## Log", section).alias("text"))
    return once.select("doc_id", sinks.with_section(F.col("text"), "## Log", section).alias("text"))
