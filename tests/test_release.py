"""Rule tables, release suites on hand-made rows, and text files by line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import release as R
from quillspark.operators.rules import Each, Mirror, Once, Row, Total, compiled, counted, marked, required
from quillspark.sources import readers


def found(df):
    return sorted((r.rule_id, r.severity, r.path, r.message) for r in df.collect())


def test_a_rule_table_gives_every_finding_once(spark):
    df = spark.createDataFrame([(1, "a", ["x", ""], "fine"), (2, " ", None, "see D:/x"), (2, None, ["y"], None), (3, "c", [], "SEE d:/")], "id int, title string, tags array<string>, body string")
    other = spark.createDataFrame([(1, "a"), (2, " "), (3, "d"), (4, None)], "id int, title string")
    at = F.col("id")
    rules = [
        *required("f", at, ["title"]), Row("r", "warning", at, F.concat(F.lit("n="), F.size("tags").cast("string")), F.size("tags") == 2), marked("m", at, "marker", F.col("body"), ("d:/",)),
        Each(F.col("tags"), lambda t, i: [Row("t", "error", at, F.concat(F.lit("tag "), i.cast("string")), t == "")]), counted("n", "rows", 5), counted("k", "ids", 3, "ids", F.count_distinct("id")),
        Total("s", "info", "all", lambda v: F.concat(F.lit("sum "), v["s"].cast("string")), {"s": F.sum("id")}, lambda v: v["s"] > 7), Once("u", at, "twice", ("id",)), Mirror("v", at, "differs", ("id",), ("title",), other),
    ]
    assert found(compiled(df, rules)) == sorted([
        ("f", "error", "2", "missing title"), ("f", "error", "2", "missing title"), ("r", "warning", "1", "n=2"), ("m", "error", "2", "marker"), ("m", "error", "3", "marker"), ("t", "error", "1", "tag 2"),
        ("n", "error", "rows", "expected 5 rows, got 4"), ("s", "info", "all", "sum 8"), ("u", "error", "2", "twice"), ("v", "error", "2", "differs"), ("v", "error", "3", "differs"), ("v", "error", "4", "differs"),
    ])
    assert found(compiled(df.limit(0), rules)) == sorted([("n", "error", "rows", "expected 5 rows, got 0"), ("k", "error", "ids", "expected 3 ids, got 0"), *[("v", "error", str(i), "differs") for i in (1, 2, 3, 4)]])
    with pytest.raises(TypeError):
        compiled(df, ["no rule"])


def test_release_of_clean_and_broken_files(spark):
    files = [("web/public/projects/a/project.json", 10, "{}"), ("web/public/projects/a/review_index.md", 10, "引文 " + "x" * 178 + "\n" + "y" * 400), ("README.md", 5, "fine"), ("web/src/x.ts", 5, "确定可走 rollout_ids"), ("data/ocr/x.md", 5, "MEMORY.md"), ("web/public/Book.PDF", 9, None), ("projects/a/public/review_pack/pages/1.png", 1, None), ("web/public/p.webp", 500_000, None), ("web/public/q.webp", 499_999, None)]
    projects = [("a", ["review_index.md", "gone.json", None]), ("b", None), ("", [])]
    args = (
        spark.createDataFrame(files, "path string, bytes long, text string"), spark.createDataFrame([(p.replace("/", "\\") + " ",) for p in R.IGNORED[1:]], "line string"),
        spark.createDataFrame(projects, "slug string, public_files array<string>"), spark.createDataFrame([("f", "s1", "q" * 121), ("f", None, "q" * 121), ("f", "s2", "q" * 120)], "path string, segment_id string, quote string"),
    )
    at = "web/public/projects/"
    assert found(R.release_boundary(*args)) == sorted([
        ("G22.private", "error", "web/public/Book.PDF", "private file in a public folder"), ("G22.scan", "error", "projects/a/public/review_pack/pages/1.png", "rendered review page in a public folder"),
        ("G22.image", "error", "web/public/p.webp", "large or page-numbered image in a public folder"), ("G22.excerpt", "warning", at + "a/review_index.md", "may contain long source excerpts"), ("G22.marker", "error", "web/src/x.ts", "internal marker: rollout_ids"),
        ("G22.copy", "error", "web/src/x.ts", "high-risk copy: 确定可走"), ("G22.ignore", "error", ".gitignore", "missing ignore pattern: projects/*/private/"), ("G22.project", "error", at + "index.json", "invalid project entry"),
        ("G22.list", "error", at + "b/project.json", "public_files must be a list"), ("G22.list", "error", at + "a/project.json", "public_files holds an entry without a name"), ("G22.missing", "error", at + "b/project.json", "missing project.json"),
        ("G22.missing", "error", at + "a/gone.json", "public file is missing"), ("G22.quote", "warning", "f", "s1 quote is 121 chars, over 120"), ("G22.quote", "warning", "f", "unknown quote is 121 chars, over 120"),
    ])


def test_preview_state_of_a_clean_release(spark):
    rows = spark.createDataFrame([("a.json", "Draft", "public-preview", "manual-review-pending", "{}")], "name string, status string, release_phase string, review_status string, body string")
    tasks = spark.createDataFrame([(k, str(i), None if i % 2 else " ") for k in ("tasks", "template") for i in range(95)], "kind string, task_id string, manual_result string")
    assert found(R.preview_state(rows, rows, tasks)) == []
    got = found(R.preview_state(rows, rows.limit(0), tasks.where("task_id <> '4' or kind = 'tasks'")))
    assert got == [("G39.blank", "error", "template", "expected 95 blank results, got rows=94 blank=94"), ("G39.mirror", "error", "a.json", "public and mirror differ")]


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path, small_blocks):
    r, want = random.Random(3), set()
    for name, n in (("a.txt", 300), ("b.txt", 1), ("c.txt", 77), ("empty.txt", 0)):
        lines = ["".join(r.choice("ab é ") for _ in range(r.randrange(60))) for _ in range(n)]
        (tmp_path / name).write_text("".join(x + r.choice(["\n", "\r\n"]) for x in lines), encoding="utf-8", newline="")
        want |= {(name, i, x) for i, x in enumerate(lines, 1)}
    lines = readers.numbered_lines(spark, f"file://{tmp_path}")
    assert lines.rdd.getNumPartitions() > 8
    assert {(x.file.rsplit("/", 1)[1], x.line, x.text) for x in lines.collect()} == want
    hits = readers.line_findings(lines, {"aa": "aa", "end": "b$"}).collect()
    assert sorted((h.file.rsplit("/", 1)[1], h.line, h.label) for h in hits) == sorted((f, i, p) for f, i, x in want for p in ("aa", "end") if (p in x if p == "aa" else x.endswith("b")))


def test_strict_lines_say_where_they_break(spark, tmp_path, small_blocks):
    rows = [json.dumps({"page": i, "text": "x" * (i % 70)}) for i in range(200)]
    rows[50] = "  "
    (tmp_path / "ok.jsonl").write_text("\n".join(rows))
    assert sorted(r.page for r in readers.jsonl_strict(spark, f"file://{tmp_path}/ok.jsonl", "page int, text string").collect()) == [i for i in range(200) if i != 50]
    rows[140] = '{"page": '
    (tmp_path / "bad.jsonl").write_text("\n".join(rows))
    with pytest.raises(Exception, match=r"Invalid JSONL at .*bad\.jsonl:141"):
        readers.jsonl_strict(spark, f"file://{tmp_path}/bad.jsonl", "page int, text string").collect()


def test_books_are_their_files_in_order(spark, tmp_path):
    from quillspark.sources import sinks

    rows = [(b, p, f"text {p} of {b}\n\n  " if p % 3 else None) for b in ("a", "b b") for p in range(1, 60)]
    pages = spark.createDataFrame(rows, "book string, page int, text string").repartition(7)
    sinks.write_books(sinks.page_entries(pages, "book", "page", "text", F.concat(F.lit("Book "), F.col("book"))), f"file://{tmp_path}/out")
    for b, folder in (("a", "book=a"), ("b b", "book=b b")):
        files = sorted((tmp_path / "out" / folder).glob("*.txt"))
        want = "\n".join([f"# Book {b}", "", *(x for bb, p, t in rows if bb == b for x in (f"<!-- page: {p} -->", f'<a id="p{p}"></a>', "", (t or "").rstrip()))]) + "\n"
        assert "".join(f.read_text() for f in files) == want
    assert sum(1 for _ in (tmp_path / "out").glob("*/*.txt")) > 2


def test_sections_are_put_in_once(spark):
    from quillspark.sources.sinks import with_section

    put = lambda t: spark.createDataFrame([(t,)], "t string").select(with_section(F.col("t"), "## M", F.lit("## M\n\n- x  \n")).alias("t")).first().t
    assert put(None) == put("  ") == "## M\n\n- x\n" and put("text \n") == "text\n\n## M\n\n- x\n" == put("text\n\n## M\nold\n## M\nolder")
