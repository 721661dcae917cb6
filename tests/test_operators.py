"""Operators on hand-made rows."""

import io
import zipfile

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.udf import window_ratio
from quillspark.operators import joins as J
from quillspark.operators import review as R
from quillspark.operators import windows as W
from quillspark.sources import html as H
from quillspark.sources import readers, sinks
from quillspark.streaming import review_events


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c(F.col("t")).alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_clean_text_drops_page_numbers_and_ornaments(spark):
    text = "第一行　　文字 ， 好\r\n - 12 - \n||\n\n\n\nend"
    r = one(spark, text, T.clean_ocr_text, T.cleaning_notes)
    assert r.c0 == "第一行 文字，好\n\nend"
    assert r.c1 == ["removed isolated page number", "removed ornamental noise"]
    assert one(spark, None, T.clean_ocr_text).c0 == ""
    assert one(spark, "第一行，\n 第二行。 第三 ！\nx", T.clean_ocr_text).c0 == "第一行，第二行。第三！x"


def test_clean_text_is_idempotent(spark):
    once = one(spark, "a  b\n\n\n\n 7 \nc ", T.clean_ocr_text).c0
    assert one(spark, once, T.clean_ocr_text).c0 == once


def fold(parts, budget):
    out, held, n = [], [], 0
    for p in parts:
        if held and n + len(p) > budget:
            out.append("\n\n".join(held))
            held, n = [], 0
        held.append(p)
        n += len(p)
    return out + (["\n\n".join(held)] if held else [])


def test_plain_chunks_equal_the_loop(spark):
    cases = [[], ["a"], ["a" * 10, "b" * 10], ["a" * 11, "b"], ["x" * 50], ["a" * 4, "b" * 4, "c" * 4, "d" * 9]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ps array<string>")
    got = {r.i: list(r.c) for r in df.select("i", W.chunk_plain(F.col("ps"), 10).alias("c")).collect()}
    assert got == {i: fold(c, 10) for i, c in enumerate(cases)}


def test_sliced_chunks_cut_what_is_too_long(spark):
    df = spark.createDataFrame([([(1, "a" * 5), (1, "b" * 25), (2, "c" * 4), (3, "d" * 3)],)], "ps array<struct<page:int,text:string>>")
    got = [(c.first_page, c.last_page, c.text) for c in df.select(W.chunk_sliced(F.col("ps"), 10).alias("c")).first().c]
    assert got == [(1, 1, "aaaaa"), (1, 1, "b" * 10), (1, 1, "b" * 10), (1, 1, "b" * 5), (2, 3, "cccc\n\nddd")]


def test_keep_first_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "o int, k string")
    assert sorted(r.o for r in W.keep_first(df, ["k"], ["o"]).collect()) == [1, 3, 4]
    assert sorted(r.o for r in W.duplicates_in_order(df, ["k"], ["o"]).collect()) == [2, 5]


def test_html_blocks_in_both_tempers():
    page = "<html><head><meta charset='x'><title>no</title></head><body><h1>Head</h1><p>one <b>two</b></p><script>x</script>tail</body></html>"
    assert H.blocks_of(page) == [("heading", 1, "Head"), ("paragraph", 0, "one two"), ("paragraph", 0, "tail")]
    assert H.blocks_of(page, strict=True) == []
    assert H.blocks_of("<p>a</p>tail", strict=True) == [("paragraph", 0, "a")]
    assert H.blocks_of("") == []
    assert H.blocks_of("<p>one<h2>Head</h2>two</p>") == [("heading", 2, "Head"), ("paragraph", 0, "onetwo")]  # a heading ends no paragraph
    assert H.blocks_of("<h1>lost<h2>Kept</h2><p>x<h3>open") == [("heading", 2, "Kept"), ("paragraph", 0, "x")]
    assert H.blocks_of("</nav><nav><aside>a</aside>b</nav><p>c\nd</p>") == [("paragraph", 0, "c d")]
    assert H.blocks_of("<meta/><p>c\n \td</p>", strict=True) == [("paragraph", 0, "c\n d")]
    assert H.blocks_of("<table><tr><td>a</td><td>b</td></tr></table>") == [("paragraph", 0, "a"), ("paragraph", 0, "b")]


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>')
        z.writestr("OEBPS/b.opf", '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title><dc:identifier>id1</dc:identifier></metadata><manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("OEBPS/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint playOrder="1"><navLabel><text>Named</text></navLabel><content src="t/a.xhtml#x"/></navPoint></navMap></ncx>')
        z.writestr("OEBPS/t/a.xhtml", "<html><head/><body><h2>Own</h2><p>Text one.</p><p>Two.</p></body></html>")
    return out.getvalue()


def test_epub_sections(spark):
    df = spark.createDataFrame([("x.epub", bytearray(epub()))], "path string, content binary")
    r = H.epub_sections(df).collect()
    assert [(x.section_id, x.title, x.text, x.paragraph_count, x.book_title) for x in r] == [("sec-001", "Named", "Text one.\n\nTwo.", 2, "Book")]


def test_epub_with_a_navigation_page_and_lost_items():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{h}" media-type="{m}"/>' for i, h, m in (("a", "a.xhtml", H.XHTML), ("gone", "gone.xhtml", H.XHTML), ("css", "c.css", "text/css"), ("b", "../b.xhtml", H.XHTML), ("v", "toc/nav.xhtml", H.XHTML)))
        refs = "".join(f'<itemref idref="{i}"/>' for i in ("unlisted", "gone", "css", "a", "b"))
        z.writestr("b.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        z.writestr("toc/nav.xhtml", f'<nav><a href="../a.xhtml#top">Named <b>so</b></a><a href="../b.xhtml">{"x" * 201}</a></nav>')
        z.writestr("a.xhtml", "<h1>Own</h1><p>A.</p>")
        z.writestr("b.xhtml", "<h3>Third</h3><p>B.</p>")
    got = H.epub_sections_of(out.getvalue())
    assert [(r["section_id"], r["title"], r["text"], r["book_title"]) for r in got] == [("sec-004", "Named so", "A.", None), ("sec-005", "Third", "B.", None)]
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("META-INF/container.xml", "<container/>")
    assert H.epub_sections_of(bare.getvalue()) == []


def test_csv_keeps_empty_strings_and_drops_the_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"a ""q"", b"\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, f"file://{tmp_path}/a.csv").collect()] == [("1", 'a "q", b'), ("2", "")]


def test_jsonl_tempers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"page": 1, "text": "x"}\n\nnot json\n')
    assert [r.value for r in readers.jsonl_bad_lines(spark, f"file://{tmp_path}/a.jsonl").collect()] == ["not json"]
    assert readers.jsonl_or_empty(spark, f"file://{tmp_path}/none.jsonl", readers.PAGES).count() == 0


def test_page_index_last_wins(spark):
    df = spark.createDataFrame([("1", "a", 1), ("x", "b", 2), ("1", "c", 3), (None, "d", 4)], "page string, text string, o int")
    assert [(r.page, r.text) for r in readers.page_index(df, "o").collect()] == [(1, "c")]


def test_json_document_and_csv_fields(spark):
    df = spark.createDataFrame([(2, "b"), (1, None)], "o int, v string")
    assert sinks.json_document(df, "rows", "o", version="1").first().json == '{"version":"1","rows":[{"o":1},{"o":2,"v":"b"}]}'
    assert [tuple(r) for r in sinks.csv_fields(df, ["v", "w"]).collect()] == [("b", ""), ("", "")]


def test_gazetteer_prefers_exact_then_first(spark):
    names = spark.createDataFrame([("Rome",), ("Old Rome town",), ("zz",), ("",)], "name string")
    gaz = spark.createDataFrame([(2, "Rome"), (1, "Old"), (3, "Paris")], "ord int, entry string")
    got = {r.name: (r.entry, r.how) for r in J.gazetteer_match(names, gaz).collect()}
    assert got == {"Rome": ("Rome", "exact"), "Old Rome town": ("Old", "substring"), "zz": (None, "missing"), "": (None, "missing")}


def test_window_ratio():
    assert window_ratio("abc def", "xx abc def yy") == 1.0
    assert window_ratio("", "abc") == 0.0
    assert 0.8 < window_ratio("the quick brown fox jumps", "say the quick brawn fox jumps now") < 1.0


def test_window_ratio_is_the_best_of_all_windows():
    """Worked out with the quote first, over the five widths and a step of a fifth, as the fixed values say."""
    import difflib
    import random

    r = random.Random(8)
    for _ in range(60):
        quote, text = ("".join(r.choice("abcd ") for _ in range(n)) for n in (r.randint(2, 40), r.randint(1, 120)))
        n, windows = len(quote), [text]
        if n > 3:
            windows = [text[a : a + w] for w in (n, int(n * 0.75), int(n * 0.9), int(n * 1.1), int(n * 1.35)) for a in range(0, max(len(text) - w, 0) + 1, max(1, n // 5))]
        best = 1.0 if quote in text else max(difflib.SequenceMatcher(None, quote, w).ratio() for w in windows)
        assert abs(window_ratio(quote, text) - best) < 1e-12


def test_claims_keep_decimals_and_drop_what_says_nothing(spark):
    long = "一" * 30 + "，" + "二" * 20
    r = one(spark, f"全程3.5公里，海拔1200.5米。 无 ；None；{long}：，，。", T.claims).c0
    assert r == ["全程3.5公里，海拔1200.5米", "一" * 30, "二" * 20]
    assert one(spark, None, T.claims).c0 == [] and one(spark, "书中未明示", T.claims).c0 == []


def test_anchors_of_road_codes_names_and_numbers(spark):
    t = "沿 G 108 和 s12 到 Old  Town，再走 109 线 3 小时 4.5 公里，共 2 次"
    assert one(spark, t, lambda c: T.anchors(c, ("old town", "nowhere"), ("公里", "old-town"))).c0 == ["old town", "公里", "G108", "S12", "109", "108", "12", "4.5"]
    assert one(spark, "", lambda c: T.anchors(c, ("a",))).c0 == []


def test_claims_are_audited_by_five_rules(spark):
    from quillspark.operators import evidence as E

    text = "we left the Old Town by road G108 and walked to the river bank before noon with heavy bags"
    cases = {
        "The old-town by ROAD": "direct", "Old Town g": "anchor", "Old Town, left by the road G 108, on foot": "anchors", "Old Town 77 88 99": "none", "nowhere": "none",
        "tiny": "short", "the Old Town was left by roads and walks": "similar", "walkers to the river bank before a noon with heavy bag": "similar", "zzzz qqqq xxxx jjjj vvvv kkkk": "none", "…": "empty",
    }
    claims = spark.createDataFrame([(1, c) for c in cases] + [(2, "left the Old Town")], "seg int, claim string")
    pages = spark.createDataFrame([(7, text), (8, "other")], "page int, text string")
    refs = spark.createDataFrame([(1, 7), (1, 7), (1, 8)], "seg int, page int")
    got = {(r.seg, r.claim): r.support for r in E.audited_claims(claims, E.evidence_text(refs, pages, "seg", "page", "text"), "seg", ("Old Town", "nowhere")).collect()}
    assert got.pop((2, "left the Old Town")) == "none"
    assert {c: s for (_, c), s in got.items()} == cases


def test_numbered_rows_and_first_rows(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "o int, k int").repartition(5)
    assert sorted((r.o, r.n) for r in W.numbered_rows(df, "n", [F.desc("o")], [F.floor(-F.col("o") / 10)]).collect()) == [(i, 101 - i) for i in range(101)]
    got = W.first_rows(df, ["k"], ["o"], 4, "o", salts=3).collect()
    want = {k: sorted(i * 7 % 101 for i in range(101) if i % 3 == k)[:4] for k in range(3)}
    assert {k: sorted(r.o for r in got if r.k == k) for k in range(3)} == want


def test_numbers_wider_than_their_field_stay_whole(spark):
    tasks = spark.range(1200).select(F.format_string("T%05d", "id").alias("id"), F.lit("P0").alias("priority"), F.col("id").alias("o"))
    wanted = spark.createDataFrame([("P0-100",), ("P0-1000",)], "ref string")
    assert {r.ref: r.id for r in R.resolve_task(tasks, wanted, "id", "priority", "o").collect()} == {"P0-100": "T00099", "P0-1000": "T00999"}


def test_every_reference_is_compared_with_its_page(spark, tmp_path):
    from quillspark.plans.domain_queries import j8

    texts = {i: " ".join(f"word{(i * 7 + k * k) % 31}x{k}" for k in range(12 + i)) for i in range(13)} | {13: "short", 14: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda t: "".join(t.lower().split())
    want = set()
    for i, t in texts.items():
        quote = key(t[19:44] + "zq" + t[46:71])
        score = 1.0 if quote in key(t) else window_ratio(quote, key(t))
        near = 0.78 if len(quote) < 30 else 0.72
        want.add((i, "found" if quote in key(t) else "approximate" if score >= near else "citation_mismatch", round(score, 4)))
    assert {tuple(r) for r in j8(spark, str(tmp_path)).collect()} == want


def test_decisions_are_all_or_nothing(spark):
    tasks = spark.createDataFrame([("a", ""), ("b", ""), ("c", "pass"), ("d", "")], "id string, current string")
    bad = spark.createDataFrame([("a", 1, "pass", ""), ("a", 2, "fail", "n"), ("x", 3, "pass", ""), ("c", 4, "fail", "n"), ("b", 5, "", ""), ("d", 6, "", "why")], "id string, o int, result string, notes string")
    judged = R.judged_decisions(bad, tasks, "id", "o", ("pass", "fail"), ("fail",))
    assert {r.o: r.problem for r in judged.collect()} == {1: None, 2: "duplicate id", 3: "unknown id", 4: "already decided", 5: None, 6: "result missing"}
    assert not any(r.updated for r in R.apply_decisions(tasks, judged, "id", dry_run=False).collect())
    good = judged.where("o = 1 or o = 5")
    assert {r.id: r.current for r in R.apply_decisions(tasks, good, "id", dry_run=False).collect()} == {"a": "pass", "b": "", "c": "pass", "d": ""}
    assert not any(r.updated for r in R.apply_decisions(tasks, good, "id").collect())


def test_task_aliases(spark):
    tasks = spark.createDataFrame([("T-a", "P0", 1), ("T-b", "P0", 2)], "id string, priority string, o int")
    wanted = spark.createDataFrame([("T-a",), ("P0-002",), ("none",)], "ref string")
    assert {r.ref: r.id for r in R.resolve_task(tasks, wanted, "id", "priority", "o").collect()} == {"T-a": "T-a", "P0-002": "T-b"}


def test_resolve_href_folds_dots(spark):
    assert one(spark, "../img/./a.png", lambda c: T.resolve_href(F.lit("OEBPS/text/x.html"), c)).c0 == "OEBPS/img/a.png"


def test_stream_counts_each_event_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = "SELECT id AS event_id, CAST('2024-01-01 00:00:00' AS timestamp_ntz) + make_dt_interval(0, 0, CAST(id AS int), 0) AS ts, id AS user_id, 'click' AS event_type, 1.0D AS value, '' AS props FROM range(40)"
    spark.sql(rows).coalesce(1).write.parquet(f"file://{src}")
    spark.sql(rows).coalesce(1).write.mode("append").parquet(f"file://{src}")
    counts = review_events.windowed_counts(review_events.event_stream(spark, f"file://{src}"))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"file://{out}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r.window_start): r.n for r in spark.table("counts").collect()}
    assert got["2024-01-01 00:00:00"] == 10 and all(n == 10 for n in got.values())


def test_quotes_are_found_without_regard_to_form_and_marks(spark):
    pages = spark.createDataFrame([(1, "Ｔｈｅ　old-town, by the river."), (2, None)], "page int, text string")
    refs = spark.createDataFrame([(1, "1", "THE OLD TOWN"), (2, "1", "…"), (3, "2", "x"), (4, "9", "x"), (5, "no", "x"), (6, None, "x"), (7, "1", "old townes by a river"), (8, "1", "zzzzzz")], "r int, page string, quote string")
    got = {r.r: r.status for r in J.quote_status(refs, pages).collect()}
    assert got == {1: "found", 2: "empty_quote", 3: "citation_mismatch", 4: "missing_page", 5: "invalid_page", 6: "missing_ref_field", 7: "approximate", 8: "citation_mismatch"}


def test_the_query_goes_past_a_blank_to_the_next_value(spark):
    from quillspark.plans import catalogue

    sql = catalogue.oracle_sql()["t37_first_truthy"]
    assert "nullif(trim(" in sql
    named = catalogue.queries()["t37_first_truthy"](spark, "/root/testdata/sf0.001").where("doc_id % 2 = 0")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 AND lang <> '' THEN lang ELSE source END AS want")
    assert named.join(docs, "doc_id").where("NOT named <=> want").count() == 0 and named.count() > 0


def test_pages_of_a_batch_are_parsed_in_parts():
    import pyarrow as pa

    texts = ["<p>a</p>" * 10, None, "<p>b</p>" * 500, "", "<p>c</p>", "<p>d</p>"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["k", "html"])
    parts = list(H.parts_of(batch, 1, 100))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist() and [p.num_rows for p in parts] == [2, 1, 3]
    assert list(H.parts_of(batch.slice(0, 0), 1)) == []


def test_only_the_best_of_a_kind_are_dealt_out(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice("abcz"), rng.randrange(9), i) for i in range(300)]
    got = W.diversified(spark.createDataFrame(rows, "p int, kind string, score int, o int"), ["p"], "kind", ("b", "a"), "score", "o", 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before the first exchange and after it
    for p in range(3):
        best = sorted((r for r in rows if r[0] == p), key=lambda r: (-r[2], r[3]))
        firsts = [next(r for r in best if r[1] == k) for k in "ba"]
        want = (firsts + [r for r in best if r not in firsts])[:4]
        assert [tuple(r)[:4] for r in got.where(f"p = {p}").orderBy("place").collect()] == want
