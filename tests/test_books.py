"""What is known of a book, on rows worked out by hand."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import books as B

META = "struct<title:string,creator:string,language:string,publisher:string,date:string,identifier:string,description:string>"
PAGES = "array<struct<page:bigint,text:string,char_count:bigint,needs_review:boolean>>"
BOOK = f"k int, title string, text string, pages {PAGES}, metadata {META}, chapters array<string>, source_type string, pdf_chars array<int>, epub boolean"
WORDS = {"a": (("x", 1),), "b": (("y", 2),), "c": (("z", 1),)}


def test_summaries(spark):
    rows = [
        (1, "stated", "body", None, ("T", None, None, "", None, "i", None), ["one", " ", None], "pdf", None, True),
        (2, "Stated title", None, [(1, "短名\n文", 3, True), (2, " ", 0, None), (3, None, None, None)], None, None, None, [29] * 10 + [1000], None),
        (3, None, "", None, (None, "", None, None, None, None, None), [], "", [], False),
        (4, "long", "远行记事与其他许多故事/张三 著\n" + "x" * 50 + "y" * 25 + "z" * 49, None, None, None, "pdf", [30, 30], True),
        (5, None, None, None, (None, None, "zh", None, None, None, None), None, None, None, None),
    ]
    got = {r.k: r for r in B.summaries(spark.createDataFrame(rows, BOOK), "k", WORDS).collect()}
    one, two, three, four, five = (got[k] for k in range(1, 6))
    assert (one.title, one.author, one.isbn, one.publisher, one.identity_status, one.source_type, one.chapter_candidates, one.language) == ("T", None, "i", None, "partial", "epub", 1, "en")
    assert (one.is_scanned_likely, one.total_pages, one.ocr_status.status, one.ocr_status.page_count) == (None, None, "available", None)
    assert (two.title, two.source_type, two.is_scanned_likely, two.total_pages, two.language) == ("Stated title", "scanned_pdf", True, 11, "zh-Hans")  # a short title that does not hold the stated one is not believed
    assert (two.ocr_status.page_count, two.ocr_status.needs_review_pages, two.ocr_status.empty_pages, two.ocr_status.average_chars) == (3, [1], [2, 3], 1.0)
    assert (three.identity_status, three.title, three.source_type, three.is_scanned_likely, three.total_pages, three.language, three.content_types) == ("unknown", None, "scanned_pdf", True, None, "unknown", [])
    assert (four.title, four.author, four.identity_status, four.is_scanned_likely, four.source_type, four.content_types) == ("远行记事与其他许多故事", "张三", "identified", False, "epub", ["a", "b"])
    assert (five.identity_status, five.title, five.ocr_status.status, five.source_type) == ("unknown", None, "missing", "unknown")  # a language alone is metadata, and is trusted


def test_no_books(spark):
    assert B.summaries(spark.createDataFrame([], BOOK), "k", WORDS).count() == 0


def test_a_text_is_counted_once_for_its_language(spark):
    texts = [" 　\n\t\x0b", "", "a", " a\n", " ", "山河 a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.is_blank(F.col("t")).alias("b"), (T.strip(F.col("t")) == "").alias("s"), T.script_language(F.col("t")).alias("l"))
    assert [(r.b, r.s) for r in df.collect()] == [(x, x) for x in (True, True, False, False, True, False)]
    assert [r.l for r in df.collect()] == ["unknown", "unknown", "en", "en", "unknown", "mixed"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[A-Za-z]") == 1
