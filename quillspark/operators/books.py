"""What is known of a book, a row a book: identity, language, state of its pages, contents. One projection, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.identity import identity
from quillspark.operators.guide import either

#: How much of a book is looked at, and when a scan is likely or a title too short to be believed.
FRONT_PAGES, FRONT_CHARS, PROBED_PAGES, SCAN_CHARS, SHORT_TITLE, MOST_CHAPTERS = 20, 30_000, 10, 30, 8, 80
#: Fields of the package metadata and what they are called in an identity.
METADATA = {"title": "title", "creator": "author", "description": "publication_info", "publisher": "publisher", "date": "publication_date", "identifier": "isbn"}


def scanned(embedded: Column) -> Column:
    """Whether the first pages of a PDF hold so little text that they are scans; null without a PDF, true without pages."""
    sample = F.slice(embedded, 1, PROBED_PAGES)
    return F.when(embedded.isNotNull(), F.when(F.size(sample) == 0, True).otherwise(F.aggregate(sample, F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n, F.lit(0))) / F.size(sample) < SCAN_CHARS))


def merged_identity(metadata: Column, front: Column, stated: Column) -> Column:
    """The package metadata where any field is told, and then nothing else; without, what the front matter says, with the stated
    title in place of a short one that does not hold it."""
    told = F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(metadata[c] != "", F.lit(False)) for c in (*METADATA, "language")]), F.lit(False))
    trusted = F.struct(*[either(metadata[c]).alias(name) for c, name in METADATA.items()])

    def doubted(x: Column) -> Column:
        short = (F.length(x["title"]) <= SHORT_TITLE) & (stated != "") & ~F.contains(x["title"], stated)
        title = F.when(F.coalesce(short, F.lit(False)), stated).otherwise(x["title"])
        return F.struct(*[(title if name == "title" else x[name]).alias(name) for name in METADATA.values()])

    return F.when(told, trusted).otherwise(T.let(identity(front, stated), doubted))


def page_state(pages: Column, body: Column) -> Column:
    """status, page_count, needs_review_pages, empty_pages and average_chars of the pages (structs of page, text, char_count, needs_review)."""
    there = F.coalesce(pages, F.array().cast("array<struct<page:bigint,text:string,char_count:bigint,needs_review:boolean>>"))
    n = F.size(there).cast("long")
    numbers = lambda keep: F.transform(F.filter(there, keep), lambda p: p["page"])
    chars = F.aggregate(there, F.lit(0).cast("long"), lambda a, p: a + F.coalesce(p["char_count"].cast("long"), F.lit(0)))
    return F.struct(
        F.when((n > 0) | body.isNotNull(), "available").otherwise("missing").alias("status"), F.when(n > 0, n).alias("page_count"),
        numbers(lambda p: F.coalesce(p["needs_review"], F.lit(False))).alias("needs_review_pages"), numbers(lambda p: T.is_blank(F.coalesce(p["text"], F.lit("")))).alias("empty_pages"),
        F.when(n > 0, F.bround(chars / n, 2)).alias("average_chars"),
    )


def content_types(text: Column, kinds: dict[str, tuple[tuple[str, int], ...]], floor: int = 50, share: float = 0.08, most: int = 5) -> Column:
    """The kinds whose weighted keywords reach max(floor, share of the best), best first; the text is read once a keyword."""
    score = lambda ws: reduce(lambda a, b: a + b, [T.occurrences(text, F.lit(w)) * n for w, n in ws]).cast("long")
    scored = F.array(*[F.struct((-score(ws)).alias("under"), F.lit(k).alias("kind")) for k, ws in kinds.items()])

    def best(rows: Column) -> Column:
        top = F.array_min(F.transform(rows, lambda r: r["under"]))
        fit = F.filter(rows, lambda r: -r["under"] >= F.greatest(F.lit(floor), F.floor(-top * share)))
        return F.transform(F.slice(F.array_sort(fit), 1, most), lambda r: r["kind"])

    return T.let(scored, best)


def summaries(books: DataFrame, key: str, kinds: dict[str, tuple[tuple[str, int], ...]]) -> DataFrame:
    """One row a book. books: key, title (as stated), text (null: none), pages, metadata (a struct of package fields, or null),
    chapters (titles), source_type, pdf_chars (of each PDF page, or null), epub (whether the source is there)."""
    pages = F.coalesce("pages", F.array().cast("array<struct<page:bigint,text:string,char_count:bigint,needs_review:boolean>>"))
    text = F.coalesce(either(F.col("text")), F.array_join(F.transform(pages, lambda p: p["text"]), "\n"))
    head = F.when(F.size(pages) > 0, F.array_join(F.transform(F.slice(pages, 1, FRONT_PAGES), lambda p: p["text"]), "\n")).otherwise(F.substring(text, 1, FRONT_CHARS))
    scan = scanned(F.col("pdf_chars"))
    named = F.filter(F.coalesce("chapters", F.array().cast("array<string>")), lambda c: T.strip(F.coalesce(c, F.lit(""))) != "")
    x = books.select(
        key, merged_identity(F.col("metadata"), head, F.col("title")).alias("i"), page_state(F.col("pages"), F.col("text")).alias("o"), scan.alias("is_scanned_likely"),
        F.when(text != "", T.script_language(text)).otherwise("unknown").alias("language"), F.size(F.slice(named, 1, MOST_CHAPTERS)).cast("long").alias("chapter_candidates"), content_types(text, kinds).alias("content_types"),
        F.when(F.coalesce(scan, F.lit(False)), "scanned_pdf").when(F.coalesce("epub", F.lit(False)), "epub").otherwise(F.coalesce(either(F.col("source_type")), F.lit("unknown"))).alias("source_type"),
        F.coalesce(F.when(F.col("pdf_chars").isNotNull() & (F.size("pdf_chars") > 0), F.size("pdf_chars").cast("long")), F.when(F.size(pages) > 0, F.size(pages).cast("long"))).alias("total_pages"),
    )
    known = either(F.col("i.title")).isNotNull().cast("int") + either(F.col("i.author")).isNotNull().cast("int")
    status = F.element_at(F.array(F.lit("unknown"), F.lit("partial"), F.lit("identified")), known + 1)
    return x.select(key, status.alias("identity_status"), "i.*", "language", "source_type", "is_scanned_likely", "total_pages", F.col("o").alias("ocr_status"), "chapter_candidates", "content_types")
