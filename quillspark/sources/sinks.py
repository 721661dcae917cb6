"""Sinks: JSON lines, JSON documents, CSV, Markdown reports, mirrors. Reports are one row; tables stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import rstrip, strip


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """Lines in order of a column across the files' names, in as many files as there are partitions."""
    (df.orderBy(order) if order else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_document(df: DataFrame, payload: str, order: str, **constants: str) -> DataFrame:
    """One row with a column json: the constants, and the rows of df in order under payload. For reports, not for tables."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("_r")))), lambda x: x["_r"])
    head = [F.lit(v).alias(k) for k, v in constants.items()]
    return df.agg(rows.alias("_rows")).select(F.to_json(F.struct(*head, F.col("_rows").alias(payload))).alias("json"))


def csv_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named fields in that order; what df lacks, and nulls, are empty."""
    return df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    csv_fields(df, fields).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def markdown_report(items: DataFrame, title: str, line: Column, order: str, none: str = "None") -> DataFrame:
    """One row: a heading, a count, and a bullet an item in order."""
    bullets = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: F.concat(F.lit("- "), x["t"]))
    body = F.coalesce(F.nullif(F.array_join(bullets, "\n"), F.lit("")), F.lit(none))
    return items.agg(F.concat(F.lit(f"# {title}\n\n- items: `"), F.count(F.lit(1)).cast("string"), F.lit("`\n\n"), body, F.lit("\n")).alias("markdown"))


def mirror_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted; no rows: they mirror each other."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def page_entries(pages: DataFrame, book: str, page: str, text: str, title: Column) -> DataFrame:
    """book, place and entry of Markdown books: a heading, then each page behind its anchors, in order of place."""
    number = F.col(page).cast("string")
    entry = F.concat(F.lit("<!-- page: "), number, F.lit(' -->\n<a id="p'), number, F.lit('"></a>\n\n'), rstrip(F.coalesce(F.col(text), F.lit(""))))
    heads = pages.select(F.col(book).alias("book"), title.alias("title")).groupBy("book").agg(F.min("title").alias("title"))
    return heads.select("book", F.lit(None).cast("long").alias("place"), F.concat(F.lit("# "), "title", F.lit("\n")).alias("entry")).unionByName(pages.select(F.col(book).alias("book"), F.col(page).cast("long").alias("place"), entry.alias("entry")))


def write_books(entries: DataFrame, path: str) -> None:
    """Entries as text, a folder a book (book=...). They are ranged by book and place, so a book's files follow each other by name,
    and one that is large for a task is several files; put together in that order they are the book. Nothing is gathered."""
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["book", F.col("place").asc_nulls_first()]
    ranged = entries.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranged.select("book", "entry").write.partitionBy("book").text(path)


def with_section(document: Column, marker: str, section: Column) -> Column:
    """The document with the section, which begins with the marker, as its end: in place of what stood from the marker on, else
    behind the text. The same section put in again changes nothing, but that one without text before it gets its two line breaks."""
    text, new = F.coalesce(document, F.lit("")), F.concat(rstrip(section), F.lit("\n"))
    before = F.when(F.contains(text, F.lit(marker)), F.concat(rstrip(F.substring_index(text, marker, 1)), F.lit("\n\n")))
    return F.concat(F.coalesce(before, F.when(strip(text) != "", F.concat(rstrip(text), F.lit("\n\n"))), F.lit("")), new)
