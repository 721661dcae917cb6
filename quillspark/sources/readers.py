"""Readers: JSON lines in three tempers, JSON documents, CSV, Markdown sections, report key-values, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from quillspark.functions.text import strip
from quillspark.sources.kept import kept

PAGES = "page int, text string, char_count int, ocr_engine string, needs_review boolean, ocr_avg_score double"
SECTIONS = "section_id string, `order` int, title string, href string, text string, char_count int, paragraph_count int, chunk_count int"
CHUNKS = "chunk_id string, page_start int, page_end int, text string, char_count int"
DECISIONS = "task_id string, priority string, category string, target_id string, target_title string, manual_result string, notes string, reviewer string, reviewed_at string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and text of every line that is not JSON: what a strict reader reports."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return rows.where(F.try_parse_json("value").isNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of every line, however many blocks a file is read in.

    A block's lines are counted where they are read; only the blocks' counts, a row each, are summed up by file. The rows of a
    block stand together in one task, so the difference of their running ids to the block's first one is their place in it.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    blocks = lines.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = kept(blocks.select("file", "block", (before - F.col("_first") + 1).alias("_shift")))
    return lines.join(shifts, ["file", "block"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "text")


def line_findings(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """file, line, label, text: a row for each pattern that a line holds, in one pass over the lines."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(label)) for label, p in patterns.items()]))
    return lines.select("file", "line", F.explode(hits).alias("label"), strip(F.col("text")).alias("text"))


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines. Blank lines are skipped; the read fails at a line that is no JSON and says where that stands."""
    lines = numbered_lines(spark, path).where(strip(F.col("text")) != "")
    said = F.concat(F.lit("Invalid JSONL at "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    checked = lines.select(F.when(F.try_parse_json("text").isNull(), F.raise_error(said).cast("string")).otherwise(F.col("text")).alias("text"))
    return checked.select(F.from_json("text", schema).alias("_row")).select("_row.*")


def jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file is an empty table."""
    return jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def page_index(pages: DataFrame, order: str) -> DataFrame:
    """One row a page number: rows whose page is no number are skipped, of equal ones the last in order wins."""
    numbered = pages.withColumn("page", F.col("page").try_cast("int")).where("page IS NOT NULL")
    rest = [c for c in pages.columns if c != "page"]
    return numbered.groupBy("page").agg(F.max_by(F.struct(*rest), order).alias("_v")).select("page", "_v.*")


def normalised_pages(pages: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    given = F.coalesce("char_count", F.lit(0))
    return pages.withColumns({"text": text, "char_count": F.when(given == 0, F.length(text)).otherwise(given)})


def json_document(spark: SparkSession, path: str, schema: str, payload: str | None = None) -> DataFrame:
    """A whole-file JSON value; payload names an array whose items become the rows."""
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.inline(payload)) if payload else doc


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns strings, empty fields as empty strings, a byte-order mark before the header ignored."""
    head = spark.read.option("wholetext", False).text(path).limit(1).first()
    names = [] if head is None else next(__import__("csv").reader([head["value"].removeprefix("﻿")]))
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path).na.fill("")


def markdown_section(lines: DataFrame, heading: str, line: str = "line", order: str = "ord", doc: str = "doc") -> DataFrame:
    """Non-blank lines between ``## heading`` and the next ``## ``, of every document."""
    title = F.when(F.startswith(line, F.lit("## ")), F.trim(F.substr(F.col(line), F.lit(4))))
    under = F.last(title, ignorenulls=True).over(Window.partitionBy(doc).orderBy(order))
    marked = lines.withColumns({"_title": title, "_under": under})
    return marked.where((F.col("_under") == heading) & F.col("_title").isNull() & (F.trim(line) != "")).drop("_title", "_under")


def report_value(text, key: str):
    """The value of a line ``- key: `value```."""
    return F.regexp_extract(text, rf"(?m)^- {key}: `([^`]*)`\s*$", 1)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, suffix and size of every file below path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"), "size")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)
