"""Sources and exports as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import windows as W
from quillspark.plans.registry import query, table
from quillspark.sources import html as H
from quillspark.sources import readers as S
from quillspark.sources import sinks as K


@query("s11_html_blocks")
def s11(spark, d):
    return H.html_blocks(table(spark, d, "pages"), "page_id", "html")


@query("s11_html_headings", r"SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<(head|nav|aside|script|style)[ >].*?</(head|nav|aside|script|style)>', '', 'g'), '<h[1-6][^>]*>[^<]*\S[^<]*</h[1-6]>')) AS BIGINT) AS headings FROM pages WHERE headings > 0")
def s11h(spark, d):
    b = H.html_blocks(table(spark, d, "pages"), "page_id", "html")
    return b.groupBy("page_id").agg(F.count_if(F.col("kind") == "heading").alias("headings")).where("headings > 0")


@query("s5_pages_normalised", "SELECT doc_id AS page, text, CAST(length(text) AS BIGINT) AS char_count FROM documents")
def s5(spark, d):
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(F.lit(0)).cast("long").alias("char_count"))
    return S.normalised_pages(pages).withColumn("char_count", F.col("char_count").cast("long"))


@query("s14_markdown_section", r"WITH l AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc, unnest(range(1, len(ls) + 1)) AS ord, unnest(ls) AS line FROM l) SELECT doc, CAST(ord AS BIGINT) AS ord, line FROM u WHERE ord BETWEEN 2 AND 3 AND trim(line) <> ''")
def s14(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    shown = F.when(F.col("i") == 0, F.lit("## Notes")).when(F.col("i") == 3, F.lit("## Rest")).otherwise(F.col("line"))
    marked = lines.select("doc", (F.col("i") + 1).cast("long").alias("ord"), shown.alias("line"))
    return S.markdown_section(marked, "Notes")


@query("s15_report_value", "SELECT source, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY source")
def s15(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    report = counts.select("source", F.concat(F.lit("# Report\n- other: `x`\n- rows: `"), F.col("n").cast("string"), F.lit("`\n")).alias("text"))
    return report.select("source", S.report_value(F.col("text"), "rows").alias("value"))


@query("k3_csv_fields", "SELECT coalesce(CAST(n_nationkey AS VARCHAR), '') AS n_nationkey, n_name, '' AS notes FROM nation")
def k3(spark, d):
    return K.csv_fields(table(spark, d, "nation"), ["n_nationkey", "n_name", "notes"])


@query("k6_markdown_report", "SELECT '# Nations' || chr(10) || chr(10) || '- items: `' || count(*) || '`' || chr(10) || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation")
def k6(spark, d):
    return K.markdown_report(table(spark, d, "nation"), "Nations", F.col("n_name"), "n_nationkey")


@query("k8_mirror_diff", "SELECT r_regionkey, r_name, 'left' AS side FROM region WHERE r_regionkey = 2")
def k8(spark, d):
    r = table(spark, d, "region")
    return K.mirror_diff(r, r.where("r_regionkey <> 2"))


def flagship(spark, d):
    """Clean, flag, chunk and summarise documents by source: one plan, one small shuffle."""
    docs = table(spark, d, "documents").select("source", "text").withColumn("cleaned", T.clean_ocr_text(F.col("text")))
    chunks = docs.select("source", T.is_suspect(F.col("cleaned")).alias("suspect"), F.length("cleaned").alias("n"), W.chunk_plain(T.paragraphs(F.col("cleaned"), "\n"), 1200).alias("chunks"))
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count_if("suspect").alias("suspect_pages"), F.sum("n").cast("long").alias("chars"), F.sum(F.size("chunks")).cast("long").alias("chunks"))


query("flagship_summary")(flagship)
