"""What the training-data operators share: the shared work folder, written tables, sizes."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the text contracts name it.
SPACE = r"[\x20\x09-\x0D]"


def docs_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """The named input table, by a path that only Spark need be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quill-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path): works for every store that Spark can open."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() once nothing reads it any more."""
    fs, p = filesystem(df.sparkSession, df._quill_path)
    fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate; for file scans it is taken from the file sizes, without a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def block_count(df: DataFrame, block_bytes: int, least: int) -> int:
    """How many hash blocks of about block_bytes df's texts make; where the optimiser knows no size, a job sums it."""
    size = input_bytes(df)
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, math.ceil(size / block_bytes))


def clean_docs(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id as long, the text with null as empty, and the named columns; anything else is pruned from the scan."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)
