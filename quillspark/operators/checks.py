"""Release gates: each rule is a query that yields findings (rule_id, severity, path, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("rule_id", "severity", "path", "message")


def rows_where(df: DataFrame, rule: str, severity: str, path: Column, message: str, broken: Column) -> DataFrame:
    """A finding for each row for which broken is true; null counts as not broken."""
    return df.where(F.coalesce(broken, F.lit(False))).select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), path.cast("string").alias("path"), F.lit(message).alias("message"))


def required(df: DataFrame, rule: str, path: Column, columns: list[str]) -> DataFrame:
    one = lambda c: rows_where(df, rule, "error", F.concat(path.cast("string"), F.lit("." + c)), "required", F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    return union([one(c) for c in columns])


def unique(df: DataFrame, rule: str, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return rows_where(counts, rule, "error", F.col(key), "not unique", F.col("n") > 1)


def allowed(df: DataFrame, rule: str, path: Column, column: str, values: tuple[str, ...]) -> DataFrame:
    return rows_where(df, rule, "error", path, f"{column} not allowed", ~F.coalesce(F.col(column), F.lit("")).isin(*values))


def longest(df: DataFrame, rule: str, path: Column, column: str, limit: int, severity: str = "warning") -> DataFrame:
    return rows_where(df, rule, severity, path, f"{column} over {limit}", F.length(column) > limit)


def consecutive(df: DataFrame, rule: str, part: str, order: str) -> DataFrame:
    placed = df.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(order)))
    return rows_where(placed, rule, "error", F.concat_ws("/", F.col(part).cast("string"), F.col(order).cast("string")), "out of order", F.col(order) != F.col("_n"))


def count_between(df: DataFrame, rule: str, path: str, low: int, high: int) -> DataFrame:
    return rows_where(df.agg(F.count(F.lit(1)).alias("n")), rule, "error", F.lit(path), f"count not in {low}..{high}", ~F.col("n").between(low, high))


def present(df: DataFrame, dim: DataFrame, rule: str, key: str) -> DataFrame:
    missing = df.select(key).distinct().join(dim.select(key).distinct(), key, "left_anti")
    return rows_where(missing, rule, "error", F.col(key), "unknown key", F.lit(True))


def mirrored(a: DataFrame, b: DataFrame, rule: str, path: Column) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted."""
    return rows_where(a.exceptAll(b), rule, "error", path, "not mirrored", F.lit(True)).unionByName(rows_where(b.exceptAll(a), rule, "error", path, "not in source", F.lit(True)))


def union(findings: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), findings)


def verdict(findings: DataFrame) -> DataFrame:
    """errors, warnings, infos and passed (no errors)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), (n("error") == 0).alias("passed"))
