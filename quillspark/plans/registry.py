"""Queries and the SQL that checks them, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under an operator's name."""

    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: Below this many bytes a core, a text table may be one row group, which one task would read and work through alone.
SPLIT_BYTES = 16 << 20


def table(spark, sf_dir: str, name: str):
    """The table; text that is small for the number of cores is dealt out evenly first, anything larger left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * SPLIT_BYTES:
        return df.repartition(cores)
    return df
