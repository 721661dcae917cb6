"""Aggregations: counts in first-seen order, zero-filled counts, pivots, indexes and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.windows import numbered_rows
from quillspark.sources.kept import kept


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """keys and an array of the distinct values, each where it first stands by order; nulls are left out, of equal places the lesser
    value comes first. Repeats shrink to one row a value before a key's values meet."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(value).alias("v"))))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def most_common(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, n, first_seen and place: most frequent first, ties by first occurrence."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")).cast("long"))


def zero_filled(df: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """A count for every value, 0 where none occurs; values not listed are not counted."""
    domain = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(key))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def result_pivot(tasks: DataFrame, group: str, result: str, groups: tuple[str, ...], results: tuple[str, ...]) -> DataFrame:
    """A row a group with total, blank, invalid and a column for each result; groups without rows too."""
    value = F.trim(F.coalesce(F.col(result), F.lit("")))
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(value == "").alias("blank"), F.count_if((value != "") & ~value.isin(*results)).alias("invalid")]
    aggs += [F.count_if(value == r).alias(r) for r in results]
    domain = tasks.sparkSession.range(1).select(F.explode(F.array(*[F.lit(g) for g in groups])).alias(group))
    counts = tasks.groupBy(group).agg(*aggs)
    names = ["total", "blank", "invalid", *results]
    return domain.join(counts, group, "left").select(group, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def inverted_index(df: DataFrame, labels: str, key: str, order: str, refs: int = 5) -> DataFrame:
    """label, n, the first keys in order, and a place by (most, label). Labels are taken apart once; a label's count is partly
    made, and its rows cut down to ``refs``, in each task before the shuffle, so that a hot label is no more than that."""
    pairs = kept(df.select(F.explode(F.array_distinct(labels)).alias("label"), F.col(order).alias("o"), F.col(key).alias("k")))
    counts = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = pairs.withColumn("_place", F.row_number().over(Window.partitionBy("label").orderBy("o", "k"))).where(F.col("_place") <= refs)
    first = placed.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("o", "k"))).alias("refs"))
    found = kept(counts.join(first, "label").select("label", "n", F.transform("refs", lambda r: r["k"]).alias("refs")))
    return numbered_rows(found, "place", [F.desc("n"), "label"], [-F.col("n"), F.substring("label", 1, 2)])


def first_seen_index(df: DataFrame, key: str, order: str, first: list[str], collect: str) -> DataFrame:
    """A row a key: the attributes of its first row, all values of ``collect`` in order (repeats too), and where it was first seen."""
    aggs = [F.min_by(c, order).alias(c) for c in first]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(collect).alias("v")))), lambda x: x["v"])
    return df.groupBy(key).agg(*aggs, listed.alias(collect), F.min(order).alias("first_seen"))


def roll_up(failed: Column, warned: Column) -> Column:
    return F.when(failed, "fail").when(warned, "warning").otherwise("pass")


def blockers(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """ready and the names of rules that any row breaks, in the order of rules: one pass over the rows."""
    broken = df.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"r{i}") for i, c in enumerate(rules.values())])
    names = F.filter(F.array(*[F.when(F.col(f"r{i}"), F.lit(n)) for i, n in enumerate(rules)]), lambda x: x.isNotNull())
    return broken.select((F.size(names) == 0).alias("ready"), F.array_join(names, "|").alias("blockers"))
