"""Ordered and stateful row operators. Every one takes an explicit order column; none relies on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values of a whole-number key that numbered_rows numbers together.
NUMBERED_TOGETHER = 1 << 17


def numbered_rows(df: DataFrame, name: str, order: list, buckets: list[Column]) -> DataFrame:
    """df with the place of each row, from 1, in a total order.

    buckets: what the order begins with, coarse enough to be few and fine enough that a bucket fits a task. Rows are
    numbered within buckets; only the buckets' sizes, one row each, meet in one task.
    """
    keyed = df.withColumn("_bucket", F.struct(*buckets))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")).select("_bucket", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return keyed.withColumn("_place", place).join(sizes, "_bucket").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).select(*df.columns, name)


def first_rows(df: DataFrame, keys: list[str], order: list, most: int, salt, salts: int = 32) -> DataFrame:
    """The first ``most`` rows of each key. A hot key is cut down in ``salts`` parts first, by the hash of salt."""
    def cut(rows: DataFrame, *part) -> DataFrame:
        return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("_place") <= most).drop("_place")

    return cut(cut(df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts))), *keys, "_salt").drop("_salt"), *keys)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate of structs, so duplicates shrink before the shuffle."""
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    return df.groupBy(*keys).agg(F.min(row).alias("_row")).select(*[F.col(f"_row.{c}") for c in df.columns])


def duplicates_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The second and later rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank > 1").drop("_rank")


def navigation(df: DataFrame, part: list[str], order: str, key: str) -> DataFrame:
    """Adds position, total, and the keys before and after."""
    w = Window.partitionBy(*part)
    o = w.orderBy(order)
    return df.withColumns({"position": F.row_number().over(o).cast("long"), "total": F.count(F.lit(1)).over(w), "previous": F.lag(key).over(o), "following": F.lead(key).over(o)})


def fixed_bucket(position: Column, size: int, buckets: int) -> Column:
    """Buckets of a fixed size, the last takes the rest (ntile would even them out)."""
    return F.least(F.floor((position - 1) / size), F.lit(buckets - 1)).cast("long")


def chunk_plain(parts: Column, budget: int) -> Column:
    """Greedy chunks of whole parts within a budget of characters; separators do not count, no part is cut."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("n"))

    def add(acc: Column, p: Column) -> Column:
        full = (acc["n"] + F.length(p) > budget) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.array_join(acc["open"], "\n\n"))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.array_append(acc["open"], p)).alias("open"),
            F.when(full, F.length(p)).otherwise(acc["n"] + F.length(p)).alias("n"),
        )

    close = lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], "\n\n"))).otherwise(acc["done"])
    return F.aggregate(parts, start, add, close)


def chunk_sliced(parts: Column, budget: int, gap: int = 2) -> Column:
    """Greedy chunks where a separator counts gap characters and a part over the budget is flushed and cut hard.

    parts: array<struct<page, text>>; result: array<struct<first_page, last_page, text>>.
    """
    item = "struct<first_page:bigint,last_page:bigint,text:string>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))

    def chunk(acc: Column) -> Column:
        return F.struct(acc["first"].alias("first_page"), acc["last"].alias("last_page"), acc["text"].alias("text"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.array_append(acc["done"], chunk(acc))).otherwise(acc["done"])

    def slices(p: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p["text"]) / budget) - 1, F.lit(0)).cast("int"))
        return F.transform(cuts, lambda i: F.struct(p["page"].cast("long").alias("first_page"), p["page"].cast("long").alias("last_page"), F.substr(p["text"], i * budget + 1, F.lit(budget)).alias("text")))

    def add(acc: Column, p: Column) -> Column:
        size, page = F.length(p["text"]), p["page"].cast("long")
        huge = size > budget
        fits = ~huge & ((acc["n"] == 0) | (acc["n"] + size + gap <= budget))
        grown = F.when(acc["n"] > 0, F.concat(acc["text"], F.lit("\n" * gap), p["text"])).otherwise(p["text"])
        return F.struct(
            F.when(huge, F.concat(flushed(acc), slices(p))).when(fits, acc["done"]).otherwise(flushed(acc)).alias("done"),
            F.when(huge, F.lit("")).when(fits, grown).otherwise(p["text"]).alias("text"),
            F.when(huge, F.lit(0)).when(fits & (acc["n"] > 0), acc["n"] + size + gap).otherwise(size).alias("n"),
            F.when(fits & (acc["n"] > 0), acc["first"]).otherwise(page).alias("first"),
            page.alias("last"),
        )

    return F.aggregate(parts, start, add, flushed)


def runs_with_start(df: DataFrame, order: str, score: str, strong: int, weak: int, part: list[str]) -> DataFrame:
    """Rows of weak score or better that stand in an unbroken run of such rows at or after a strong one; adds hit.

    A run is a stretch of consecutive values of the integer column ``order`` within the columns ``part``.
    """
    weak_rows = df.where(F.col(score) >= weak)
    island = F.col(order) - F.row_number().over(Window.partitionBy(*part).orderBy(order))
    placed = weak_rows.withColumn("_island", island)
    so_far = F.max((F.col(score) >= strong).cast("int")).over(Window.partitionBy(*part, "_island").orderBy(order))
    return placed.withColumn("hit", so_far == 1).where("hit").drop("_island")


def out_of_order(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """Rows whose order column is not their place, from 1."""
    return df.withColumn("expected", F.row_number().over(Window.partitionBy(*part).orderBy(order)).cast("long")).where(F.col(order) != F.col("expected"))


def role_by_place(i: Column, n: Column) -> Column:
    return F.when(n == 1, "core").when(i == 0, "start").when(i == n - 1, "end").otherwise("via")


def diversified(df: DataFrame, part: list[str], kind: str, kinds: tuple[str, ...], score: str, order: str, k: int) -> DataFrame:
    """Up to k rows a part: the best of each kind, in the order of kinds, then the best of the rest. Adds place, from 1.

    The best has the highest score, then the lowest order. Only the k best of a kind can be among a part's k rows, so each task
    cuts its rows down to those before they are dealt out; what is left of a part meets in one sort. No row is collected.
    """
    best_of_kind = F.row_number().over(Window.partitionBy(*part, kind).orderBy(F.desc(score), order))
    kind_rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col(kind)), F.lit(0))
    wanted = (F.col("_best") == 1) & (F.col("_kind") > 0)
    best = df.withColumn("_best", best_of_kind).where(F.col("_best") <= k)
    ranked = best.withColumn("_kind", kind_rank).withColumn("_turn", F.when(wanted, F.col("_kind")).otherwise(F.lit(len(kinds) + 1)))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("_turn", F.when(F.col("_turn") > len(kinds), -F.col(score)), order))
    return ranked.withColumn("place", place.cast("long")).where(F.col("place") <= k).drop("_best", "_kind", "_turn")
