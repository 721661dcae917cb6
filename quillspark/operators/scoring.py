"""Keyword scores and the suggestions drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def type_scores(docs: DataFrame, key: str, text: str, kinds: dict[str, tuple[tuple[str, int], ...]]) -> DataFrame:
    """key, kind, score: weighted keyword occurrences, summed. Counted row by row and aggregated before the shuffle."""
    score = lambda ws: reduce(lambda a, b: a + b, [T.occurrences(F.col(text), F.lit(w)) * n for w, n in ws])
    wide = docs.groupBy(key).agg(*[F.sum(score(ws)).alias(k) for k, ws in kinds.items()])
    return wide.unpivot([key], list(kinds), "kind", "score")


def suggest_types(scores: DataFrame, key: str, floor: int = 50, share: float = 0.08, most: int = 5) -> DataFrame:
    """The kinds that reach max(floor, share of the key's best), best first."""
    best = scores.withColumn("top", F.max("score").over(Window.partitionBy(key)))
    kept = best.where(F.col("score") >= F.greatest(F.lit(floor), F.floor(F.col("top") * share)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "kind"))
    return kept.withColumn("place", place.cast("long")).where(F.col("place") <= most).select(key, "kind", "score", "place")
