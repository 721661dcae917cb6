"""Which strings contain which: an index over runs of characters in place of comparing all with all.

A string that contains another holds every run of Q characters of it (all of it, if it is shorter). So each needle is
looked up by one of its runs, the one that the fewest haystacks hold, and only what shares that run is compared. A needle
with a run that no haystack holds is out at once. Runs of needles alone are kept of the haystacks, so that the index grows
with what can match. A run that very many haystacks hold is not shuffled to one place: its haystacks stay where they are
read, and its needles come to them, where they are of a size to be sent.

Empty needles lie in every string; such pairs are not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.sources.kept import kept

#: Characters of a run.
Q = 8
#: A run that more haystacks hold than this is hot.
HOT = 100_000
#: A table is sent to every task only when its size estimate is under this.
BROADCAST_BYTES = 8 << 20


def sent(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if the optimiser's estimate of its size allows it; else Spark chooses a shuffle join."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def grams(text: Column, size: int) -> Column:
    """The distinct runs of so many characters: one pass of a pattern that matches at every place and takes up nothing."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _by_gram(strings: DataFrame, key: str, text: str, sizes: list[int], own: bool) -> DataFrame:
    """(key, gram). own: of each string only runs of its own size class, the longest that it has."""
    parts = []
    for n in sizes:
        rows = strings.where(F.least(F.length(text), F.lit(Q)) == n) if own else strings
        parts.append(rows.select(key, F.explode(grams(F.col(text), n)).alias("_gram")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contained(needles: DataFrame, needle_id: str, needle: str, hays: DataFrame, hay_id: str, hay: str, hot: int = HOT) -> DataFrame:
    """(needle_id, hay_id) where the hay contains the needle, each pair once for ids that are unique."""
    n = needles.select(needle_id, needle).where(F.col(needle) != "")
    h = hays.select(hay_id, hay)
    sizes = sorted(r[0] for r in n.select(F.least(F.length(needle), F.lit(Q))).distinct().collect())  # at most Q numbers
    if not sizes:
        return needles.sparkSession.createDataFrame([], StructType([n.schema[needle_id], h.schema[hay_id]]))
    runs = kept(_by_gram(n, needle_id, needle, sizes, own=True))
    postings = kept(_by_gram(h, hay_id, hay, sizes, own=False).join(sent(runs.select("_gram").distinct()), "_gram", "left_semi"))
    held = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
    # the rarest run of each needle; where one run is held by none, there is no row that counts it, and the needle is out
    rated = runs.join(held, "_gram", "left").groupBy(needle_id).agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("_held"), "_gram")).alias("_r"))
    keys = kept(rated.where("_r._held > 0").select(needle_id, "_r.*").join(n, needle_id))
    common = postings.join(keys.where(F.col("_held") <= hot), "_gram").select(needle_id, needle, hay_id)
    crowded = sent(keys.where(F.col("_held") > hot))
    candidates = common.unionByName(postings.join(crowded, "_gram").select(needle_id, needle, hay_id))
    return candidates.join(h, hay_id).where(F.contains(F.col(hay), F.col(needle))).select(needle_id, hay_id)
