"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort in each partition puts equals side by side,
and a pass over neighbours compares whole texts. The range key is (first bytes, hash, doc_id): it orders by content,
keeps equal texts in one unbroken run, and lets a run of any size be cut between partitions, so no group of copies is
gathered in one task. Runs that touch a partition's edge are then joined by digest: two rows a partition at most.

Defined cases: a null text counts as empty, and empty texts equal each other; rows that share a doc_id are one document
(they stay or go together, and group_size counts the rows); a null doc_id sorts last and such a row stays only if no row
with an id has its text; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import clean_docs, docs_table, partitions, written

#: Characters of the range key that are taken from the text itself; longer common beginnings are split by hash.
PREFIX = 64


def normalised(docs: DataFrame) -> DataFrame:
    """Each run of ASCII white space as one space. Single spaces, the common case, need no replacing."""
    return clean_docs(docs).select("doc_id", F.regexp_replace("text", r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ").alias("norm"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks a sorted partition and compares whole texts, next to next. Of a run, only ids and digests are held until it ends."""
    names = ["doc_id", "sha", "keep_id", "n", "edge", "part"]
    last, ids, shas, part, runs = None, [], [], 0, 0

    def flush(edge: bool) -> pa.RecordBatch:
        run, sha = pa.concat_arrays(ids), pa.concat_arrays(shas)
        k = len(run)
        return pa.RecordBatch.from_arrays([run, sha, run.take(pa.array(np.zeros(k, np.int64))), pa.array(np.full(k, k)), pa.array([edge] * k), pa.array([part] * k, pa.int32())], names)

    for b in batches:
        if b.num_rows == 0:
            continue
        text, doc, sha, part = b.column("norm").cast(pa.large_string()), b.column("doc_id"), b.column("sha"), b.column("part")[0].as_py()
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or last != text[0].as_py()
        last, starts = text[b.num_rows - 1].as_py(), np.flatnonzero(new)
        if not len(starts):
            ids.append(doc)
            shas.append(sha)
            continue
        if starts[0]:
            ids.append(doc[: starts[0]])
            shas.append(sha[: starts[0]])
        if ids:
            yield flush(runs == 0)
            runs += 1
        inner = slice(starts[0], starts[-1])
        size = np.diff(starts)
        if len(size):
            edge = np.repeat((np.arange(len(size)) + runs) == 0, size)
            yield pa.RecordBatch.from_arrays([doc[inner], sha[inner], doc.take(pa.array(np.repeat(starts[:-1], size))), pa.array(np.repeat(size, size)), pa.array(edge), pa.array([part] * len(edge), pa.int32())], names)
            runs += len(size)
        ids, shas = [doc[starts[-1] :]], [sha[starts[-1] :]]
    if ids:
        yield flush(True)


def dedup_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs."""
    n = partitions(docs.sparkSession)
    keys = [F.substring("norm", 1, PREFIX), F.xxhash64("norm"), F.col("doc_id").asc_nulls_last()]
    ordered = normalised(docs).repartitionByRange(n, *keys).sortWithinPartitions(keys[0], keys[1], F.col("norm"), keys[2])
    placed = ordered.select("doc_id", "norm", F.sha2("norm", 256).alias("sha"), F.spark_partition_id().alias("part"))
    rows = written(placed.mapInArrow(_runs, "doc_id long, sha string, keep_id long, n long, edge boolean, part int"), "exact")
    # the first and last run of each partition may go on next door: at most two rows a partition, so n bounds what is broadcast
    runs = rows.where("edge").groupBy("sha", "part").agg(F.min("keep_id").alias("keep_id"), F.max("n").alias("n"))
    met = runs.groupBy("sha").agg(F.min("keep_id").alias("all_keep"), F.sum("n").alias("all_n"))
    joined = rows.join(F.broadcast(met) if n <= 20_000 else met, "sha", "left")
    keep = F.coalesce(F.when(F.col("edge"), F.col("all_keep")), F.col("keep_id"))
    size = F.coalesce(F.when(F.col("edge"), F.col("all_n")), F.col("n")).cast("long")
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document stays, with their columns as they were."""
    kept = dedup_decisions(docs).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_keep"]), "left_semi")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_decisions(docs_table(spark, sf_dir))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
