"""Best-fit packing of documents into sequences by exact-complement hashing, on counts of lengths.

Only a histogram of piece lengths (at most one entry a length) reaches the driver. There the index of single, pair and
triple sums finds combinations that exactly fill the gap beside a piece, and takes each as often as its lengths last;
what is left is packed best fit. The plan is a few thousand slots, each a run of ranks among the pieces of one length.
A piece finds its place from its rank alone: its number within its task, and the counts of the tasks before.

Defined cases: null and empty texts have one token, the closing id 0; rows that repeat are packed one by one; a null
doc_id is kept as it is; an empty table gives an empty result; texts of any length are tokenised and packed whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.common import clean_docs, docs_table, written

CAPACITY = 2048
END_ID = 0

#: Characters that NFC leaves alone whatever stands beside them within this set, and whose lower case is one character
#: that does not depend on its neighbours. Texts of only these are lower-cased here; others go to the library.
_PLAIN = re.compile("[^\u0000-įı-˿Ѐ-ҁҊ-ӿ‐-‧‰-⁞€、-〩ぁ-ゖ゠-ヿ一-鿿]")


def lower_ids(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text by the lower-casing word vocabulary at path."""
    v = bpe.load(path)
    odd = [i for i, t in enumerate(texts) if not t.isascii() and _PLAIN.search(t)]
    strange = {}
    if odd:
        from tokenizers import Tokenizer

        library = bpe.cached(("library", path), lambda: Tokenizer.from_file(path))
        library.no_truncation()
        library.no_padding()
        strange = {i: np.array(library.encode(texts[i], add_special_tokens=False).ids, np.int32) for i in odd}
    for i, ids in enumerate(bpe.encode_batch(v, ["" if i in strange else t for i, t in enumerate(texts)], str.lower)):
        yield strange.get(i, ids)


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: its digest, its length, and its number among the pieces of that length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc, piece, start, length, crc, number = [], [], [], [], [], []
            for i, ids in enumerate(lower_ids(path, b.column("text").to_pylist())):
                ids = np.append(ids, END_ID).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    number.append(seen[len(cut)])
                    seen[len(cut)] += 1
            n = len(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, number)], pa.array([part] * n, pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "number", "part"],
            )

    return clean_docs(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, number long, part int")


class Plan:
    """Patterns of lengths and how often each is used."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._exact()
        self._best_fit()

    def _take(self, parts: tuple[int, ...]) -> bool:
        """Uses the pattern as often as its lengths last."""
        lengths, each = np.unique(parts, return_counts=True)
        times = int((self.count[lengths] // each).min())
        if times > 0:
            self.count[lengths] -= times * each
            self.patterns.append((parts, times))
        return times > 0

    def _pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths of that sum, the longer as long as can be."""
        if total < 2:
            return None
        a = np.arange(total - 1, (total - 1) // 2, -1)
        b = total - a
        hit = np.flatnonzero((self.count[a] > 0) & (self.count[b] > 0) & ((a != b) | (self.count[a] > 1)))
        return (int(a[hit[0]]), int(b[hit[0]])) if len(hit) else None

    def _triple(self, total: int) -> tuple[int, int, int] | None:
        """Three available lengths of that sum; the index of pair sums tells which thirds can be completed."""
        here = (self.count > 0).astype(np.int64)
        pairs = np.convolve(here, here)[: self.capacity + 1] > 0
        third = np.flatnonzero(here[:total])[::-1]
        for a in third[pairs[total - third]]:
            self.count[a] -= 1
            found = self._pair(total - int(a))
            self.count[a] += 1
            if found:
                return (int(a), *found)
        return None

    def _exact(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.count[length]:
                gap = self.capacity - length
                if gap == 0:
                    self._take((length,))
                    continue
                self.count[length] -= 1  # the piece whose gap is filled is not there to fill it
                rest = (gap,) if self.count[gap] > 0 else self._pair(gap) or self._triple(gap)
                self.count[length] += 1
                if not rest or not self._take((length, *rest)):
                    break

    def _best_fit(self) -> None:
        """Best fit, longest first, on groups of alike sequences: the pieces of a length fill a sequence before the next."""
        open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for length in range(self.capacity, 0, -1):
            left = int(self.count[length])
            self.count[length] = 0
            while left:
                gap = min((g for g in open_at if g >= length), default=0)
                parts, times = open_at[gap].pop() if gap else ((), -(-left // (self.capacity // length)))
                if gap and not open_at[gap]:
                    del open_at[gap]
                room = (gap or self.capacity) // length
                full = min(times, left // room)
                more = left - full * room if full < times else 0
                for k, n in ((room, full), (more, 1 if more else 0), (0, times - full - (1 if more else 0))):
                    if n:
                        grown = parts + (length,) * k
                        open_at.setdefault(self.capacity - sum(grown), []).append((grown, n))
                left -= full * room + more
        self.patterns += [x for group in open_at.values() for x in group if x[0]]

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length, first rank), and for each the first sequence, the offset and the number of pieces."""
        used, rows, sequence = np.zeros(self.capacity + 1, np.int64), [], 0
        for parts, times in self.patterns:
            at = 0
            for length in parts:
                rows.append((length, used[length], sequence, at, times))
                used[length] += times
                at += length
            sequence += times
        rows.sort()
        length, low, first, at, times = np.array(rows, np.int64).reshape(-1, 5).T
        return (length << 48) + low, first, at, times


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces as tokenised_pieces gives them, written; adds sequence_id and offset."""
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_task = written(by_task, "pack-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, first, place, times = Plan(counts, capacity).slots()
    from pyspark.sql import Window

    # a row for each task and length grows with the input: joined by shuffle, never broadcast
    before = by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("part", "length", F.coalesce("base", F.lit(0)).alias("base")).hint("merge"), ["part", "length"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("number").to_numpy() + b.column("base").to_numpy()
            at = np.searchsorted(keys, (b.column("length").to_numpy() << 48) + rank, "right") - 1
            within = rank - (keys[at] & ((1 << 48) - 1))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(first[at] + within), pa.array(place[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return packed(written(tokenised_pieces(docs, path, capacity), "pack-pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
