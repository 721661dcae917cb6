"""Greedy chunks across the pages of a book of any size.

Where a chunk begins depends on all before it, but only through one number: how full the open chunk is. So a run of pages is a
function of that number, and few of its values differ: either all parts of the run still fit, or a chunk begins at one of the
first parts, and from there on all is settled. Runs are ranges of (book, page); each works out its function by itself, one row a
run is folded in order, and each run then numbers its parts. Only lengths pass through Python; texts meet a chunk at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.kept import kept


def pages_chunked(pages: DataFrame, budget: int, gap: int = 2) -> DataFrame:
    """book, chunk (from 1), first_page, last_page, text: parts in order, joined by gap line ends, up to budget characters with them;
    a part over the budget is flushed and cut hard.

    pages: book, page (a whole number, unique in its book), parts (strings). Null and empty parts, and pages without a page, are
    left out; a null book is a book. The lengths of parts are written to the shared folder, in ranges of (book, page).
    """
    said = F.filter(F.coalesce("parts", F.array().cast("array<string>")), lambda p: F.coalesce(p != "", F.lit(False)))
    whole = pages.where("page IS NOT NULL").select("book", F.col("page").cast("long").alias("page"), said.alias("parts"))
    sizes = whole.select("book", "page", F.transform("parts", F.length).alias("sizes")).repartitionByRange("book", "page")
    runs = kept(sizes.withColumn("run", F.spark_partition_id()))
    book = runs.schema["book"]

    def functions(table: pa.Table) -> pa.Table:
        return pa.table({"book": table.column("book")[:1], "run": table.column("run")[:1], **{k: pa.array([v]) for k, v in Run(table, budget, gap).function().items()}})

    def entered(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        filled, begun, at, before = 0, 0, [], []
        for row in table.to_pylist():
            at.append(filled)
            before.append(begun)
            filled, more = _after(row, filled)
            begun += more
        return pa.table({"book": table.column("book"), "run": table.column("run"), "filled": pa.array(at, pa.int64()), "begun": pa.array(before, pa.int64())})

    def numbers(key, table: pa.Table, state: pa.Table) -> pa.Table:
        run = Run(table, budget, gap)
        found = run.numbers(state.column("filled")[0].as_py(), state.column("begun")[0].as_py())
        return pa.table({"book": run.table.column("book"), "page": run.table.column("page"), "numbers": pa.ListArray.from_arrays(pa.array(run.offsets, pa.int32()), pa.array(found))})

    kind = book.dataType.simpleString()
    answers = "total long, upto array<long>, exits array<long>, counts array<long>"
    states = runs.groupBy("book", "run").applyInArrow(functions, f"book {kind}, run int, {answers}").groupBy("book").applyInArrow(entered, f"book {kind}, run int, filled long, begun long")
    placed = runs.groupBy("book", "run").cogroup(states.groupBy("book", "run")).applyInArrow(numbers, f"book {kind}, page long, numbers array<long>")
    w, n = whole.alias("w"), placed.alias("n")
    j = w.join(n, F.col("w.book").eqNullSafe(F.col("n.book")) & (F.col("w.page") == F.col("n.page"))).select("w.book", "w.page", F.posexplode(F.arrays_zip("w.parts", "n.numbers")).alias("i", "p"))
    text = F.col("p.parts")
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / budget) - 1, F.lit(0)).cast("int"))
    pieces = j.withColumn("k", F.explode(cuts)).select("book", (F.col("p.numbers") + F.col("k")).alias("chunk"), "page", "i", F.substr(text, F.col("k") * budget + 1, F.lit(budget)).alias("text"))
    inside = F.array_sort(F.collect_list(F.struct("page", "i", "text")))
    return pieces.groupBy("book", "chunk").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.array_join(F.transform(inside, lambda x: x["text"]), "\n" * gap).alias("text"))


class Run:
    """The lengths of a run's parts in order, and for each part where the next chunk begins if one begins with it."""

    def __init__(self, table: pa.Table, budget: int, gap: int):
        self.table = table.sort_by("page")
        sizes = self.table.column("sizes").combine_chunks()
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in sizes])])
        size = np.asarray(sizes.flatten(), np.int64)
        self.budget, n = budget, len(size)
        self.huge = size > budget
        self.sum = np.concatenate([[0], np.cumsum(size + gap)])
        self.began = np.where(self.huge, -(-size // budget), 1)
        wall = np.append(np.where(self.huge, np.arange(n), n), n)  # the first huge part from each on
        self.wall = np.minimum.accumulate(wall[::-1])[::-1]
        fits = np.searchsorted(self.sum, self.sum[:-1] + budget + gap, "right") - 1
        self.next = np.where(self.huge, np.arange(1, n + 1), np.minimum(fits, self.wall[:-1]))
        self.open = np.where(self.huge, 0, self.sum[-1] - self.sum[:-1] - gap)  # how full a chunk is that reaches the end

    def first_break(self, filled) -> np.ndarray:
        """The first part that does not fit into a chunk so full."""
        return np.where(np.asarray(filled) > 0, np.minimum(np.searchsorted(self.sum, self.budget - np.asarray(filled), "right") - 1, self.wall[0]), 0)

    def function(self) -> dict:
        """upto, exits, counts: a chunk filled up to this leaves one so full, and so many begin; an exit of -1 adds total."""
        n = len(self.next)
        exits, counts = np.append(self.open, -1), np.append(self.began, 0)
        for i in range(n - 1, -1, -1):
            k = self.next[i]
            if k < n:
                exits[i], counts[i] = exits[k], counts[k] + self.began[i]
        last = min(int(np.searchsorted(self.sum, self.budget - 1, "right")) - 1, int(self.wall[0]))
        j = np.arange(last, -1, -1)  # the fuller the chunk, the earlier its break; the least of upto, 0, is for an empty one
        upto = np.append(0, self.budget - self.sum[j])
        at = np.append(0, j)
        return {"total": int(self.sum[-1]), "upto": upto.tolist(), "exits": exits[at].tolist(), "counts": counts[at].tolist()}

    def numbers(self, filled: int, begun: int) -> np.ndarray:
        n, more = len(self.next), np.zeros(len(self.next), np.int64)
        i = int(self.first_break(filled))
        while i < n:
            more[i] = self.began[i]
            i = int(self.next[i])
        so_far = np.cumsum(more)
        return begun + np.where(more > 0, so_far - more + 1, so_far)


def _after(row: dict, filled: int) -> tuple[int, int]:
    """(how full the open chunk is behind the run, how many chunks begin in it)."""
    k = int(np.searchsorted(row["upto"], filled, "left"))
    out = row["exits"][k]
    return (filled + row["total"] if out < 0 else out), row["counts"][k]
