"""SimHash near-dedup with a Gray-order hierarchical index.

A document's fingerprint has bit i set where over half of its 3-word shingles' XXH64 hashes have it. Fingerprints link at
RADIUS or fewer differing bits, and linked documents share a component.

The 64 bits are cut into six bands; two fingerprints that differ in three bits agree in three whole bands at least, so each
distinct fingerprint goes to one run for each choice of three bands (about 32 bits, which keeps runs short at any size).
In a run, fingerprints are sorted by Gray rank, so that neighbours share most bits, and grouped level by level; an upper
node keeps the bits that all below it share. Node pairs are compared from the top: differences in shared bits add up to a
lower bound that prunes both groups at once, and where the bits not shared cannot exceed the radius, both groups are
linked without comparing their members. Groups already joined are not compared again, so a run of many near copies costs
no square of its size, and each run hands on a spanning forest instead of its pairs. Components of the forests are then
found by alternating large and small stars.

Defined cases: null texts count as empty; a text without words has fingerprint zero and links like any other; fewer than
three words make one shingle; rows that repeat share their component; a null doc_id never names a component unless all of
its members are null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import clean_docs, discard, docs_table, partitions, written

SEED = 42
SHINGLE = 3
RADIUS = 3
BANDS = (11, 11, 11, 11, 10, 10)
FAN = 8
#: Node pairs that are held at a time, and rows of runs that are taken together.
CHUNK = 1 << 19
ROWS = 1 << 18

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxh64(buf: bytes, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the slices of buf, all at once: slices with equally many words of 8 bytes go through the same steps."""
    raw = buf + bytes(8)
    word = np.ndarray((len(buf) + 1,), "<u8", raw, strides=(1,))
    half = np.ndarray((len(buf) + 1,), "<u4", raw, strides=(1,))
    byte = np.frombuffer(raw, np.uint8)
    out = np.empty(len(start), np.uint64)
    lanes = size // 8
    order = np.argsort(lanes, kind="stable")
    edges = np.searchsorted(lanes[order], np.arange(int(lanes.max(initial=0)) + 2))
    for n in range(len(edges) - 1):
        for a in range(edges[n], edges[n + 1], 1 << 15):
            at = order[a : min(a + (1 << 15), edges[n + 1])]
            out[at] = _xxh64_group(word, half, byte, start[at], size[at], n, seed)
    return out


def _xxh64_group(word, half, byte, at, size, lanes, seed):
    mixed = lambda acc, x: _rotated(acc + x * _P2, 31) * _P1
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        if lanes >= 4:
            acc = [np.full(len(at), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for stripe in range(lanes // 4):
                acc = [mixed(acc[k], word[at + 32 * stripe + 8 * k]) for k in range(4)]
            h = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
            for x in acc:
                h = (h ^ mixed(np.zeros_like(x), x)) * _P1 + _P4
        else:
            h = np.full(len(at), s + _P5, np.uint64)
        h = h + size.astype(np.uint64)
        for k in range(lanes // 4 * 4, lanes):
            h = _rotated(h ^ mixed(np.uint64(0), word[at + 8 * k]), 27) * _P1 + _P4
        at, left = at + 8 * lanes, size - 8 * lanes
        four = left >= 4
        h = np.where(four, _rotated(h ^ (half[at].astype(np.uint64) * _P1), 23) * _P2 + _P3, h)
        at, left = at + 4 * four, left - 4 * four
        for k in range(3):
            h = np.where(left > k, _rotated(h ^ (byte[np.minimum(at + k, len(byte) - 1)].astype(np.uint64) * _P5), 11) * _P1, h)
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def votes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The majority bits of each run of hashes. Counters stand in the eight bytes of a word, 255 hashes at most a counter."""
    size = np.diff(np.append(begin, len(h)))
    pieces = -(-size // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(begin - 255 * first, pieces) + 255 * np.arange(int(pieces.sum()))
    out = np.zeros(len(begin), np.uint64)
    lane = np.uint64(0x0101010101010101)
    for bit in range(8):
        counts = np.add.reduceat((h >> np.uint64(bit)) & lane, at).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts.astype(np.int64), first, axis=0)
        for byte in range(8):
            out |= (2 * counts[:, byte] > size).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """bytes.lower and bytes.split know ASCII only, as the contract wants it."""
    out = np.zeros(len(texts), np.uint64)
    held, rows, total = [], [], 0

    def flush() -> None:
        buf = b" ".join(held)
        size = np.array([len(x) for x in held], np.int64)
        base = np.cumsum(size + 1) - size - 1
        gap = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
        begin = np.concatenate([[0], gap + 1])  # of words
        end = np.append(gap, len(buf))
        word = np.searchsorted(begin, base)  # first word of each text
        count = np.diff(np.append(word, len(begin)))
        shingles = np.maximum(count - SHINGLE + 1, 1)
        first = np.cumsum(shingles) - shingles
        w = np.repeat(word - first, shingles) + np.arange(int(shingles.sum()))
        last = np.minimum(w + SHINGLE - 1, np.repeat(word + count - 1, shingles))
        out[rows] = votes(xxh64(buf, begin[w], end[last] - begin[w]), first)

    for i, text in enumerate(texts):
        joined = b" ".join(text.encode().lower().split())
        if joined:
            held.append(joined)
            rows.append(i)
            total += len(joined)
        if total > 4 << 20:
            flush()
            held, rows, total = [], [], 0
    if held:
        flush()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints_of(b.column("text").to_pylist()).view(np.int64))], ["doc_id", "fp"])

    return clean_docs(docs).mapInArrow(run, "doc_id long, fp long")


def band_masks() -> list[int]:
    edges = [sum(BANDS[:i]) for i in range(len(BANDS) + 1)]
    bands = [((1 << BANDS[i]) - 1) << edges[i] for i in range(len(BANDS))]
    masks = [sum(c) for c in combinations(bands, len(BANDS) - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(fp: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(k))
    return fp


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: everyone's smallest reachable member."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return label
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while not np.array_equal(deeper := label[label], label):
            label = deeper
    return label


def link_runs(run: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """run: sorted, each with two members or more; fp: by Gray rank within a run. The first linked member of each."""
    levels = [{"all": fp, "any": fp, "run": run, "low": np.arange(len(fp)), "high": np.arange(len(fp)) + 1, "leaf": np.arange(len(fp))}]
    while True:
        top = levels[-1]
        begin = np.flatnonzero(np.append(True, top["run"][1:] != top["run"][:-1]))
        size = np.diff(np.append(begin, len(top["run"])))
        if (size == 1).all():
            break
        within = np.arange(len(top["run"])) - np.repeat(begin, size)
        low = np.flatnonzero(within % FAN == 0)
        high = np.append(low[1:], len(within))
        levels.append({"all": np.bitwise_and.reduceat(top["all"], low), "any": np.bitwise_or.reduceat(top["any"], low), "run": top["run"][low], "low": low, "high": high, "leaf": top["leaf"][low]})
    for x in levels:
        x["same"] = ~(x["all"] ^ x["any"])
        x["end"] = np.append(x["leaf"][1:], len(fp))
    label = np.arange(len(fp))
    roots = np.arange(len(levels[-1]["run"]))
    grid_a, grid_b = np.repeat(np.arange(FAN), FAN), np.tile(np.arange(FAN), FAN)
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        depth, i, j = stack.pop()
        step = CHUNK // FAN**2 if depth else CHUNK  # a pair of upper nodes becomes FAN² pairs
        if len(i) > step:
            stack += [(depth, i[step:], j[step:]), (depth, i[:step], j[:step])]
            continue
        x = levels[depth]
        shared = x["same"][i] & x["same"][j]
        least = np.bitwise_count((x["all"][i] ^ x["all"][j]) & shared)
        near = least <= RADIUS
        i, j, shared, least = i[near], j[near], shared[near], least[near]
        if depth == 0:
            label = unite(label, i, j)
            continue
        low_label, high_label = np.minimum.reduceat(label, x["leaf"]), np.maximum.reduceat(label, x["leaf"])
        joined = (low_label[i] == high_label[i]) & (low_label[j] == high_label[j]) & (low_label[i] == low_label[j])
        whole = ~joined & (least + np.bitwise_count(~shared) <= RADIUS)
        for side in (i[whole], j[whole]):
            count = x["end"][side] - x["leaf"][side]
            leaves = np.repeat(x["leaf"][side] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            label = unite(label, np.repeat(x["leaf"][i[whole]], count), leaves)
        i, j = i[~joined & ~whole], j[~joined & ~whole]
        a, b = x["low"][i][:, None] + grid_a, x["low"][j][:, None] + grid_b
        wanted = (a < x["high"][i][:, None]) & (b < x["high"][j][:, None]) & ((i != j)[:, None] | (a < b) | ((a == b) & (depth > 1)))
        if wanted.any():
            stack.append((depth - 1, a[wanted], b[wanted]))
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band choice, key): the spanning forest of each run's links."""

    def forest(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fresh = np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
        run = np.cumsum(fresh) - 1
        more = np.bincount(run)[run] > 1
        run, fp = run[more], fp[more].view(np.uint64)
        order = np.lexsort((gray_rank(fp), run))
        run, fp = run[order], fp[order]
        label = link_runs(run, fp) if len(fp) else np.zeros(0, np.int64)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    rows, wanted = 0, ROWS
    for b in batches:
        held.append(tuple(b.column(c).to_numpy() for c in ("choice", "key", "fp")))
        rows += b.num_rows
        if rows < wanted:
            continue
        choice, key, fp = (np.concatenate(x) for x in zip(*held))
        ends = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield forest(choice[:cut], key[:cut], fp[:cut])
        held, rows = [(choice[cut:], key[cut:], fp[cut:])], len(fp) - cut
        wanted = max(ROWS, 2 * rows)  # a run that goes on is copied as often as it doubles
    if held:
        yield forest(*(np.concatenate(x) for x in zip(*held)))


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that span the same components as all pairs within RADIUS."""
    n = partitions(fps.sparkSession)
    masks = F.array(*[F.lit(m) for m in band_masks()])
    sent = fps.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("choice", "key"))
    return sent.repartition(n, "choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_forest, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges a, b, by large and small stars in turn.

    ``low`` names its key by an expression, so that it is dealt anew for the join: Spark can then split a hub's links.
    """
    least = lambda a, b: F.least(F.col(a), F.col(b))
    dealt = F.col("a").bitwiseXOR(F.lit(0)).alias("hub")
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), least("a", "b").alias("b")).distinct(), "star")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(dealt, least("m", "a").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("hub")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(dealt, "m")
        small = large.join(low, F.col("a") == F.col("hub")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        last, edges = edges, written(small.select("e.*").where("a <> b").distinct(), "star")
        discard(last)
        # the same rows as before: each node hangs from its root
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for every row."""
    rows = written(fingerprints(docs), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(fps.select("fp")))
    rooted = fps.join(found, fps.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document names its component, with their columns as they were."""
    kept = near_duplicates(docs).where("doc_id = component_id OR component_id IS NULL").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_keep"]), "left_semi")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(docs_table(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
