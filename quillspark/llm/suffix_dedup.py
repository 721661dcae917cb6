"""Suffix-array dedup: a depth-limited radix sort that orders suffixes only through their first DEPTH bytes.

Every window of DEPTH bytes is a suffix cut at the threshold; windows that sort equal are exactly the repeats. The sort
goes by most significant digits, and after each digit only groups that hold two documents go on:

* The first digit of a window is its least k-mer by hash (its anchor), taken with its place in the window. Windows beside
  one another share an anchor, so one entry stands for a dozen windows, and equal windows always have equal anchors.
  The entry also carries the whole stretch that the anchor's windows cover: where all entries of an anchor have the same
  stretch, all their windows are equal and the group is settled.
* Only where stretches differ (the edges of repeats) does the sort go on. The second digit is the 40 bytes around the
  anchor that all windows of one third of the offsets share, the third digit the whole window of DEPTH bytes.

Digits are compared by hash: 48 bits beside the bucket's for the digit, and 48 more of the stretch or of a second hash.

Documents lie in blocks by a hash of doc_id. A block sends each distinct digit once, with its smallest doc_id, so groups of
copies of any size shrink to one entry a block before they meet, and gets back two bits an entry.

Defined cases: null texts count as empty; texts shorter than DEPTH bytes lose nothing; rows that share a doc_id are one
document, so they do not make each other repeats; rows with a null doc_id come back whole and count nowhere; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm.common import block_count, clean_docs, docs_table, partitions

DEPTH = 50
#: Bytes of an anchor.
K = 24
#: Bytes of a block, as the optimiser estimates the input; its text may be a few times that.
BLOCK_BYTES = 2 << 20
#: Places in a block take the low bits beside the hash when anchors are chosen.
_PLACE = np.uint64((1 << 32) - 1)

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX[3]
    x ^= x >> np.uint64(29)
    x *= _MIX[4]
    x ^= x >> np.uint64(32)
    return x


def _joined(parts: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        out = _mixed(out * _MIX[0] + p)
    return out


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    return np.ndarray((max(len(buf) - 7, 0),), "<u8", buf.data, strides=(1,))


def _kmer(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = a * _MIX[0]
    x ^= x >> np.uint64(31)
    x += b * _MIX[1]
    x ^= x >> np.uint64(29)
    x += c * _MIX[2]
    return _mixed(x)


#: Bytes of text whose hashes and anchors are worked out at a time.
CHUNK = 1 << 19


class Block:
    """The texts of a block, in order of doc_id, and their anchors."""

    def __init__(self, table: pa.Table):
        doc = table.column("doc_id").to_numpy()
        self.order = order = np.argsort(doc, kind="stable")
        text = table.column("text").cast(pa.large_binary()).combine_chunks().take(pa.array(order))
        self.doc = doc[order]
        self.at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8).copy() if len(text) else np.zeros(1, np.int64)
        raw = np.frombuffer(text.buffers()[2], np.uint8) if self.at[-1] else np.zeros(0, np.uint8)
        self.buf = np.concatenate([raw[self.at[0] : self.at[-1]], np.zeros(8, np.uint8)])
        self.at -= self.at[0]
        self.size = np.diff(self.at)
        self.anchors()

    def kmers(self, at: np.ndarray) -> np.ndarray:
        """64 bits for the K bytes from each place on."""
        word = _words(self.buf)
        return _kmer(word[at], word[at + 8], word[at + 16])

    def anchors(self) -> None:
        """place: of each anchor; low, high: its first and last window; hash, stretch: its bytes and its windows'; owner: its row."""
        found, row = [], 0
        while row < len(self.size):  # whole texts of CHUNK bytes together, or a stretch of a longer one
            end = max(int(np.searchsorted(self.at, self.at[row] + CHUNK, "right")) - 1, row + 1)
            at, size = self.at[row:end], self.size[row:end]
            if size[0] > CHUNK:  # an anchor cut in two here has a stretch of its own, and so goes on to single windows
                starts = np.arange(0, size[0] - DEPTH + 1, CHUNK)
                found += [self._anchors(row, at + s, np.minimum(size - s, CHUNK + DEPTH - 1)) for s in starts]
            elif size.max() >= DEPTH:
                found.append(self._anchors(row, at, size))
            row = end
        none = np.zeros(0, np.int64)
        parts = [np.concatenate(x) for x in zip(*found)] if found else [none] * 4 + [none.astype(np.uint64)] * 2
        self.place, self.low, self.high, self.owner, self.hash, self.stretch = parts

    def _anchors(self, row: int, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        base, spread = at[0], DEPTH - K + 1
        word, at = _words(self.buf[base : at[-1] + size[-1] + 8]), at - base
        n = len(word) - K
        h = _kmer(word[:n], word[8 : n + 8], word[16 : n + 16])
        least = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
        width = 1
        while width < spread:
            step = min(width, spread - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        inside = np.zeros(len(least) + 1, np.int8)  # is there a whole window of one text from here on?
        long = size >= DEPTH
        np.add.at(inside, at[long], 1)
        np.add.at(inside, at[long] + size[long] - DEPTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        anchor = (least[starts] & _PLACE).astype(np.int64)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(fresh)
        low, high, anchor = starts[first], starts[np.append(first[1:], len(starts)) - 1], anchor[first]
        stop = high + DEPTH
        stretch = _joined([h[low], h[low + K], h[stop - 2 * K], h[stop - K], ((anchor - low) << 8 | (stop - anchor)).astype(np.uint64)], 1)
        return anchor + base, low + base, high + base, np.searchsorted(at, low, "right") - 1 + row, h[anchor], stretch


def _distinct(key: np.ndarray, doc: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ascends. (first place of each distinct key, key number of each place, do ``more`` differ, do docs differ)."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    begin = np.flatnonzero(fresh)
    first = order[begin]
    group = np.cumsum(fresh) - 1
    differ = lambda x: np.logical_or.reduceat(x[order] != x[first][group], begin) if len(begin) else np.zeros(0, bool)
    by_place = np.argsort(first, kind="stable")
    number = np.empty(len(begin), np.int64)
    number[by_place] = np.arange(len(begin))
    of = np.empty(len(key), np.int64)
    of[order] = number[group]
    return first[by_place], of, differ(more)[by_place] if more is not None else np.zeros(len(begin), bool), differ(doc)[by_place]


def _squeeze(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), kind)


def _dealt(bucket: np.ndarray, count: int) -> list[np.ndarray]:
    """The places of each bucket's entries, in order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, count)))


def _two_bits(codes: np.ndarray) -> bytes:
    padded = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).astype(np.uint8).reshape(-1, 4)
    return (padded << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()


def _from_two_bits(raw: bytes, n: int) -> np.ndarray:
    return ((np.frombuffer(raw, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)[:n]


#: What a block is told of an entry: nobody else has it; all its rows repeat an earlier document; all but its first
#: document do; the digit is shared, but the stretches differ.
ALONE, LATER, FIRST, MIXED = range(4)

_SENT = "bucket int, block int, keys binary, checks binary, docs binary, flags binary"
_TOLD = "block int, bucket int, codes binary"


def _rows(out: list[tuple], names: str) -> pa.Table:
    fields = [f.split(" ") for f in names.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    cols = list(zip(*out)) if out else [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, cols)})


def repeats_removed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256; with carry instead _row, the columns of docs but text,
    and text, what stays. The columns then travel with the texts, so that nothing need be joined to them again."""
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    base = clean_docs(docs.withColumn("_row", F.struct(*others)), "_row") if carry else clean_docs(docs)
    n = partitions(spark)
    blocks = block_count(base, BLOCK_BYTES, n)
    placed = base.where("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition(n, "block")
    buckets = max(n, blocks // 4)

    def send_anchors(table: pa.Table) -> pa.Table:
        b = Block(table)
        a = Digits(b.hash, b.stretch, b.doc[b.owner], buckets)
        return a.sent(table.column("block")[0].as_py())

    def send_thirds(key, table: pa.Table, told: pa.Table) -> pa.Table:
        b = Block(table)
        return _thirds(b, _anchor_codes(b, told, buckets), buckets)[0].sent(key[0].as_py())

    def send_windows(key, table: pa.Table, told: pa.Table) -> pa.Table:
        b = Block(table)
        return _windows(b, _anchor_codes(b, told, buckets), told, buckets)[0].sent(key[0].as_py())

    def remove(key, table: pa.Table, told: pa.Table) -> pa.Table:
        b = Block(table)
        a = Digits(b.hash, b.stretch, b.doc[b.owner], buckets)
        codes = a.heard(told, 1)
        gone = a.repeats(codes)
        change = np.zeros(int(b.at[-1]) + 1, np.int32)
        np.add.at(change, b.low[gone], 1)
        np.add.at(change, b.high[gone] + DEPTH, -1)
        w, windows = _windows(b, codes, told, buckets)
        windows = windows[w.repeats(w.heard(told, 3))]
        np.add.at(change, windows, 1)
        np.add.at(change, windows + DEPTH, -1)
        return _result(b, np.cumsum(change[:-1], dtype=np.int32) > 0, table.column("_row") if carry else None)

    def settled(sent: DataFrame, digit: int) -> DataFrame:
        met = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle_anchors if digit == 1 else settle_exact, _TOLD)
        return met.withColumn("digit", F.lit(digit))

    def settle_anchors(table: pa.Table) -> pa.Table:
        return _settle(table, True)

    def settle_exact(table: pa.Table) -> pa.Table:
        return _settle(table, False)

    # one plan, so that the texts are shuffled once and that exchange is used for every digit
    texts = placed.groupBy("block")
    told = settled(texts.applyInArrow(send_anchors, _SENT), 1)
    told = told.unionByName(settled(texts.cogroup(told.groupBy("block")).applyInArrow(send_thirds, _SENT), 2))
    told = told.unionByName(settled(texts.cogroup(told.groupBy("block")).applyInArrow(send_windows, _SENT), 3))
    schema = StructType([base.schema["_row"], base.schema["text"]]) if carry else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = texts.cogroup(told.groupBy("block")).applyInArrow(remove, schema)
    if carry:
        return done.unionByName(base.where("doc_id IS NULL").select("_row", "text"))
    size, zero = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    whole = base.where("doc_id IS NULL").select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return done.unionByName(whole)


def _short(x: np.ndarray) -> np.ndarray:
    """The low 48 bits, three numbers of 16 bits each."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view("<u2").reshape(-1, 4)[:, :3])


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view(np.uint64).reshape(-1)


class Digits:
    """Entries of one digit in a block: equal keys are one entry, which stands at its first place."""

    def __init__(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray, buckets: int):
        self.key, self.check, self.doc = key, check, doc
        self.first, self.of, self.mixed, self.two = _distinct(key, doc, check)
        self.bucket = (key[self.first] % np.uint64(buckets)).astype(np.int64)
        self.buckets = buckets

    def sent(self, block: int) -> pa.Table:
        out, key, check, doc = [], self.key[self.first], self.check[self.first], self.doc[self.first]
        key, check = _short(key >> np.uint64(16)), _short(check)
        for k, at in enumerate(_dealt(self.bucket, self.buckets)):
            if len(at):
                out.append((k, block, key[at].tobytes(), check[at].tobytes(), _squeeze(np.diff(doc[at], prepend=0)), _two_bits(self.mixed[at] | self.two[at] << 1)))
        return _rows(out, _SENT)

    def heard(self, told: pa.Table, digit: int) -> np.ndarray:
        """The code of each place, from the answers of the buckets to which the entries went."""
        codes = np.zeros(len(self.first), np.uint8)
        order = np.argsort(self.bucket, kind="stable")
        ordered = self.bucket[order]
        for d, k, raw in zip(told.column("digit").to_pylist(), told.column("bucket").to_pylist(), told.column("codes").to_pylist()):
            if d == digit:
                a, b = np.searchsorted(ordered, [k, k + 1])
                codes[order[a:b]] = _from_two_bits(raw, b - a)
        return codes[self.of]

    def repeats(self, codes: np.ndarray) -> np.ndarray:
        """Which places repeat an earlier document."""
        return (codes == LATER) | ((codes == FIRST) & (self.doc > self.doc[self.first][self.of]))


def _anchor_codes(b: Block, told: pa.Table, buckets: int) -> np.ndarray:
    return Digits(b.hash, b.stretch, b.doc[b.owner], buckets).heard(told, 1)


def _pair(b: Block, at: list[np.ndarray], salt: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the bytes that the k-mers at these places cover."""
    parts = [b.kmers(x) for x in at]
    extra = np.broadcast_to(np.asarray(salt, np.uint64), parts[0].shape)
    return _joined([*parts, extra], 5), _joined([extra, *parts], 7)


#: Bytes of the second digit, and how far it begins before the anchor for each third of the offsets.
MIDDLE, THIRDS = 40, (0, 8, 16)


def _third(offset: np.ndarray) -> np.ndarray:
    """Which third a window belongs to, by how far it begins before its anchor."""
    return np.minimum(offset // 8, 2)


def _thirds(b: Block, codes: np.ndarray, buckets: int) -> tuple[Digits, np.ndarray, np.ndarray]:
    """The second digits of anchors with mixed stretches: (entries, anchor, third). Windows that begin 0 to 7 bytes before
    their anchor hold the MIDDLE bytes from it on, those that begin 8 to 15 before it those from 8 before it, and so on."""
    at = np.flatnonzero(codes == MIXED)
    place = b.place[at]
    low, high = _third(place - b.high[at]), _third(place - b.low[at])
    anchor = np.concatenate([at[(low <= k) & (k <= high)] for k in range(len(THIRDS))])
    third = np.concatenate([np.full(int(((low <= k) & (k <= high)).sum()), k) for k in range(len(THIRDS))])
    order = np.lexsort((third, anchor))
    anchor, third = anchor[order], third[order]
    start = b.place[anchor] - np.array(THIRDS)[third]
    key, check = _pair(b, [start, start + MIDDLE - K], third)
    return Digits(key, check, b.doc[b.owner[anchor]], buckets), anchor, third


def _windows(b: Block, codes: np.ndarray, told: pa.Table, buckets: int) -> tuple[Digits, np.ndarray]:
    """The windows whose second digit is shared: (entries, where they begin)."""
    t, anchor, third = _thirds(b, codes, buckets)
    live = t.heard(told, 2) != ALONE
    anchor, third = anchor[live], third[live]
    place = b.place[anchor]
    widest = np.where(third == 2, DEPTH - K, 8 * third + 7)
    low = np.maximum(b.low[anchor], place - widest)
    high = np.minimum(b.high[anchor], place - 8 * third)
    count = high - low + 1
    start = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    key, check = _pair(b, [start, start + (DEPTH - K) // 2, start + DEPTH - K], 9)
    return Digits(key, check, b.doc[np.repeat(b.owner[anchor], count)], buckets), start


def _settle(table: pa.Table, stretches: bool) -> pa.Table:
    """The entries of all blocks in a bucket, sorted digit by digit. stretches: checks may differ within a key."""
    doc = [np.cumsum(_expand(x, np.int64)) for x in table.column("docs").to_pylist()]
    sizes = [len(d) for d in doc]
    flags = np.concatenate([_from_two_bits(x, n) for x, n in zip(table.column("flags").to_pylist(), sizes)])
    doc = np.concatenate(doc)
    key, check = (_long(b"".join(table.column(c).to_pylist())) for c in ("keys", "checks"))
    order = np.argsort(key, kind="stable") if stretches else np.lexsort((check, key))
    key, check, doc, flags = key[order], check[order], doc[order], flags[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    if not stretches:
        fresh[1:] |= check[1:] != check[:-1]
    begin, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    shared = (np.diff(np.append(begin, len(key)))[group] > 1) | (flags & 2 > 0)
    verdict = np.where(np.minimum.reduceat(doc, begin)[group] < doc, LATER, FIRST)
    if stretches:
        other = (check != check[begin][group]) | (flags & 1 > 0)
        verdict = np.where(np.logical_or.reduceat(other, begin)[group], MIXED, verdict)
    codes = np.empty(len(key), np.uint8)
    codes[order] = np.where(shared, verdict, ALONE)
    out = []  # to each block the codes of its entries, in the order in which it sent them; nothing where nothing is shared
    for block, bucket, part in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(codes, np.cumsum(sizes)[:-1])):
        if part.any():
            out.append((block, bucket, _two_bits(part)))
    return _rows(out, _TOLD)


def _result(b: Block, covered: np.ndarray, carried: pa.ChunkedArray | None) -> pa.Table:
    spans = covered.copy()
    spans[1:] &= ~covered[:-1]
    inner = b.at[:-1][b.at[:-1] < b.at[-1]]
    spans[inner] = covered[inner]
    full = np.flatnonzero(b.size)

    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b.size), np.int64)
        out[full] = np.add.reduceat(x, b.at[full], dtype=np.int64) if len(full) else 0
        return out

    removed = sums(covered)

    def stays(i: int) -> bytes:
        text = b.buf[b.at[i] : b.at[i + 1]]
        return (text[~covered[b.at[i] : b.at[i + 1]]] if removed[i] else text).tobytes()

    n = range(len(b.size))
    if carried is not None:
        return pa.table({"_row": carried.take(pa.array(b.order)), "text": pa.array([stays(i).decode("utf-8", "ignore") for i in n], pa.string())})
    kept = [hashlib.sha256(stays(i)).hexdigest() for i in n]
    return pa.table({"doc_id": pa.array(b.doc), "n_bytes": pa.array(b.size), "n_removed": pa.array(removed), "n_spans": pa.array(sums(spans)), "kept_sha256": pa.array(kept, pa.string())})


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what stays of each text, other columns as they were; documents with no text left, or none before, go.

    n_chars follows the text where docs has it. A code point that loses some of its bytes loses the rest. Rows that share
    a doc_id each keep what stays of their own text.
    """
    out = repeats_removed(docs, carry=True).where("text <> ''").select("_row.*", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(docs_table(spark, sf_dir))
