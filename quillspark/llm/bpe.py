"""BPE encoding and decoding by contiguous rank arrays, for a whole batch of short words at a time.

A batch of texts is cut into words by one pass over character classes; equal words are encoded once. All distinct words
of one length stand in a matrix, a row each: part ids, and the merge ranks of adjacent parts. Each round scans every row
for its least rank (the leftmost on ties), deletes that boundary, and looks up the two ranks beside it. A row without a
rank is done. Every live row loses one part a round, so the matrix stays dense. Words longer than LONG take a heap.

Defined cases: null texts count as empty and have no ids; strings of added tokens inside a text become those tokens, as
the tokenizers library does by default; rows that repeat are encoded alike; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import clean_docs, docs_table

#: Bytes of text that one round takes at a time; longer texts are cut where a word must begin.
SLICE = 4 << 20
#: Words of more bytes than this are merged one by one with a heap: no quadratic scans.
LONG = 48
NONE = np.int32(2**31 - 1)

_BLANK = re.compile("(?<=[!-~]) (?=[!-~])")

BLANK, WHITE, LETTER, NUMBER, OTHER = range(5)


def cached(key: tuple, make: Callable):
    """Kept for a Python worker's life, across tasks."""
    store = sys.modules.setdefault("_quill_cache", types.ModuleType("_quill_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def char_classes(top: int) -> np.ndarray:
    """The class of each code point below top."""
    out = np.full(top, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(top):
        kind = kinds.get(unicodedata.category(chr(c))[0])
        if kind:
            out[c] = kind
    white = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[[c for c in white if c < top]] = WHITE
    out[32] = BLANK
    return out


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, code point, class) of each character of a UTF-8 buffer."""
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[start]
    code = lead.astype(np.int32)
    padded = np.concatenate([buf, np.zeros(4, np.uint8)])
    for low, high, width, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        at = np.flatnonzero((lead >= low) & (lead < high))
        if len(at):
            value = (lead[at] & mask).astype(np.int32)
            for k in range(1, width):
                value = (value << 6) | (padded[start[at] + k] & 0x3F)
            code[at] = value
    top = 1 << 10 if not len(code) or code.max() < 1 << 10 else 0x110000
    return start, code, cached(("classes", top), lambda: char_classes(top))[code]


def _contractions(code: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes at ``at``: which begin 's 't 'm 'd 're 've 'll, and how many letters that takes. end: of their texts."""
    padded = np.concatenate([code, np.zeros(2, code.dtype)])
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"]) & (at + 1 < end)
    long = (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & (at + 2 < end)
    return short | long, np.where(short, 1, 2)


def word_starts(code: np.ndarray, kind: np.ndarray, first: np.ndarray, spaced: bool) -> np.ndarray:
    """Flags of the characters that begin a word. first: the first characters of texts (none empty), as places.

    spaced: a blank joins the word after it, digits run on, white space is kept (the pattern of byte-level vocabularies).
    Otherwise each number stands alone and white space, to be dropped, trails the word before it.
    """
    n = len(kind)
    begins = np.zeros(n + 3, bool)
    if not n:
        return begins[:0]
    fresh = np.zeros(n, bool)
    fresh[first] = True
    white = kind <= WHITE
    before = np.empty_like(kind)
    before[0], before[1:] = OTHER, kind[:-1]
    changed = kind != before
    if spaced:
        follows = np.zeros(n, bool)  # by a visible character of the same text
        follows[:-1] = ~white[1:] & ~fresh[1:]
        inside = np.where(white, (before > WHITE) | follows, np.where(before > WHITE, changed, before == WHITE))
    else:
        inside = ~white & (changed | (kind == NUMBER))
    begins[:n] = inside | fresh
    at = np.flatnonzero((code == ord("'")) & begins[:n])
    if len(at):
        end = np.append(first[1:], n)[np.searchsorted(first, at, "right") - 1]
        found, took = _contractions(code, at, end)
        at, took, end = at[found], took[found], end[found]
        begins[at + 1] = False
        after = at + 1 + took
        begins[after] |= (after < end) & (True if spaced else ~np.append(white, [True] * 3)[after])
    return begins[:n]


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(odd)) for b in range(256)}


class Vocabulary:
    """Tables of a byte-level BPE vocabulary in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.spaced = not suffix
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        size = max([*vocab.values(), *self.added.values()]) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = np.int64(size)
        self.key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = {int(k): r for r, k in reversed(list(enumerate(self.key)))}
        self.order = np.argsort(self.key, kind="stable")
        self.sorted = self.key[self.order]
        self.slot = np.full(1 << 19, -1, np.int32)
        hashed = self._hash(self.key)
        self.slot[hashed[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        self.crowded = np.zeros(1 << 19, bool)
        self.crowded[hashed[self.slot[hashed] != np.arange(len(pairs))]] = True
        back = {c: b for b, c in letters.items()}
        parts = [b""] * size
        for token, i in vocab.items():
            parts[i] = bytes(back[c] for c in (token.removesuffix(suffix) if suffix else token))
        for token, i in self.added.items():
            parts[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.byte_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs, NONE where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = self._hash(key)
        found = self.slot[at]
        out = np.where((found >= 0) & (self.key[found] == key), found, NONE).astype(np.int32)
        odd = np.nonzero(self.crowded[at] & (out == NONE))
        if len(odd[0]):
            want = key[odd]
            place = np.minimum(np.searchsorted(self.sorted, want), len(self.sorted) - 1)
            out[odd] = np.where(self.sorted[place] == want, self.order[place], NONE)
        return out


def merge_rows(v: Vocabulary, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """parts: a word a row, all of one length. Yields (rows, their final ids)."""
    rows, ranks = np.arange(len(parts)), v.rank(parts[:, :-1], parts[:, 1:])
    while len(rows):
        if parts.shape[1] == 1:
            yield rows, parts
            return
        at = ranks.argmin(1)
        best = ranks[np.arange(len(rows)), at]
        live = best != NONE
        if not live.all():
            yield rows[~live], parts[~live]
            rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
            if not len(rows):
                return
        width = parts.shape[1]
        column, each = np.arange(width - 1), np.arange(len(rows))
        parts = np.where(column <= at[:, None], parts[:, :-1], parts[:, 1:])
        parts[each, at] = v.made[best]
        if width > 2:
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = v.rank(parts[left, at[left] - 1], parts[left, at[left]])
            ranks[right, at[right]] = v.rank(parts[right, at[right]], parts[right, at[right] + 1])


def merge_long(v: Vocabulary, parts: list[int]) -> np.ndarray:
    """One long word: a heap of (rank, place) over a linked list."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size, ranks = int(v.size), v.ranks
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(parts[i] * size + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= n or ranks.get(parts[i] * size + parts[j]) != r:
            continue
        parts[i], parts[j] = int(v.made[r]), -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := ranks.get(parts[i] * size + parts[k])) is not None:
                heapq.heappush(heap, (q, i))
        if (h := before[i]) >= 0 and (q := ranks.get(parts[h] * size + parts[i])) is not None:
            heapq.heappush(heap, (q, h))
    return np.array([p for p in parts if p >= 0], np.int32)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start[0], start[0] + 1, ... of each run, one run after the other."""
    total = int(count.sum())
    at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else start, count)
    return at + np.arange(total)


def encode_words(v: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words: distinct byte strings. (ids, start, count): the ids of word i are ids[start[i] : start[i] + count[i]]."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
    begin, size = offsets[:-1], np.diff(offsets)
    if not v.spaced and len(words):  # white space trails words, or is all there is
        start, _, kind = characters(data[offsets[0] : offsets[-1]])
        solid = kind > WHITE
        width = np.diff(np.append(start, offsets[-1] - offsets[0]))
        word = np.searchsorted(offsets - offsets[0], start, "right") - 1
        size = np.bincount(word, np.where(solid, width, 0), len(words)).astype(np.int64)
    count, done = np.zeros(len(words), np.int64), []
    by_size = np.argsort(size, kind="stable")
    edges = np.searchsorted(size[by_size], np.arange(1, LONG + 2))
    for length in range(1, LONG + 1):
        group = by_size[edges[length - 1] : edges[length]]
        if len(group):
            grid = data[begin[group][:, None] + np.arange(length)]
            parts = v.inner[grid]
            parts[:, -1] = v.last[grid[:, -1]]
            for rows, ids in merge_rows(v, parts):
                done.append((group[rows], ids))
    for i in by_size[edges[LONG] :]:
        raw = data[begin[i] : begin[i] + size[i]]
        done.append((np.array([i]), merge_long(v, [*v.inner[raw[:-1]].tolist(), int(v.last[raw[-1]])])[None]))
    for rows, ids in done:
        count[rows] = ids.shape[1]
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for rows, ids in done:
        out[start[rows][:, None] + np.arange(ids.shape[1])] = ids
    return out, start, count


def encode_texts(v: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids begin, with the end last). No text holds an added token's string."""
    size = np.array([len(t) for t in texts], np.int64)
    blob = b"".join(texts)
    buf = np.frombuffer(blob, np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    start, code, kind = characters(buf)
    first = np.unique(np.searchsorted(start, bounds[:-1][size > 0]))
    at = start[word_starts(code, kind, first, v.spaced)]
    offsets = np.append(at, len(buf)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(blob)])
    coded = words.dictionary_encode()
    ids, begin, count = encode_words(v, coded.dictionary)
    index = coded.indices.to_numpy()
    per_word = count[index]
    out = ids[ragged(begin[index], per_word)]
    ends = np.concatenate([[0], np.cumsum(per_word)])
    return out, ends[np.searchsorted(at, bounds)]


def encode_batch(v: Vocabulary, texts: list[str], prepare: Callable[[str], str] = str) -> Iterator[np.ndarray]:
    """The ids of each text, in order. Added tokens' strings are cut out first; prepare is what then befalls the rest."""
    queue: list[bytes] = []
    plan: list[list[int | None]] = []  # per text: an added token's id, or None for the next of the queue
    held = 0

    def flush() -> Iterator[np.ndarray]:
        k = 0
        ids, at = encode_texts(v, queue) if held < 2 * SLICE else (None, None)
        for pieces in plan:
            got = []
            for p in pieces:
                if p is not None:
                    got.append(np.array([p], np.int32))
                    continue
                # a long text's pieces are encoded one at a time
                got.append(ids[at[k] : at[k + 1]] if ids is not None else encode_texts(v, [queue[k]])[0])
                k += 1
            yield got[0] if len(got) == 1 else np.concatenate(got)

    for text in texts:
        pieces: list = [text]
        for token, i in v.added.items():
            if token in text:
                pieces = [y for x in pieces for y in ([x] if isinstance(x, int) else _between(x.split(token), i))]
        if len(text) > SLICE:
            pieces = [y for x in pieces for y in ([x] if isinstance(x, int) else _cut(x))]
        plan.append([x if isinstance(x, int) else None for x in pieces])
        for x in pieces:
            if not isinstance(x, int):
                queue.append(prepare(x).encode())
                held += len(queue[-1])
        if held >= SLICE:
            yield from flush()
            queue, plan, held = [], [], 0
    if plan:
        yield from flush()


def _cut(text: str) -> list[str]:
    """text in pieces of about SLICE characters; a blank between two visible ASCII characters begins a word whatever is around."""
    cuts = [0]
    while len(text) - cuts[-1] > SLICE and (m := _BLANK.search(text, cuts[-1] + SLICE)):
        cuts.append(m.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _between(pieces: list[str], i: int) -> list:
    out: list = [pieces[0]]
    for p in pieces[1:]:
        out += [i, p]
    return out


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids: their bytes in a row; bytes that are no UTF-8 become U+FFFD."""
    return v.bytes[ragged(v.byte_at[ids], v.byte_at[ids + 1] - v.byte_at[ids])].tobytes().decode("utf-8", "replace")


def load(path: str) -> Vocabulary:
    return cached(("vocabulary", path), lambda: Vocabulary(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for b in batches:
            ids = pa.array(list(encode_batch(v, b.column("text").to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return clean_docs(docs).mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them; ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for b in batches:
            n, coded, plain = [], [], []
            for ids in encode_batch(v, b.column("text").to_pylist()):
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                plain.append(hashlib.sha256(decode(v, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return clean_docs(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(docs_table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
