"""Token counts by rank-synchronous merging of ragged arrays: many pre-tokens at a time, all in step.

A batch of texts is cut into pre-tokens; equal ones are kept once. All symbols of all of them lie in one flat array, with
the merge rank of each pair of neighbours beside them. A round takes the lowest rank of every sequence (one segmented
minimum), merges all its occurrences there at once, and looks up the ranks around them anew. Sequences without a rank
left are taken out with the number of symbols that survive. Ids are never put together: only their number is asked for.

All occurrences of a pair may merge at once because what they make cannot merge with a rank below theirs; where a
vocabulary breaks that rule for a rank, only its leftmost occurrence is merged in a round. Of touching occurrences
(a a a) every second one is, from the left. Pre-tokens of more than LONG bytes take a heap: in step they would need as
many rounds over as many places.

Defined cases: null texts count as empty and have no bytes and no tokens; strings of added tokens inside a text are one
token each, as the tokenizers library does by default; rows that repeat are counted alike; a null doc_id is kept; an
empty table gives an empty result; texts of any length are counted whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe
from quillspark.llm.common import clean_docs, docs_table
from quillspark.llm.packing import _PLAIN

#: A text with more tokens than this is over the limit.
LIMIT = 2048
#: Bytes of the longest pre-token that merges in step.
LONG = 4096
NONE = bpe.NONE


class Counter:
    """A vocabulary of the tokenizers library with what rank-synchronous merging asks of it."""

    def __init__(self, path: str):
        if not path.endswith(".json"):
            raise ValueError(f"{path}: token counts are made for vocabularies of the tokenizers library (.json)")
        from tokenizers import Tokenizer

        self.v = v = bpe.load(path)
        self.library = Tokenizer.from_file(path)
        self.lower = self.library.normalizer is not None
        used = np.full(int(v.size), NONE, np.int64)  # the first rank that takes a token as a part
        rank = np.arange(len(v.key))
        np.minimum.at(used, v.key // v.size, rank)
        np.minimum.at(used, v.key % v.size, rank)
        #: Ranks whose product may merge on at once, before further occurrences of the rank.
        self.impatient = used[v.made] < rank
        self.letters = {ord(c): b for b, c in bpe.byte_letters().items()}

    def survivors(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """ids: the symbols of all sequences, one after the other; size: how many each has, none 0. The numbers that are left."""
        out, live = size.copy(), np.arange(len(size))
        start = np.cumsum(size) - size
        ranks = np.full(len(ids), NONE, np.int32)
        if len(ids) > 1:
            ranks[:-1] = self.v.rank(ids[:-1], ids[1:])
            ranks[start[1:] - 1] = NONE
        while len(live):
            low = np.minimum.reduceat(ranks, start)
            on = low != NONE
            if not on.all():
                out[live[~on]] = size[~on]
                stay = np.repeat(on, size)
                ids, ranks, live, size, low = ids[stay], ranks[stay], live[on], size[on], low[on]
                start = np.cumsum(size) - size
                if not len(live):
                    break
            hit = np.flatnonzero(ranks == np.repeat(low, size))
            number = np.arange(len(hit))
            fresh = np.append(True, np.diff(hit) != 1)
            hit = hit[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
            owner = np.searchsorted(start, hit, "right") - 1
            if (odd := self.impatient[low[owner]]).any():
                take = ~odd | np.append(True, owner[1:] != owner[:-1])
                hit, owner = hit[take], owner[take]
            ids[hit] = self.v.made[low[owner]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            at = (np.cumsum(stay) - 1)[hit]
            ids, ranks, size = ids[stay], ranks[stay], size - np.bincount(owner, minlength=len(size))
            start = np.cumsum(size) - size
            ends = at == (start + size - 1)[owner]
            ranks[at[ends]] = NONE
            right, left = at[~ends], at[at > start[owner]] - 1
            ranks[right] = self.v.rank(ids[right], ids[right + 1])
            ranks[left] = self.v.rank(ids[left], ids[left + 1])
        return out

    def _symbols(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = data[bpe.ragged(begin, size)]
        ids, last = self.v.inner[raw], np.cumsum(size) - 1
        ids[last] = self.v.last[raw[last]]
        return ids

    def _words(self, words: pa.Array) -> np.ndarray:
        """The number of tokens of each distinct pre-token; white space after it is no part of it where the vocabulary drops that."""
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
        begin, size = offsets[:-1], np.diff(offsets)
        out = np.zeros(len(words), np.int64)
        if not len(words) or offsets[0] == offsets[-1]:
            return out
        data = np.frombuffer(words.buffers()[2], np.uint8)
        if not self.v.spaced:
            start, _, kind = bpe.characters(data[offsets[0] : offsets[-1]])
            width = np.diff(np.append(start, offsets[-1] - offsets[0]))
            word = np.searchsorted(offsets - offsets[0], start, "right") - 1
            size = np.bincount(word, np.where(kind > bpe.WHITE, width, 0), len(words)).astype(np.int64)
        step = np.flatnonzero((size > 0) & (size <= LONG))
        if len(step):
            out[step] = self.survivors(self._symbols(data, begin[step], size[step]), size[step])
        for i in np.flatnonzero(size > LONG):
            out[i] = len(bpe.merge_long(self.v, self._symbols(data, begin[i : i + 1], size[i : i + 1]).tolist()))
        return out

    def _pieces(self, text: str) -> list:
        """The text between added tokens, in pieces of bounded size; the added tokens are None."""
        pieces: list = [text]
        for token in self.v.added:
            if token in text:
                pieces = [y for x in pieces for y in ([x] if x is None else _between(x.split(token)))]
        return [y for x in pieces for y in ([x] if x is None or len(x) <= bpe.SLICE or self._odd(x) else bpe._cut(x))]

    def _odd(self, text: str) -> bool:
        """Whether the library must normalise and cut the text: its characters may depend on each other."""
        return self.lower and not text.isascii() and bool(_PLAIN.search(text))

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        plain: list[bytes] = []
        apart: list[bytes] = []  # pre-tokens that the library cut out
        plain_of, apart_of, held = [], [], 0
        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                if piece is None:
                    total[i] += 1
                elif self._odd(piece):
                    cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
                    apart += [w.translate(self.letters).encode("latin-1") for w, _ in cut]
                    apart_of += [i] * len(cut)
                    held += len(piece)
                elif piece:
                    plain.append((piece.lower() if self.lower else piece).encode())
                    plain_of.append(i)
                    held += len(plain[-1])
                if held >= bpe.SLICE:
                    self._add(total, plain, plain_of, apart, apart_of)
                    plain, plain_of, apart, apart_of, held = [], [], [], [], 0
        self._add(total, plain, plain_of, apart, apart_of)
        return total

    def _add(self, total: np.ndarray, plain: list[bytes], plain_of: list[int], apart: list[bytes], apart_of: list[int]) -> None:
        if plain:
            blob = b"".join(plain)
            start, code, kind = bpe.characters(np.frombuffer(blob, np.uint8))
            bounds = np.cumsum([0, *map(len, plain)])
            first = np.searchsorted(start, bounds[:-1])
            at = start[bpe.word_starts(code, kind, first, self.v.spaced)]
            words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(blob)).astype(np.int32)), pa.py_buffer(blob)])
            self._sum(total, words, np.array(plain_of)[np.searchsorted(bounds, at, "right") - 1])
        if apart:
            self._sum(total, pa.array(apart, pa.binary()), np.array(apart_of))

    def _sum(self, total: np.ndarray, words: pa.Array, owner: np.ndarray) -> None:
        coded = words.dictionary_encode()
        each = self._words(coded.dictionary)[coded.indices.to_numpy()]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))  # owners come in order
        np.add.at(total, owner[first], np.add.reduceat(each, first))


def _between(pieces: list[str]) -> list:
    out: list = [pieces[0]]
    for p in pieces[1:]:
        out += [None, p]
    return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs; texts never leave the worker that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.cached(("counter", path), lambda: Counter(path))
        for b in batches:
            text = b.column("text")
            n = counter.counts(text.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return clean_docs(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(docs_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
