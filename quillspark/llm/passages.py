"""Substring dedup with compact windows: near-duplicate passages of MIN_WORDS words and more.

Tokens are shingles of five words. For each of HASHES hash functions, a Cartesian tree over a text's hash values names, for
each token that is the least of some stretch of MIN_TOKENS, the compact window (low, at, high): every stretch that holds
``at`` and stays within [low, high] has that token as its min-hash. An interval join meets the windows of two functions at
a time: its runs of starts share both min-hashes, and the two together are a signature. At a similarity of 0.8 two equal
stretches share one of the four signatures with a chance of 0.98, while texts that only quote the same line seldom do.

First every document asks the owner of each of its signatures, the smallest doc_id that has it, and passages whose token
sets reach SIMILARITY are links; a group of copies costs one link a member, never its pairs. Where three documents or more
share a signature, their runs meet once more, all with all, whether the owner was near or not. Runs go to the task of
their signature's owner, a document's runs of one owner as one row with the tokens they cover, so that the signatures that
two documents share are looked at together; the documents of an owner that many have in common are dealt into chunks, and
each two chunks are a cell of their own. Left out are pairs of copies only: of texts that are equal as a whole the smallest
doc_id stands for all (the others link to it), and passages that are equal to the same owner's link to that owner, but for
texts that are edited copies of the owner's as a whole.
Links join documents to classes.

All links of a family of edited copies are the square of the family. passage_classes gives the classes alone, one row per
document, and compares no two texts that are in one class already: the owners' links are joined first, then the runs of
different classes meet, in cells that grow with the texts and at last in all cells that two classes are left in.

Documents lie in blocks by a hash of doc_id; a block sends each signature once, asks each document once, and gets its text
back, so hot signatures and hot owners cost one row a block.

Defined cases: null texts count as empty; texts shorter than MIN_WORDS link to nothing; case differences of ASCII letters
and white space do not count; rows that share a doc_id are one document and never link to each other; rows with a null
doc_id take no part; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import block_count, clean_docs, docs_table, partitions, written
from quillspark.llm.simhash import components, xxh64
from quillspark.llm.suffix_dedup import _dealt, _distinct, _expand, _from_two_bits, _joined, _long, _mixed, _short, _squeeze, _two_bits

SHINGLE = 5
MIN_WORDS = 50
MIN_TOKENS = MIN_WORDS - SHINGLE + 1
SIMILARITY = 0.8
HASHES = 8
#: Tokens of a stretch that may lie outside a passage that is equal to an owner's, and what is near is still that passage.
EDGE = int((1 - SIMILARITY) / (1 + SIMILARITY) * MIN_TOKENS + 1e-9) + 4
#: Documents of one owner that are compared with as many others in one cell.
MEMBERS = 256
#: Pairs of passages that are compared before it is looked at what they join.
FIRST = 1 << 12
#: Rows of cells that a task takes at once.
CELL_ROWS = 1 << 11
#: Runs of a signature up to which all pairs are listed before they are looked at.
FEW = 24
BLOCK_BYTES = 2 << 20
CHUNK = 1 << 19
_PLACE = np.uint64((1 << 32) - 1)
#: Tokens are mixed already; an odd factor orders them anew for each function.
_FACTORS = _mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts in a row, tokens of each text)."""
    hashes, counts, row = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    while row < len(texts):
        held, total, end = [], 0, row
        while end < len(texts) and (not held or total < CHUNK):
            held.append(b" ".join(texts[end].lower().split()))
            total += len(held[-1])
            end += 1
        buf = b" ".join(held)
        size = np.array([len(x) for x in held], np.int64)
        base = np.cumsum(size + 1) - size - 1
        gap = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
        begin, stop = np.concatenate([[0], gap + 1]), np.append(gap, len(buf))
        word = xxh64(buf, begin, stop - begin)
        first = np.searchsorted(begin, base)
        n_words = np.where(size > 0, np.diff(np.append(first, len(begin))), 0)
        n = np.maximum(n_words - SHINGLE + 1, 0)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hashes.append(_joined([word[at + k] for k in range(SHINGLE)], 3))
        counts[row:end] = n
        row = end
    return np.concatenate(hashes), counts


def least_before(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each element the nearest earlier one of its text that is smaller, or -1: the left edges of the Cartesian tree."""
    at = np.arange(len(value)) - 1
    at[np.append(True, doc[1:] != doc[:-1])] = -1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[value[at[todo]] > value[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def compact_windows(tokens: np.ndarray, counts: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """(row, low, at, high, signature) of the compact windows of MIN_TOKENS and more, low..high as places among all tokens."""
    start = np.cumsum(counts) - counts
    long = np.flatnonzero(counts >= MIN_TOKENS)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none, none.astype(np.uint64)
    h = tokens * _FACTORS[salt]
    value = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    least, width = value, 1
    while width < MIN_TOKENS:
        step = min(width, MIN_TOKENS - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    n = counts[long] - MIN_TOKENS + 1
    starts = np.repeat(start[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    at = (least[starts] & _PLACE).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])]
    row = np.searchsorted(start, at, "right") - 1
    row = np.maximum(row, 0)
    v = value[at]
    left = least_before(v, row)
    right = len(at) - 1 - least_before(v[::-1], row[::-1])[::-1]
    low = np.where(left >= 0, at[left] + 1, start[row])
    high = np.where(right < len(at), at[np.minimum(right, len(at) - 1)] - 1, start[row] + counts[row] - 1)
    return row, low, at, high, h[at] ^ np.uint64(salt)


def starts_of(low: np.ndarray, at: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last start of the stretches of MIN_TOKENS that a window holds."""
    return np.maximum(low, at - MIN_TOKENS + 1), np.minimum(at, high - MIN_TOKENS + 1)


def joint_windows(one: tuple, two: tuple, salt: int) -> tuple[np.ndarray, ...]:
    """one, two: compact_windows of two functions. Their interval join: (row, first start, last start, signature).

    Both cut the same starts into runs, in order.
    """
    (first_one, last_one), (first_two, last_two) = starts_of(*one[1:4]), starts_of(*two[1:4])
    first = np.sort(np.concatenate([first_one, first_two]), kind="stable")  # two ascending runs are merged
    first = first[np.append(True, first[1:] != first[:-1])[: len(first)]]
    a, b = np.searchsorted(first_one, first, "right") - 1, np.searchsorted(first_two, first, "right") - 1
    last = np.minimum(last_one[a], last_two[b])
    return one[0][a], first, last, _joined([one[4][a], two[4][b]], salt)


class Block:
    """The documents of a block, in order of doc_id, and their signatures with the runs of starts that have them."""

    def __init__(self, doc: np.ndarray, texts: list[str]):
        order = np.argsort(doc, kind="stable")
        self.doc = doc[order]
        self.tokens, self.counts = tokens_of([(texts[i] or "").encode() for i in order])
        self.start = np.cumsum(self.counts) - self.counts
        place = (np.arange(len(self.tokens)) - np.repeat(self.start, self.counts)).astype(np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(_joined([self.tokens, place], 11), dtype=np.uint64))
        #: Equal for texts that are equal but for case and white space.
        self.digest = (sums[self.start + self.counts] - sums[self.start]).view(np.int64)

    def windows(self) -> None:
        got, row = [], 0
        while row < len(self.counts):
            end = max(int(np.searchsorted(self.start, self.start[row] + CHUNK, "right")) - 1, row + 1)
            base, stop = self.start[row], self.start[end - 1] + self.counts[end - 1]
            for salt in range(0, HASHES, 2):
                sides = [compact_windows(self.tokens[base:stop], self.counts[row:end], salt + k) for k in (0, 1)]
                r, first, last, key = joint_windows(*sides, salt)
                got.append((r + row, first + base, last + base, key))
            row = end
        none = np.zeros(0, np.int64)
        parts = [np.concatenate(x) for x in zip(*got)] if got else [none] * 3 + [none.astype(np.uint64)]
        order = np.argsort(parts[0], kind="stable")
        self.row, self.first, self.last, self.key = (p[order] for p in parts)

    def passages(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """owner: of each run's signature, or -1. (row, first token, last token, owner) to be verified: the runs that a
        document shares with one owner, those together whose stretches meet."""
        return merged(*(x[(owner >= 0) & (owner < self.doc[self.row])] for x in (self.row, self.first, self.last, owner)))

    def open_runs(self, shared: np.ndarray, owner: np.ndarray, exact: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        """shared: runs; owner: of each; exact: (first token, last token, owner) of passages that are equal to an owner's.
        (run, its owner, first start, last start, class) of what the other runs of the signature are to be compared with.

        Starts whose stretch lies within one equal passage are left out, as whatever is near them is near the owner's.
        The class of a run names the owner whose passage some of its stretches lie in but for EDGE tokens: two runs of a
        class are copies there. What such a run has beside is a run of its own, without a class.
        """
        n = len(self.tokens)
        full, near = np.zeros(n + 1, bool), np.full(n + 1, -1, np.int64)
        row_of = np.searchsorted(self.start + self.counts, [a for a, _, _ in exact], "right")
        for (a, z, d), r in sorted(zip(exact, row_of.tolist()), key=lambda x: -x[0][2]):  # the smallest owner comes last
            full[a : z - MIN_TOKENS + 2] = True
            near[max(a - EDGE, int(self.start[r])) : min(z - MIN_TOKENS + 2 + EDGE, int(self.start[r] + self.counts[r]))] = d
        first, last = _hull(self.first[shared], self.last[shared], ~full)
        shared, owner, first, last = (x[first <= last] for x in (shared, owner, first, last))
        held = np.concatenate([[0], np.cumsum(near >= 0)])
        mixed = held[last + 1] > held[first]
        kind = np.full(len(shared), -1, np.int64)
        kind[mixed] = [int(x[x >= 0].min()) for x in (near[a : z + 1] for a, z in zip(first[mixed].tolist(), last[mixed].tolist()))]
        a, z = _hull(first[mixed], last[mixed], near < 0)
        own = np.flatnonzero(mixed)[a <= z]
        more = (shared[own], owner[own], a[a <= z], z[a <= z], np.full(len(own), -1, np.int64))
        run, owner, first, last, kind = (np.concatenate(x) for x in zip((shared, owner, first, last, kind), more))
        # a line that repeats has a run at each place; those whose starts go on from one another are one
        order = np.lexsort((first, kind, self.key[run], self.row[run]))
        run, owner, first, last, kind = (x[order] for x in (run, owner, first, last, kind))
        same = (self.row[run][1:] == self.row[run][:-1]) & (self.key[run][1:] == self.key[run][:-1]) & (kind[1:] == kind[:-1])
        begin = np.flatnonzero(np.append(True, ~same | (first[1:] > last[:-1] + 1))[: len(run)])
        return run[begin], owner[begin], first[begin], np.maximum.reduceat(last, begin) if len(begin) else last, kind[begin]

    def mostly(self, r: int, parts: list[tuple[int, int]]) -> bool:
        """Whether the parts (first token, end) hold SIMILARITY of a text's distinct tokens."""
        mine = self.tokens[self.start[r] : self.start[r] + self.counts[r]]
        return len(np.unique(np.concatenate([mine[a:z] for a, z in parts]))) >= SIMILARITY * len(np.unique(mine))

    def sent_runs(self, run: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray, kind: np.ndarray) -> Iterator[tuple]:
        """Rows of _OPEN: the runs of a text that have one owner, and the tokens they cover, each once."""
        if not len(run):
            return
        order = np.lexsort((first, owner, self.row[run]))
        run, owner, first, last, kind = (x[order] for x in (run, owner, first, last, kind))
        row = self.row[run]
        fresh = np.append(True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]))
        group = np.cumsum(fresh)
        span = np.int64(len(self.tokens) + 1)
        reach = np.maximum.accumulate(last + MIN_TOKENS + group * span) - group * span
        since = np.where(fresh, first, np.append(0, reach[:-1]))  # from where on a run brings new tokens
        since = np.maximum(since, first)
        count = np.maximum(last + MIN_TOKENS - since, 0)
        before = np.cumsum(count) - count
        place = np.repeat(since - before, count) + np.arange(int(count.sum()))
        token = (self.tokens[place] >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(run))
        piece = np.flatnonzero(fresh | (since == first))  # a gap, or the first of a text
        lead = piece[np.cumsum(fresh | (since == first)) - 1]
        at = before[lead] + first - first[lead] - before[begin][group - 1]
        rel = self.start[row]
        runs = np.stack([first - rel, last - rel, at], axis=1).astype(np.int32)
        key, tail = self.key[run], np.append(before[begin[1:]], len(token))
        for a, z, low, high in zip(begin.tolist(), end.tolist(), before[begin].tolist(), tail.tolist()):
            r = int(row[a])
            yield int(self.doc[r]), int(owner[a]), int(self.digest[r]), key[a:z].tobytes(), runs[a:z].tobytes(), kind[a:z].tobytes(), token[low:high].tobytes()


def _hull(first: np.ndarray, last: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range the first and last place that is wanted; first > last where none is."""
    place = np.arange(len(wanted))
    ahead = np.minimum.accumulate(np.where(wanted, place, len(wanted))[::-1])[::-1]
    back = np.maximum.accumulate(np.where(wanted, place, -1))
    return np.maximum(ahead[first], first), np.minimum(back[last], last)


def merged(row: np.ndarray, first: np.ndarray, last: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts as passages (row, first token, last token, other): runs of one row and other whose stretches meet are one."""
    if not len(row):
        return row, first, last, other
    order = np.lexsort((first, other, row))
    row, other, first, last = row[order], other[order], first[order], last[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (other[1:] != other[:-1]))
    group = np.cumsum(fresh)
    span = np.int64(last.max() + 1)
    reach = np.maximum.accumulate(last + group * span) - group * span
    fresh[1:] |= first[1:] > reach[:-1] + MIN_TOKENS
    begin = np.flatnonzero(fresh)
    return row[begin], first[begin], reach[np.append(begin[1:], len(row)) - 1] + MIN_TOKENS - 1, other[begin]


def _bucketed(b: Block, buckets: int):
    """The distinct signatures of a block: (first run of each, the number of each run's signature, documents differ?, bucket)."""
    first, of, _, two = _distinct(b.key, b.doc[b.row])
    return first, of, two, (b.key[first] % np.uint64(buckets)).astype(np.int64)


def _owners(told: pa.Table, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each distinct signature of a block, or -1, and whether three documents or more may share it."""
    out, more = np.full(len(bucket), -1, np.int64), np.zeros(len(bucket), bool)
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    for k, raw, bits in zip(*(told.column(c).to_pylist() for c in ("bucket", "owners", "more"))):
        a, z = np.searchsorted(ordered, [k, k + 1])
        out[order[a:z]] = _expand(raw, np.int64)
        more[order[a:z]] = _from_two_bits(bits, z - a) > 0
    return out, more


def _counter(tokens: np.ndarray, n: int):
    """A function that tells for each stretch of n tokens how many distinct ones it has among those that a mask names."""
    order = np.argsort(tokens, kind="stable")
    before = np.full(len(tokens), -1, np.int64)  # where the same token stood last
    same = tokens[order][1:] == tokens[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    place, size = np.arange(len(tokens)), len(tokens) + 1
    first = np.maximum(np.maximum(before, place - n) + 1, 0)  # of the stretches in which this is the first of its kind
    return lambda mask: np.cumsum(np.bincount(first[mask], minlength=size) - np.bincount(place[mask] + 1, minlength=size))[: len(tokens) - n + 1]


def _among(tokens: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the tokens stand in ``ordered``."""
    return ordered[np.minimum(np.searchsorted(ordered, tokens), len(ordered) - 1)] == tokens


def _overlaps(passage: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens in both, distinct tokens in either) for each stretch of ``other`` that is as long as the passage."""
    wanted = np.unique(passage)
    count = _counter(other, min(len(passage), len(other)))
    both = count(_among(other, wanted))
    return both, len(wanted) + count(slice(None)) - both


def _around(passage: np.ndarray, other: np.ndarray) -> tuple[int, np.ndarray]:
    """The part of ``other`` that its stretches with tokens of the passage lie in, and where it begins."""
    met = np.flatnonzero(_among(other, np.unique(passage)))
    if not len(met):
        return 0, other[: len(passage)]
    a = max(int(met[0]) - len(passage), 0)
    return a, other[a : int(met[-1]) + len(passage) + 1]


def best_match(passage: np.ndarray, other: np.ndarray) -> tuple[float, int, int]:
    """(similarity, first token, last token) of the stretch of ``other``, as long as the passage, that is most similar."""
    n = min(len(passage), len(other))
    if not n:
        return 0.0, 0, 0
    at, near = _around(passage, other)
    both, either = _overlaps(passage, near)
    a = int(np.argmax(both / either))
    return float(both[a] / either[a]), at + a, at + a + n - 1


def aligned(passage: np.ndarray, other: np.ndarray) -> list[tuple[float, int, int, int, int]]:
    """As matches, from the stretches of MIN_TOKENS, each made as long as it stays similar.

    From a stretch to the next the tokens in both grow by one at most and those in either fall by one at most, so the
    starts that are passed over cannot reach SIMILARITY.
    """
    out, i = [], 0
    at, other = _around(passage, other)
    while i + MIN_TOKENS <= len(passage) and MIN_TOKENS <= len(other):
        both, either = _overlaps(passage[i : i + MIN_TOKENS], other)
        missing = float((SIMILARITY * either - both).min())
        if missing > 1e-9:
            i += max(1, int(np.ceil(missing / (1 + SIMILARITY) - 1e-9)))
            continue
        end, step = i + MIN_TOKENS, MIN_TOKENS
        while step:
            if end + step <= len(passage) and best_match(passage[i : end + step], other)[0] >= SIMILARITY:
                end += step
            else:
                step //= 2
        score, x, y = best_match(passage[i:end], other)
        out.append((score, i, end - 1, at + x, at + y))
        i = end
    return out


def equal_parts(passage: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the parts of MIN_TOKENS and more of the passage that stand in ``other`` token for token, as far as
    the first places of its tokens there tell."""
    order = np.argsort(other, kind="stable")
    at = np.minimum(np.searchsorted(other[order], passage), len(other) - 1)
    shift = np.where(other[order[at]] == passage, order[at] - np.arange(len(passage)), len(other))
    begin = np.flatnonzero(np.append(True, shift[1:] != shift[:-1]))
    end = np.append(begin[1:], len(passage)) - 1
    long = (end - begin + 1 >= MIN_TOKENS) & (shift[begin] < len(other))
    if long.any() or (np.diff(other[order]) != 0).all():
        return list(zip(begin[long].tolist(), end[long].tolist()))
    out = []  # tokens that stand in several places break the parts
    for d in np.unique(shift[shift < len(other)]).tolist():
        a, z = max(0, -d), min(len(passage), len(other) - d)
        same = np.concatenate([[False], passage[a:z] == other[a + d : z + d], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        out += [(a + u, a + v - 1) for u, v in edges.tolist() if v - u >= MIN_TOKENS]
    return out


#: Shares of a stretch's distinct tokens that must stand in the other text, as a passage that falls short is cut finer;
#: the last cuts out what is repeated exactly.
SHARES = (0.0, 0.95, 1.0)


class Other:
    """A text's tokens, the same in order, and the fewest distinct tokens that any of its stretches of MIN_TOKENS has."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.ordered = tokens, np.sort(tokens)
        repeats = len(tokens) > 1 and bool((self.ordered[1:] == self.ordered[:-1]).any())
        self.fewest = int(_counter(tokens, MIN_TOKENS)(slice(None)).min()) if repeats and len(tokens) >= MIN_TOKENS else MIN_TOKENS


def _exact(passage: np.ndarray, other: np.ndarray) -> int:
    """Where the other text holds the passage token for token, as far as a few looks tell; else -1."""
    n, reach = len(passage), len(other) - len(passage) + 1
    if reach > 0:
        at = np.flatnonzero((other[:reach] == passage[0]) & (other[n - 1 :] == passage[-1]))
        for a in at[:8].tolist():  # the general way finds what is missed here
            if np.array_equal(other[a : a + n], passage):
                return a
    return -1


def matches(passage: np.ndarray, other: Other, shares: tuple = SHARES) -> list[tuple[float, int, int, int, int]]:
    """(similarity, first and last token of the passage, of the other) where they reach SIMILARITY.

    Stretches of MIN_TOKENS that could reach it, by their tokens in the other text, are joined to parts; each part is
    matched by itself, and one that falls short is cut finer. What finds nothing in that way is aligned stretch by stretch.
    """
    if min(len(passage), len(other.tokens)) < MIN_TOKENS:
        return []
    if (a := _exact(passage, other.tokens)) >= 0:
        return [(1.0, 0, len(passage) - 1, a, a + len(passage) - 1)]
    count = _counter(passage, MIN_TOKENS)
    held, distinct = count(_among(passage, other.ordered)), count(slice(None))
    bound = SIMILARITY * np.maximum(distinct, other.fewest + distinct - held) - 1e-9  # no union is smaller than that
    good = np.flatnonzero((held >= bound) & (held >= shares[0] * distinct))
    out = []
    for part in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else ():
        a, z = int(part[0]), int(part[-1]) + MIN_TOKENS
        score, x, y = best_match(passage[a:z], other.tokens)
        if score >= SIMILARITY:
            found = [(score, 0, z - a - 1, x, y)]
        else:
            found = matches(passage[a:z], other, shares[1:]) if len(shares) > 1 else []
            if not found and shares is SHARES:
                found = aligned(passage[a:z], other.tokens)
        out += [(score, a + i, a + j, x, y) for score, i, j, x, y in found]
    return out


_LINK = "doc_id long, other_id long, first_word long, last_word long, other_first_word long, other_last_word long, similarity double"
_JOIN = f"{_LINK}, label long, other_label long"
#: A text's runs of one owner. runs: of each its first and last start and where its tokens begin, as 32-bit numbers.
_OPEN = "doc_id long, owner long, text long, keys binary, runs binary, kinds binary, tokens binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _slices(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of a list whose sizes add up to about ``most``."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        z = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")), a + 1)
        z = min(z, a + (1 << 14))
        yield slice(a, z)
        a = z


def similar(tokens: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens in both, distinct tokens in either) of the stretches of m tokens from a on and n from b on."""
    both, either = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for at in _slices(m + n, 1 << 20):
        k = np.arange(len(a[at]), dtype=np.uint64) << np.uint64(33)
        sides = [np.repeat(k, size) | (tokens[_ranges(begin, size)].astype(np.uint64) << np.uint64(1)) | np.uint64(side) for side, begin, size in ((0, a[at], m[at]), (1, b[at], n[at]))]
        key = np.sort(np.concatenate(sides))
        key = key[np.append(True, key[1:] != key[:-1])] >> np.uint64(1)
        same = key[1:][key[1:] == key[:-1]]
        both[at] = np.bincount((same >> np.uint64(32)).astype(np.int64), minlength=len(k))
        either[at] = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(k)) - both[at]
    return both, either


#: Starts of a passage that are looked at together.
STARTS = 256
#: Tokens that two stretches of MIN_TOKENS, none twice, must have in common to reach SIMILARITY.
COMMON = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * MIN_TOKENS - 1e-9))


def near_starts(tokens: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches of MIN_TOKENS that reach SIMILARITY, of pairs of passages in which no token is twice: (pair, start in
    the first, the start in the second that is most similar, tokens in both).

    A common token at p and q lies in the stretches from i and from i + e on where p - MIN_TOKENS < i <= p and the same holds
    for q and i + e. So each adds one to a range of starts for each e; beyond the least and the largest q - p no e is better,
    but where the second passage ends before.
    """
    none = np.zeros(0, np.int64)
    out = [(none, none, none, none)]
    for at in _slices(m + n, 1 << 18):
        k = np.arange(len(a[at]), dtype=np.int64)
        pair = np.concatenate([np.repeat(k, m[at]), np.repeat(k, n[at])])
        place = np.concatenate([_ranges(np.zeros(len(k), np.int64), m[at]), _ranges(np.zeros(len(k), np.int64), n[at])])
        key = (pair << 32) | tokens[np.concatenate([_ranges(a[at], m[at]), _ranges(b[at], n[at])])].astype(np.int64)
        order = np.argsort(key, kind="stable")  # of two equal ones the first passage's comes first
        one = np.flatnonzero(key[order][1:] == key[order][:-1])
        pair, p, q = pair[order[one]], place[order[one]], place[order[one + 1]]
        order = np.argsort(pair, kind="stable")
        pair, p, d = pair[order], p[order], (q - p)[order]
        begin = np.searchsorted(pair, k)
        held = np.flatnonzero(np.diff(np.append(begin, len(pair))) >= COMMON)
        if not len(held):
            continue
        low, high = np.zeros(len(k), np.int64), np.full(len(k), -1, np.int64)
        kept = np.isin(pair, held)
        pair, p, d = pair[kept], p[kept], d[kept]
        edges = np.searchsorted(pair, held)
        low[held], high[held] = np.minimum.reduceat(d, edges), np.maximum.reduceat(d, edges)
        high += np.clip(-high, 0, MIN_TOKENS - COMMON) * (high >= low)  # where the second passage begins or ends too late
        low -= np.clip(low - (n[at] - m[at]), 0, MIN_TOKENS - COMMON) * (high >= low)
        starts, width = m[at] - MIN_TOKENS + 1, high - low + 1
        for some in _slices((starts * width)[held], 1 << 21):
            h = held[some]
            x, z = np.searchsorted(pair, [h[0], h[-1] + 1])
            size = starts[h] * width[h]
            base = np.zeros(len(k), np.int64)
            base[h] = np.cumsum(size + width[h]) - size - width[h]  # one place more a row, where ranges end
            cells = int((size + width[h]).sum()) + 1
            r, pp, dd = pair[x:z], p[x:z], d[x:z]
            line = starts[r] + 1
            token = np.repeat(np.arange(len(r)), width[r])
            e = low[r][token] + _ranges(np.zeros(len(r), np.int64), width[r])
            shift = e - dd[token]
            begin_at = np.maximum(pp[token] - MIN_TOKENS + 1 + np.maximum(-shift, 0), 0)
            end_at = np.minimum(pp[token] - np.maximum(shift, 0), starts[r][token] - 1) + 1
            fits = begin_at < end_at
            where = base[r][token] + (e - low[r][token]) * line[token]
            ends = [np.bincount(x[fits], minlength=cells).astype(np.int32) for x in (where + begin_at, where + end_at)]
            count = np.cumsum(ends[0] - ends[1])
            good = np.flatnonzero(count >= COMMON)
            if not len(good):
                continue
            of = h[np.searchsorted(base[h], good, "right") - 1]
            rest = good - base[of]
            i, e = rest % (starts[of] + 1), low[of] + rest // (starts[of] + 1)
            j = i + e
            fits = (j >= 0) & (j + MIN_TOKENS <= n[at][of])
            of, i, j, score = of[fits], i[fits], j[fits], count[good][fits]
            order = np.lexsort((j, -score, i, of))
            fresh = np.append(True, (of[order][1:] != of[order][:-1]) | (i[order][1:] != i[order][:-1]))[: len(order)]
            order = order[fresh]
            out.append((of[order] + at.start, i[order], j[order], score[order].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


class Runs:
    """The runs of the texts in a table of _OPEN with the cells they belong to (low, high, side).

    Two runs are compared if their labels differ: those of a table with labels, else each document is one of its own.
    """

    def __init__(self, table: pa.Table):
        doc, owner, text, low, high, side = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "owner", "text", "low", "high", "side"))
        order = np.lexsort((doc, text, high, low, owner))
        same = lambda *cols: np.append(False, np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in cols]))
        cell = np.cumsum(~same(owner, low, high)) - 1
        copy = same(owner, low, high, text)
        self.doc, self.cell, self.side, self.cross = doc[order], cell, side[order], (low != high)[order]
        self.label = table.column("label").to_numpy()[order] if "label" in table.column_names else self.doc
        keys, runs, kinds, tokens = (table.column(c).take(pa.array(order)).to_pylist() for c in ("keys", "runs", "kinds", "tokens"))
        self.stands = np.flatnonzero(~copy)[np.cumsum(~copy) - 1]  # the first of equal texts
        self.tokens = np.frombuffer(b"".join(tokens), np.uint32)
        size = np.array([len(t) // 4 for t in tokens], np.int64)
        self.row = np.repeat(np.arange(len(doc)), [len(k) // 8 for k in keys])
        self.key, self.kind = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(kinds), np.int64)
        self.first, self.last, at = np.frombuffer(b"".join(runs), np.int32).reshape(-1, 3).astype(np.int64).T
        self.at = at + (np.cumsum(size) - size)[self.row]
        whole = (np.repeat(np.arange(len(doc), dtype=np.int64), size) << 32) | self.tokens.astype(np.int64)
        order = np.argsort(whole, kind="stable")
        again = np.zeros(len(whole) + 1, bool)  # tokens that stand shortly before, too
        again[1:][order[1:][(whole[order][1:] == whole[order][:-1]) & (order[1:] - order[:-1] < MIN_TOKENS)]] = True
        again = np.cumsum(again)
        self.length = self.last - self.first + MIN_TOKENS
        #: No stretch of the run has fewer distinct tokens.
        self.fewest = np.maximum(MIN_TOKENS - (again[self.at + self.length] - again[self.at]), 1)

    def copies(self) -> Iterator[tuple]:
        """Rows of _LINK from the copies of a text to the first."""
        stands, doc = self.stands[self.row], self.doc[self.row]
        mine = np.flatnonzero((stands != self.row) & (doc != self.doc[stands]) & ~self.cross[self.row])
        row, first, end, other = merged(self.row[mine], self.first[mine], self.last[mine], stands[mine])
        for r, a, z, o in zip(row.tolist(), first.tolist(), end.tolist(), other.tolist()):
            yield int(self.doc[r]), int(self.doc[o]), a, z + SHINGLE - 1, a, z + SHINGLE - 1, 1.0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (run, run) of one signature that may be near: all but copies, those that lie in different chunks in a cell of two."""
        stays = np.flatnonzero(self.stands[self.row] == self.row)
        order = stays[np.lexsort((self.row[stays], self.key[stays], self.cell[self.row[stays]]))]
        cell, key = self.cell[self.row[order]], self.key[order]
        begin = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (key[1:] != key[:-1]))[: len(order)])
        size = np.diff(np.append(begin, len(order)))
        out = [np.zeros((2, 0), np.int64)]
        for n in range(2, FEW + 1):
            i, j = np.triu_indices(n, 1)
            group = begin[size == n][:, None]
            out.append(np.stack([order[(group + i).ravel()], order[(group + j).ravel()]]))
        few = self._wanted(*np.concatenate(out, axis=1))
        met, _ = similar(self.tokens, self.at[few[0]], self.length[few[0]], self.at[few[1]], self.length[few[1]])
        out = [few[:, met >= self._least(*self.fewest[few]) - 1e-3]]
        for a, n in zip(begin[size > FEW].tolist(), size[size > FEW].tolist()):
            out += (self._wanted(*x) for x in self._many(order[a : a + n]))
        a, b = np.concatenate(out, axis=1)
        later = self.doc[self.row[a]] > self.doc[self.row[b]]
        return np.where(later, a, b), np.where(later, b, a)

    def _wanted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ra, rb = self.row[a], self.row[b]
        wanted = (self.label[ra] != self.label[rb]) & ((self.kind[a] != self.kind[b]) | (self.kind[a] < 0)) & (~self.cross[ra] | (self.side[ra] != self.side[rb]))
        return np.stack([a[wanted], b[wanted]])

    @staticmethod
    def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens that two runs have in common where stretches with so many distinct tokens and more are near."""
        return SIMILARITY * np.maximum(np.maximum(a, b), (a + b) / (1 + SIMILARITY))

    def _many(self, group: np.ndarray) -> Iterator[np.ndarray]:
        """The pairs of a large group that have enough tokens in common to be near, by a product of matrices."""
        kind, label = self.kind[group], self.label[self.row[group]]
        if (kind[0] >= 0 and (kind == kind[0]).all()) or (label == label[0]).all():
            return
        entry = np.repeat(np.arange(len(group)), self.length[group])
        value, of, count = np.unique(self.tokens[_ranges(self.at[group], self.length[group])], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        column = np.full(len(value), -1, np.int64)
        column[shared] = np.arange(len(shared))
        entry, of = entry[column[of] >= 0], column[of][column[of] >= 0]
        sides = [np.arange(len(group))] * 2
        if self.cross[self.row[group[0]]]:
            sides = [np.flatnonzero(self.side[self.row[group]] == k) for k in (0, 1)]
        for some in np.array_split(sides[0], max(1, -(-len(sides[0]) // 1024))):
            for others in np.array_split(sides[1], max(1, -(-len(sides[1]) // 1024))):
                if not len(some) or not len(others) or (sides[0] is sides[1] and some[0] > others[-1]):
                    continue
                met = np.zeros((len(some), len(others)), np.float32)
                for c in range(0, len(shared), 4096):
                    held = np.zeros((len(group), min(4096, len(shared) - c)), np.float32)
                    these = (of >= c) & (of < c + 4096)
                    held[entry[these], of[these] - c] = 1
                    met += held[some] @ held[others].T
                least = self._least(self.fewest[group[some]][:, None], self.fewest[group[others]][None, :])
                i, j = np.nonzero((met >= least - 1e-3) & np.not_equal.outer(label[some], label[others]))
                i, j = some[i], others[j]
                once = i < j if sides[0] is sides[1] else np.ones(len(i), bool)
                yield np.stack([group[i[once]], group[j[once]]])

    def passages(self) -> tuple[np.ndarray, ...]:
        """(row, first token, tokens, where they are; the same of the other row) of the runs that two texts share, those
        together that overlap in both."""
        a, b = self.pairs()
        order = np.lexsort((self.first[b], self.first[a], self.row[b], self.row[a]))
        a, b = a[order], b[order]
        fresh = np.append(True, (self.row[a][1:] != self.row[a][:-1]) | (self.row[b][1:] != self.row[b][:-1]))[: len(a)]
        reach = lambda x: self.first[x][:-1] + self.length[x][:-1]
        fresh[1:] |= (self.first[a][1:] > reach(a)) | (self.first[b][1:] > reach(b)) | (self.first[b][:-1] > self.first[b][1:] + self.length[b][1:])
        begin = np.flatnonzero(fresh)
        if not len(begin):
            return (np.zeros(0, np.int64),) * 8
        out = []
        for x in (a, b):
            first, end = np.minimum.reduceat(self.first[x], begin), np.maximum.reduceat(self.first[x] + self.length[x], begin)
            out += [self.row[x][begin], first, end - first, np.minimum.reduceat(self.at[x], begin)]
        return tuple(out)

    def links(self, ra: np.ndarray, fa: np.ndarray, m: np.ndarray, a: np.ndarray, rb: np.ndarray, fb: np.ndarray, n: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Columns of _LINK, rows in place of documents: passages that are similar as a whole, else what they hold of similar stretches."""
        both, either = similar(self.tokens, a, m, b, n)
        score = both / np.maximum(either, 1)
        columns = lambda k, i, x, j, y, s: (ra[k], rb[k], fa[k] + i, fa[k] + i + x + SHINGLE - 2, fb[k] + j, fb[k] + j + y + SHINGLE - 2, s)
        whole = np.flatnonzero(score >= SIMILARITY)
        yield columns(whole, 0, m[whole], 0, n[whole], score[whole])
        once = both + either == m + n  # no token is twice in one of them
        rest = np.flatnonzero((score < SIMILARITY) & once & (both >= COMMON))
        for some in _slices((m + n)[rest], 1 << 22):
            yield from self._stretches(rest[some], a, m, b, n, columns)
        found = []
        for k in np.flatnonzero((score < SIMILARITY) & ~once).tolist():
            found += [(k, i, z - i + 1, x, y - x + 1, s) for s, i, z, x, y in matches(self.tokens[a[k] : a[k] + m[k]], Other(self.tokens[b[k] : b[k] + n[k]]))]
        if found:
            yield columns(*(np.array(c) for c in zip(*found)))

    def _stretches(self, rest: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, columns) -> Iterator[tuple[np.ndarray, ...]]:
        parts = -(-(m[rest] - MIN_TOKENS + 1) // STARTS)
        k = np.repeat(rest, parts)
        skipped = STARTS * _ranges(np.zeros(len(rest), np.int64), parts)
        of, i, j, count = near_starts(self.tokens, a[k] + skipped, np.minimum(m[k] - skipped, STARTS + MIN_TOKENS - 1), b[k], n[k])
        if not len(of):
            return
        k, i = k[of], i + skipped[of]
        fresh = np.append(True, (k[1:] != k[:-1]) | (i[1:] > i[:-1] + MIN_TOKENS) | (np.abs((j - i)[1:] - (j - i)[:-1]) > MIN_TOKENS))
        begin = np.flatnonzero(fresh)
        part = np.cumsum(fresh) - 1
        lead, low, high = k[begin], np.minimum.reduceat(j, begin), np.maximum.reduceat(j, begin)
        x, y = np.maximum.reduceat(i, begin) - i[begin] + MIN_TOKENS, high - low + MIN_TOKENS
        both, either = similar(self.tokens, a[lead] + i[begin], x, b[lead] + low, y)
        good = both >= SIMILARITY * either - 1e-9
        yield columns(lead[good], i[begin][good], x[good], low[good], y[good], both[good] / either[good])
        left = np.flatnonzero(~good[part])  # the best of each MIN_TOKENS starts
        order = left[np.lexsort((-count[left], (i[left] - i[begin][part[left]]) // MIN_TOKENS, part[left]))]
        step = (i[order] - i[begin][part[order]]) // MIN_TOKENS
        order = order[np.append(True, (part[order][1:] != part[order][:-1]) | (step[1:] != step[:-1]))[: len(order)]]
        width = np.full(len(order), MIN_TOKENS)
        yield columns(k[order], i[order], width, j[order], width, count[order] / (2 * MIN_TOKENS - count[order]))


    def joining(self) -> Iterator[tuple[np.ndarray, ...]]:
        """As links, of all passages: those that join labels which no link before has joined. What is joined is not compared."""
        passages = self.passages()
        ids, label = np.unique(self.label, return_inverse=True)
        root = np.arange(len(ids))
        todo, size = np.arange(len(passages[0])), FIRST
        while len(todo):
            some, todo, size = todo[:size], todo[size:], 2 * size
            for found in self.links(*(x[some] for x in passages)):
                kept = []
                for k, (i, j) in enumerate(zip(label[found[0]].tolist(), label[found[1]].tolist())):
                    if root[i] != root[j]:
                        root[root == max(root[i], root[j])] = min(root[i], root[j])
                        kept.append(k)
                yield tuple(c[kept] for c in found)
            todo = todo[root[label[passages[0][todo]]] != root[label[passages[4][todo]]]]


_KINDS = [np.float64 if c == "similarity" else np.int64 for c in _names(_LINK)]


def _near_links(table: pa.Table) -> pa.Table:
    """The links of the runs in some cells."""
    runs = Runs(table)
    parts = [[np.array(c, t) for c, t in zip(_link_columns(list(runs.copies())), _KINDS)]]
    parts += [(runs.doc[row], runs.doc[other], *rest) for row, other, *rest in runs.links(*runs.passages())]
    return pa.table([pa.array(np.concatenate([np.asarray(p[k], t) for p in parts])) for k, t in enumerate(_KINDS)], _names(_LINK)).combine_chunks()


def _joining_links(table: pa.Table) -> pa.Table:
    """Of the links of the runs in some cells those that join the labels which any of them joins, with both labels."""
    runs, kinds = Runs(table), [*_KINDS, np.int64, np.int64]
    parts = [[np.zeros(0, t) for t in kinds]]
    parts += [(runs.doc[row], runs.doc[other], *rest, runs.label[row], runs.label[other]) for row, other, *rest in runs.joining()]
    return pa.table([pa.array(np.concatenate([np.asarray(p[k], t) for p in parts])) for k, t in enumerate(kinds)], _names(_JOIN)).combine_chunks()


class Placed:
    """The documents in blocks, and the steps by which blocks get each other's texts."""

    def __init__(self, docs: DataFrame):
        self.n = partitions(docs.sparkSession)
        base = clean_docs(docs).where("doc_id IS NOT NULL")
        self.blocks = block_count(base, BLOCK_BYTES, self.n)
        self.docs = base.withColumn("block", self.block_of("doc_id")).repartition(self.n, "block")

    def block_of(self, c: str):
        return F.pmod(F.xxhash64(c), F.lit(self.blocks)).cast("int")

    def replies(self, asked: DataFrame) -> DataFrame:
        """asked: asking (a block), other_id. (block, other_id, text) for each of them, once."""

        def reply(key, table: pa.Table, asked: pa.Table) -> pa.Table:
            doc = table.column("doc_id").to_pylist()
            at: dict[int, list[int]] = {}
            for i, d in enumerate(doc):
                at.setdefault(d, []).append(i)
            wanted = sorted(set(zip(asked.column("asking").to_pylist(), asked.column("other_id").to_pylist())))
            pairs = [(a, d, i) for a, d in wanted for i in at.get(d, ())]
            text = table.column("text").combine_chunks().take(pa.array([i for _, _, i in pairs], pa.int64()))
            return pa.table({"block": pa.array([a for a, _, _ in pairs], pa.int32()), "other_id": pa.array([d for _, d, _ in pairs], pa.int64()), "text": text.cast(pa.string())})

        at = asked.withColumn("at", self.block_of("other_id"))
        return self.docs.groupBy("block").cogroup(at.groupBy("at")).applyInArrow(reply, "block int, other_id long, text string")


class Others:
    """The texts that a block got, as tokens; those of a doc_id with several rows are tried in turn."""

    def __init__(self, told: pa.Table):
        told = told.filter(pc.is_valid(told["text"])) if told.num_rows else told
        tokens, counts = tokens_of([(t or "").encode() for t in told.column("text").to_pylist()])
        self.texts: dict[int, list[Other]] = {}
        for name, end, count in zip(told.column("other_id").to_pylist(), np.cumsum(counts).tolist(), counts.tolist()):
            self.texts.setdefault(name, []).append(Other(tokens[end - count : end]))

    def links(self, b: Block, passages: tuple[np.ndarray, ...]) -> Iterator[tuple[tuple, int, list[tuple[int, int]], bool]]:
        """passages: as Block.passages gives them. Rows of _LINK, with the row in the block, the (first, last token) in the
        block of what the other text holds token for token, and whether that is the whole text and nothing else."""
        for r, a, z, d in zip(*(x.tolist() for x in passages)):
            at, mine = int(b.start[r]), b.tokens[a : z + 1]
            found, same = max(((matches(mine, o), o.tokens) for o in self.texts.get(d, ())), key=lambda m: sum(x[2] - x[1] for x in m[0]), default=([], None))
            copy = found and len(same) == b.counts[r] and np.array_equal(same, b.tokens[at : at + len(same)])
            for score, i, j, x, y in found:
                row = (int(b.doc[r]), d, a - at + i, a - at + j + SHINGLE - 1, x, y + SHINGLE - 1, float(score))
                yield row, r, [(a + i + u, a + i + v) for u, v in equal_parts(mine[i : j + 1], same[max(x - MIN_TOKENS, 0) : y + MIN_TOKENS + 1])], copy


def _link_columns(out: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*out)] if out else [[] for _ in range(7)]


def further_links(runs: DataFrame) -> DataFrame:
    """The links between the runs (_OPEN) of one signature, other than those to its owner.

    Texts of an owner with many are dealt into parts by a hash of the text; a text goes to a cell with each part.
    """
    parts = F.ceil(F.approx_count_distinct("text") / F.lit(MEMBERS)).cast("int").alias("parts")
    many = written(runs.groupBy("owner").agg(parts).where("parts > 1"), "owners")
    placed = runs.join(many, "owner", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("text"), "parts").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cell = [F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side")]
    bucketed = placed.select(*_names(_OPEN), *cell).withColumn("bucket", F.pmod(F.xxhash64("owner", "low", "high"), F.lit(4 * partitions(runs.sparkSession))).cast("int"))
    return bucketed.groupBy("bucket").applyInArrow(_near_links, _LINK).distinct()


def passage_links(docs: DataFrame) -> DataFrame:
    """doc_id, other_id (an earlier document), the words of the passage in both, and the similarity of their token sets."""
    found = written(_owner_links(docs), "passages")
    return found.where("other_id IS NOT NULL").select(*_names(_LINK)).unionByName(further_links(found.where("other_id IS NULL").select(*_names(_OPEN))))


def _owner_links(docs: DataFrame) -> DataFrame:
    """The links to the owners of signatures, and without an other_id the runs that further_links is to look at."""
    placed = Placed(docs)
    buckets = max(placed.n, placed.blocks // 4)

    def built(table: pa.Table) -> Block:
        b = Block(table.column("doc_id").to_numpy(), table.column("text").to_pylist())
        b.windows()
        return b

    def send(table: pa.Table) -> pa.Table:
        b, block, out = built(table), table.column("block")[0].as_py(), []
        first, _, two, bucket = _bucketed(b, buckets)
        doc, key = b.doc[b.row[first]], _short(b.key[first] >> np.uint64(16))
        for k, at in enumerate(_dealt(bucket, buckets)):
            if len(at):
                out.append((k, block, key[at].tobytes(), _squeeze(np.diff(doc[at], prepend=0)), _two_bits(two[at].astype(np.uint8))))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "keys", "docs", "two"])

    def settle(table: pa.Table) -> pa.Table:
        doc = [np.cumsum(_expand(x, np.int64)) for x in table.column("docs").to_pylist()]
        sizes = [len(d) for d in doc]
        two = np.concatenate([_from_two_bits(x, n) for x, n in zip(table.column("two").to_pylist(), sizes)]) > 0
        key, doc = _long(b"".join(table.column("keys").to_pylist())), np.concatenate(doc)
        order = np.argsort(key, kind="stable")
        fresh = np.append(True, key[order][1:] != key[order][:-1])
        begin, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        least = np.minimum.reduceat(doc[order], begin)[group]
        holders = np.add.reduceat(1 + two[order].astype(np.int64), begin)[group]
        owner, more = np.empty(len(key), np.int64), np.empty(len(key), np.uint8)
        owner[order], more[order] = np.where(holders > 1, least, -1), holders > 2
        out, cuts = [], np.cumsum(sizes)[:-1]
        for block, bucket, part, bits in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(owner, cuts), np.split(more, cuts)):
            if (part >= 0).any():
                out.append((block, bucket, _squeeze(part), _two_bits(bits), _squeeze(np.unique(part[part >= 0]))))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "bucket", "owners", "more", "asked"])

    def ask(table: pa.Table) -> pa.Table:
        other = np.unique(np.concatenate([_expand(x, np.int64) for x in table.column("asked").to_pylist()]))
        return pa.table({"asking": pa.array(np.full(len(other), table.column("block")[0].as_py(), np.int32)), "other_id": pa.array(other)})

    def verify(key, table: pa.Table, told: pa.Table) -> pa.Table:
        b = built(table)
        answers = told.filter(pc.is_valid(told["owners"])) if told.num_rows else told
        _, of, _, bucket = _bucketed(b, buckets)
        owner, more = (x[of] for x in _owners(answers, bucket))
        out, equal, linked, copies = [], [], {}, set()
        for row, r, parts, copy in Others(told).links(b, b.passages(owner)):
            out.append(row)
            equal += [(a, z, row[1], r) for a, z in parts]
            if copy:
                copies.add((r, row[1]))
            linked.setdefault((r, row[1]), []).append((row[2], row[3] - SHINGLE + 2))
        # an edited copy of the owner's whole text is a text of its own, whatever parts of it are equal
        edited = {(r, d) for (r, d), parts in linked.items() if b.mostly(r, parts)} - copies
        exact = [(a, z, d) for a, z, d, r in equal if (r, d) not in edited]
        shared = np.flatnonzero(more & (owner < b.doc[b.row]))
        runs = list(b.sent_runs(*b.open_runs(shared, owner[shared], exact)))
        cols, sent = _link_columns(out), list(zip(*runs)) if runs else [[]] * 7
        for c in range(len(cols)):
            cols[c] += sent[0] if c == 0 else [None] * len(runs)
        cols += [[None] * len(out) + list(x) for x in sent[1:]]
        kinds = (pa.int64(),) * 6 + (pa.float64(), pa.int64(), pa.int64()) + (pa.binary(),) * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], [*_names(_LINK), *_names(_OPEN)[1:]])

    # one plan, so that the texts are shuffled once and that exchange is used by every pass
    sent = placed.docs.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary, docs binary, two binary")
    told = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle, "block int, bucket int, owners binary, more binary, asked binary")
    replies = placed.replies(told.select("block", "asked").groupBy("block").applyInArrow(ask, "asking int, other_id long"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = told.select("block", "bucket", "owners", "more", none("long", "other_id"), none("string", "text"))
    both = both.unionByName(replies.select("block", none("int", "bucket"), none("binary", "owners"), none("binary", "more"), "other_id", "text"))
    return placed.docs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(verify, _LINK + _OPEN.removeprefix("doc_id long"))


def near_duplicate_passages(docs: DataFrame) -> DataFrame:
    """passage_links with class_id, the smallest doc_id that a document's links reach."""
    links = written(passage_links(docs), "passages")
    found = components(links.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b")))
    return links.join(found.select(F.col("node").alias("doc_id"), F.col("root").alias("class_id")), "doc_id")


def _joined_nodes(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges a, b, roots too."""
    found = components(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _relabelled(rows: DataFrame, joined: DataFrame, *columns: str) -> DataFrame:
    """rows with the labels that ``joined`` (node, root) gives to theirs."""
    return rows.join(joined, rows["label"] == joined["node"], "left").select(*columns, F.coalesce("root", "label").alias("label"))


def _bridges(texts: DataFrame) -> DataFrame:
    """texts: doc_id, owner, text, label. The cells in which the texts of an owner with several labels meet: up to two parts
    are one cell; of more parts the first meets each, so that every text goes to one cell but for those of the first part."""
    many = texts.groupBy("owner").agg(F.count(F.lit(1)).alias("texts"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    many = many.select("owner", F.when(F.col("texts") > 2 * MEMBERS, F.ceil(F.col("texts") / MEMBERS)).otherwise(1).cast("int").alias("parts"))
    placed = texts.join(many, "owner").withColumn("part", F.pmod(F.xxhash64("text"), "parts").cast("int"))
    high = F.explode(F.expr("if(part = 0, sequence(0, parts - 1), array(part))")).alias("high")
    return placed.select("doc_id", "owner", "text", "label", "part", high).select("doc_id", "owner", "text", "label", F.lit(0).alias("low"), "high", (F.col("part") > 0).cast("int").alias("side"))


def _remaining(texts: DataFrame) -> DataFrame:
    """As _bridges, for owners of more than two parts: all cells of two parts, but for two of the owner's commonest label."""
    counts = texts.groupBy("owner", "label").agg(F.count(F.lit(1)).alias("texts")).groupBy("owner")
    counts = counts.agg(F.sum("texts").alias("all"), F.max(F.struct("texts", "label")).alias("main")).where(f"all > {2 * MEMBERS} AND all > main.texts")
    parts = lambda n: F.ceil(n / F.lit(MEMBERS)).cast("int")
    many = counts.select("owner", F.col("main.label").alias("main"), parts(F.col("all") - F.col("main.texts")).alias("others"), parts(F.col("main.texts")).alias("mains"))
    part = F.expr("if(label = main, others + pmod(xxhash64(text), mains), pmod(xxhash64(text), others))").cast("int").alias("part")
    with_part = F.explode(F.expr("sequence(0, if(label = main, others, others + mains) - 1)")).alias("other")
    placed = texts.join(many, "owner").select("doc_id", "owner", "text", "label", part, with_part)
    return placed.select("doc_id", "owner", "text", "label", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side"))


def _joined_labels(runs: DataFrame, cells: DataFrame) -> DataFrame:
    """runs: _OPEN; cells: as _bridges gives them. node, root of the labels that the links in the cells join."""
    cells = written(cells, "cells")
    buckets = max(4 * partitions(runs.sparkSession), -(-cells.count() // CELL_ROWS))
    bucketed = runs.join(cells, ["doc_id", "owner", "text"]).withColumn("bucket", F.pmod(F.xxhash64("owner", "low", "high"), F.lit(buckets)).cast("int"))
    return _joined_nodes(bucketed.groupBy("bucket").applyInArrow(_joining_links, _JOIN).select(F.col("label").alias("a"), F.col("other_label").alias("b")))


def passage_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id that its links reach, itself included), linked (to any other).

    The classes are those of all of passage_links, but two texts that are in one class already are not compared: a family
    of edited copies is joined through its owner. The open runs of different classes meet twice: in cells that grow with
    the texts, and what is still apart then in all cells of its owner.
    """
    found = written(_owner_links(docs), "passages")
    runs = found.where("other_id IS NULL").select(*_names(_OPEN))
    every = runs.select("doc_id", "owner", "text")
    first = every.groupBy("owner", "text").agg(F.min("doc_id").alias("first"))
    equal = every.join(first, ["owner", "text"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    labels = [_joined_nodes(found.where("other_id IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("other_id").alias("b")).unionByName(equal))]
    texts = first.select(F.col("first").alias("doc_id"), "owner", "text", F.col("first").alias("label"))
    for cells in (_bridges, _remaining):
        texts = written(_relabelled(texts, labels[-1], "doc_id", "owner", "text"), "texts")
        labels.append(_joined_labels(runs, cells(texts)))
    out = clean_docs(docs).where("doc_id IS NOT NULL").select("doc_id").distinct().select("doc_id", F.lit(False).alias("linked"), F.col("doc_id").alias("label"))
    for joined in labels:
        out = _relabelled(out, joined, "doc_id", (F.col("linked") | F.col("node").isNotNull()).alias("linked"))
    return out.select("doc_id", F.col("label").alias("class_id"), "linked")


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_classes(docs_table(spark, sf_dir))
