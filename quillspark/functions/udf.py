"""The few functions that Spark lacks, as Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import itertools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quillspark.functions.text import plain_key


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts, the common case, come back as they are."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def match_key(text: Column) -> Column:
    """What quotes and pages are compared by: compatibility form, lower case, without white space and punctuation."""
    return plain_key(nfkc(F.coalesce(text, F.lit(""))))


#: The widths of windows as shares of the quote's length, how many steps a quote's length is, and the length
#: up to which a quote is compared with the whole text instead.
WIDTHS, STEPS, WHOLE = (0.75, 0.9, 1.0, 1.1, 1.35), 5, 3


#: Characters of the quote that one machine word stands for in a bound; of longer quotes the parts' bounds add up.
_WORD = 63


def _coded(quotes: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The characters of all quotes in a row and where each begins, those of the texts, and how many letters the quotes have: a
    letter is its place among them; what no quote has is the number after the last."""
    points = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (quotes, texts)]
    letters, q = np.unique(points[0], return_inverse=True)
    place = np.minimum(np.searchsorted(letters, points[1]), len(letters) - 1)
    kind = np.uint8 if len(letters) < 250 else np.uint32
    t = np.where(letters[place] == points[1], place, len(letters))
    return q.astype(kind), np.cumsum([0, *map(len, quotes)]), t.astype(kind), np.cumsum([0, *map(len, texts)]), len(letters)


def _cut(codes: np.ndarray, low: np.ndarray, high: np.ndarray, pad: int) -> np.ndarray:
    """A column for each stretch of codes, from low to high, filled up with pad."""
    at = low + np.arange(int((high - low).max()))[:, None]
    return np.where(at < high, codes[np.minimum(at, len(codes) - 1)], codes.dtype.type(pad)) if len(at) else np.zeros((0, len(low)), codes.dtype)


def _places(a: np.ndarray, letters: int) -> np.ndarray:
    """[column, letter]: where each letter stands among at most _WORD characters of a column of a, a bit each."""
    masks, every = np.zeros((a.shape[1], letters), np.uint64), np.arange(a.shape[1])
    for i, row in enumerate(a):
        masks[every, row] |= np.uint64(1 << i)
    return masks


def window_bounds(quote: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bound, start, end) of every window of the text that the quote is compared with.

    What two texts have in common in blocks, in order, is a common subsequence of both; so the ratio of a window is at most
    twice the longest one over both lengths. That is found for all windows at once, a bit for each character of the quote:
    windows of one start are prefixes of each other, so one pass over the widest gives the bounds of all.
    """
    q, q0, t, t0, letters = _coded([quote], [text])
    return _bounds(q, q0[:1], t, t0[:-1], t0[1:], len(quote), letters)[0]


def _bounds(quotes: np.ndarray, q0: np.ndarray, texts: np.ndarray, t0: np.ndarray, t1: np.ndarray, n: int, letters: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """window_bounds of several quotes, all of n characters, and their texts."""
    sizes = (t1 - t0).tolist()
    if n <= WHOLE:
        return [(np.array([1.0]), np.array([0]), np.array([size])) for size in sizes]
    step, widths = max(1, n // STEPS), sorted({int(n * share) for share in WIDTHS})
    starts = np.arange(0, max(max(sizes) - widths[0], 0) + 1, step)
    reach, every = int(starts[-1]) + 1, np.arange(len(sizes))[:, None]
    a, b = _cut(quotes, q0, q0 + n, letters).T, _cut(texts, t0, t1, letters).T
    b = np.concatenate([b, np.full((len(b), reach + widths[-1] - b.shape[1]), letters, b.dtype)], axis=1) if reach + widths[-1] > b.shape[1] else b
    common = np.zeros((len(widths), len(sizes), len(starts)), np.int64)
    b = np.concatenate([b, np.full((len(b), -b.shape[1] % step), letters, b.dtype)], axis=1)
    b = np.ascontiguousarray(b.reshape(len(b), -1, step).transpose(2, 0, 1))  # what the windows read at one place stands side by side
    parts = [a[:, at : at + _WORD] for at in range(0, n, _WORD)]
    here = np.stack([_places(part.T, letters + 1)[every, b] for part in parts], axis=1)
    full = np.array([(1 << part.shape[1]) - 1 for part in parts], np.uint64)[:, None, None]
    free = np.broadcast_to(full, (len(parts), *common.shape[1:])).copy()
    hit, both = np.empty_like(free), np.empty_like(free)
    for k in range(widths[-1]):
        np.bitwise_and(free, here[k % step, :, :, k // step : k // step + len(starts)], out=hit)
        np.add(free, hit, out=both)  # what is carried beyond the part never comes back
        np.subtract(free, hit, out=free)
        np.bitwise_or(free, both, out=free)
        if k + 1 in widths:
            common[widths.index(k + 1)] = n - np.bitwise_count(free & full).sum(axis=0, dtype=np.int64)
    out = []
    for g, size in enumerate(sizes):
        many = [max(size - width, 0) // step + 1 for width in widths]
        low = np.concatenate([starts[:m] for m in many])
        high = np.minimum(low + np.repeat(widths, many), size)
        out.append((np.minimum(2.0 * np.concatenate([row[:m] for row, m in zip(common[:, g], many)]) / (n + high - low), 1.0), low, high))
    return out


def _common(masks: dict[str, int], low: int, high: int, text: str) -> int:
    """The length of the longest common subsequence of text and the quote's characters low to high. masks: where each stands."""
    full = (1 << (high - low)) - 1
    free = full
    for c in text:
        hit = free & (masks.get(c, 0) >> low)
        free = ((free + hit) | (free - hit)) & full
    return high - low - free.bit_count()


def window_ratio(quote: str, text: str, floor: float = 0.0, first: bool = False) -> float | None:
    """The best similarity of the quote with a window, or the first one found that reaches the floor; None if none does. The
    ratio is not symmetric: the quote is the first sequence. Windows are compared from the highest bound down, until no bound is
    above the best or reaches the floor."""
    if not quote or not text:
        return 0.0 if floor <= 0 else None
    if quote in text:
        return 1.0
    best, matcher = 0.0, difflib.SequenceMatcher(None, quote, "")
    bound, start, end = window_bounds(quote, text)
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] <= best or bound[k] < floor:
            break
        window = text[start[k] : end[k]]
        matcher.set_seq2(window)
        if len(quote) > WHOLE:  # what is left and right of the longest block cannot cross it
            a, b, n = matcher.find_longest_match()
            most = 2.0 * (n + _common(masks, 0, a, window[:b]) + _common(masks, a + n, len(quote), window[b + n :])) / (len(quote) + len(window))
            if most <= best or most < floor:
                continue
        best = max(best, matcher.ratio())
        if first and best >= floor:
            break
    return best if best >= floor else None


@F.pandas_udf(DoubleType())
def best_window_ratio(needles: pd.Series, hays: pd.Series) -> pd.Series:
    """window_ratio for each pair; meant for the few pairs that exact containment left over."""
    return pd.Series([window_ratio(a or "", b or "") for a, b in zip(needles, hays)])


#: How many pairs are bounded together and how many places of theirs at most, how many windows are compared together, and how
#: many of a pair in turn: the highest bounds often decide.
_PAIRS, _AREA, _WINDOWS, _TURNS = 1024, 1 << 22, 2048, (8, 1 << 30)
#: Fixed value: the size from which difflib starts no block in a window's common characters.
_COMMON = 200


def _longest(a: np.ndarray, sizes: np.ndarray, b: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of each column's longest block, the first in a and then in b, as difflib finds it: a run
    of seeds, then what is equal before and behind it. Columns are padded with what equals nothing, the longest a first."""
    height, n = b.shape
    kind = np.uint8 if min(len(a), height) < 255 else np.uint16
    before, run = np.zeros((height + 1, n), kind), np.zeros((height + 1, n), kind)
    best, end_a, end_b = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, on in enumerate(np.searchsorted(-sizes, -np.arange(len(a)), "left").tolist()):  # those of more than i characters
        now = run[1:, :on]
        np.add(before[:-1, :on], kind(1), out=now)
        np.multiply(now, seeds[:, :on] == a[i, :on], out=now)
        top = now.max(axis=0)
        better = (top > best[:on]).nonzero()[0]
        if len(better):
            best[better], end_a[better], end_b[better] = top[better], i + 1, now[:, better].argmax(axis=0) + 1
        before, run = run, before
    size = best.astype(np.int64)
    x, y, every = end_a - size, end_b - size, np.arange(n)
    while (more := (x > 0) & (y > 0) & (a[x - 1, every] == b[y - 1, every])).any():
        x, y, size = x - more, y - more, size + more
    while (more := (x + size < len(a)) & (y + size < height) & (a[np.minimum(x + size, len(a) - 1), every] == b[np.minimum(y + size, height - 1), every])).any():
        size = size + more
    return x, y, size


def _ratios(quotes: np.ndarray, texts: np.ndarray, letters: int, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, enough: np.ndarray, longest: np.ndarray | None = None) -> np.ndarray:
    """difflib's ratios of stretches a0 to a1 of the quotes and b0 to b1 of the texts, for all at once: a level of blocks after the
    other. One that cannot reach enough is given up; its value is then too low, and below that. longest: what no block exceeds."""
    kind = quotes.dtype.type
    pad_a, pad_b = letters + 1, letters + 2

    n, size = a1 - a0, b1 - b0
    common = None
    if (size >= _COMMON).any():
        b = _cut(texts, b0, b1, pad_b)
        times = np.bincount((np.arange(len(size)) * (letters + 3) + b).ravel(), minlength=len(size) * (letters + 3)).reshape(len(size), -1)
        common = (times > size[:, None] // 100 + 1) & (size >= _COMMON)[:, None]
        if longest is not None:  # a block holds a character that is not common, in both
            a = _cut(quotes, a0, a1, pad_a)
            there = np.bincount((np.arange(len(size)) * (letters + 3) + a).ravel(), minlength=times.size).reshape(times.shape)
            seeds = np.where(common, 0, np.minimum(there, times))[:, :letters].sum(axis=1)
            near = (2.0 * seeds * longest / (n + size) >= enough).nonzero()[0]
            if len(near) < len(size):
                out = np.zeros(len(size))
                if len(near):
                    out[near] = _ratios(quotes, texts, letters, *(c[near] for c in (a0, a1, b0, b1, enough)))
                return out
    matched, of = np.zeros(len(size), np.int64), np.arange(len(size))
    while len(of):
        most = matched + np.bincount(of, np.minimum(a1 - a0, b1 - b0), len(size))
        keep = (2.0 * most / (n + size) >= enough)[of].nonzero()[0]
        keep = keep[np.argsort((a0 - a1)[keep], kind="stable")]
        of, a0, a1, b0, b1 = (c[keep] for c in (of, a0, a1, b0, b1))
        if not len(of):
            break
        a, b = _cut(quotes, a0, a1, pad_a), _cut(texts, b0, b1, pad_b)
        x, y, k = _longest(a, a1 - a0, b, b if common is None else np.where(common[of, b], kind(pad_b), b))
        matched += np.bincount(of, k, len(size)).astype(np.int64)
        x, y = a0 + x, b0 + y
        of, a0, a1, b0, b1 = (np.concatenate(c) for c in ((of, of), (a0, x + k), (x, a1), (b0, y + k), (y, b1)))
        keep = ((a0 < a1) & (b0 < b1) & np.append(k > 0, k > 0)).nonzero()[0]
        of, a0, a1, b0, b1 = (c[keep] for c in (of, a0, a1, b0, b1))
    return 2.0 * matched / (n + size)


#: The most bytes of one table of runs, and how many pairs share one.
_TABLE, _SHARED = 1 << 26, 32
_ONES, _LOG = np.array([(1 << i) - 1 for i in range(_WORD + 1)], np.uint64), np.array([max(i, 1).bit_length() - 1 for i in range(_COMMON)])


class _Runs:
    """Where quotes and their texts are equal: for each length of a run and each place of a text the places of the quote, a bit
    each, at which both have ended such a run, and the same for all stretches of 1, 2, 4 and more places together. So two look-ups
    tell whether a stretch of the text and one of the quote share a run of a length: blocks of all windows come from one table.

    Windows of _COMMON characters are not for it, and where it took over _TABLE bytes there is none (table is None)."""

    def __init__(self, quotes: np.ndarray, q0: np.ndarray, q1: np.ndarray, texts: np.ndarray, t0: np.ndarray, t1: np.ndarray, letters: int, widest: int):
        sizes = t1 - t0
        of = np.repeat(np.arange(len(sizes)), sizes)
        every = np.arange(len(of))
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # the texts in a row, a gap after each
        total, a = int((sizes + 1).sum()), _cut(quotes, q0, q1, letters)
        self.words, levels = -(-len(a) // _WORD), widest.bit_length()
        one = np.zeros((self.words, total), np.uint64)
        for w in range(self.words):
            masks = _places(a[w * _WORD : (w + 1) * _WORD], letters + 1)
            masks[:, letters] = 0
            one[w, every + of] = masks[of, texts[every + np.repeat(t0 - np.cumsum(sizes) + sizes, sizes)]]
        pair = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.longest, self.table, runs, run, k = np.zeros(len(sizes), np.int64), None, [], one, 0
        while len(there := run.any(axis=0).nonzero()[0]):
            k += 1
            self.longest[pair[there]] = k
            if k <= widest:
                runs.append(run)
            if len(runs) * levels * one.size * 8 > _TABLE:
                return
            moved = (run << np.uint64(1)) & _ONES[_WORD]
            moved[1:] |= run[:-1] >> np.uint64(_WORD - 1)
            run = np.zeros_like(one)
            np.bitwise_and(moved[:, :-1], one[:, 1:], out=run[:, 1:])
        table = np.zeros((levels, len(runs), self.words, total + (1 << levels)), np.uint64)
        for k, run in enumerate(runs):
            table[0, k, :, :total] = run
        for level in range(1, levels):
            half = 1 << (level - 1)
            np.bitwise_or(table[level - 1, ..., :-half], table[level - 1, ..., half:], out=table[level, ..., :-half])
        self.table, (self.by_level, self.by_k, self.by_word) = table.ravel(), [x // 8 for x in table.strides[:3]]

    def blocks(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start in the quote, start in the row of texts, length, at most most) of the longest blocks, the first in the quote
        and then in the text, as difflib finds them."""
        by_k, by_level, by_word = self.by_k, self.by_level, self.by_word
        size, bits, word = most.copy(), np.zeros(len(most), np.uint64), np.zeros(len(most), np.int64)
        open_ = (size > 0).nonzero()[0]
        while len(open_):
            k, x0, x1, end = size[open_], a0[open_], a1[open_], b1[open_]
            low = b0[open_] + k - 1
            level = _LOG[end - low]
            first = (k - 1) * by_k + level * by_level
            second, first = first + end - (1 << level), first + low
            x0 = x0 + k - 1
            hit = np.zeros(len(open_), np.uint64)
            for w in range(self.words)[::-1]:  # the first word that has a place stays
                from_, to = (x0, x1) if self.words == 1 else (np.minimum(np.maximum(x - w * _WORD, 0), _WORD) for x in (x0, x1))
                here = (self.table[first + w * by_word] | self.table[second + w * by_word]) & (_ONES[to] ^ _ONES[np.minimum(from_, to)])
                if self.words > 1:
                    word[open_] = np.where(here > 0, w, word[open_])
                hit = np.where(here > 0, here, hit)
            bits[open_] = hit
            open_ = open_[hit == 0]
            size[open_] -= 1
            open_ = open_[size[open_] > 0]
        bits &= ~bits + np.uint64(1)
        at = b0 + size - 1
        level, row = _LOG[np.maximum(b1 - at, 0) * (size > 0)], (size - 1) * by_k + word * by_word
        for n in range(int(level.max(initial=0)), -1, -1):
            some = ((level >= n) & (size > 0)).nonzero()[0]
            at[some] += ((self.table[row[some] + n * by_level + at[some]] & bits[some]) == 0).astype(np.int64) << n
        return word * _WORD + np.bitwise_count(bits - (bits > 0)).astype(np.int64) - size + 1, at - size + 1, size

    def ratios(self, pair: np.ndarray, n: np.ndarray, start: np.ndarray, end: np.ndarray, enough: np.ndarray) -> np.ndarray:
        """difflib's ratios of the quotes of pairs, n long, and windows of their texts, shorter than _COMMON, a level of blocks
        after the other. One that cannot reach enough is given up; its value is then too low, and below that."""
        size, matched, of = end - start, np.zeros(len(pair), np.int64), np.arange(len(pair))
        a0, a1, b0, b1, k = np.zeros_like(n), n, self.begin[pair] + start, self.begin[pair] + end, self.longest[pair]
        while len(of):
            least = np.minimum(a1 - a0, b1 - b0)
            most = matched + np.bincount(of, least, len(size))
            keep = (2.0 * most / (n + size) >= enough)[of].nonzero()[0]
            of, a0, a1, b0, b1, k = (c[keep] for c in (of, a0, a1, b0, b1, np.minimum(k, least)))
            x, y, k = self.blocks(a0, a1, b0, b1, k)
            matched += np.bincount(of, k, len(size)).astype(np.int64)
            of, a0, a1, b0, b1, k = (np.concatenate(c) for c in ((of, of), (a0, x + k), (x, a1), (b0, y + k), (y, b1), (k, k)))
            keep = ((a0 < a1) & (b0 < b1) & (k > 0)).nonzero()[0]
            of, a0, a1, b0, b1, k = (c[keep] for c in (of, a0, a1, b0, b1, k))
        return 2.0 * matched / (n + size)


def near_ratios(pairs: list[tuple[str | None, str | None, float]]) -> list[float | None]:
    """window_ratio(quote, text, floor, True) of each pair, floors above 0, with the windows of many pairs compared together."""
    out: list[float | None] = [None] * len(pairs)
    asked = [i for i, (q, t, _) in enumerate(pairs) if q and t]
    for i in asked:
        out[i] = 1.0 if pairs[i][0] in pairs[i][1] else None
    asked = sorted((i for i in asked if out[i] is None), key=lambda i: len(pairs[i][0]))
    for at in range(0, len(asked), _PAIRS):
        some = asked[at : at + _PAIRS]
        for i, found in zip(some, _near([pairs[i] for i in some])):
            out[i] = found
    return out


def _near(pairs: list[tuple[str, str, float]]) -> list[float | None]:
    quotes, q0, texts, t0, letters = _coded([q for q, _, _ in pairs], [t for _, t, _ in pairs])
    sizes, out, windows = np.diff(t0), [None] * len(pairs), {}
    for n, same in itertools.groupby(range(len(pairs)), key=lambda p: len(pairs[p][0])):
        same = np.array(list(same))
        few = max(1, _AREA // (-(-n // _WORD) * int(sizes[same].max() + n)))
        for at in (same[i : i + few] for i in range(0, len(same), few)):
            for p, (bound, start, end) in zip(at.tolist(), _bounds(quotes, q0[at], texts, t0[at], t0[at + 1], n, letters)):
                order = np.argsort(-bound, kind="stable")
                order = order[(bound[order] >= pairs[p][2]) & (bound[order] > 0)]
                if len(order):
                    windows[p] = (start[order], end[order])
    floors, asked = np.array([f for _, _, f in pairs]), np.array(list(windows), np.int64)
    waiting = [asked[i : i + _SHARED] for i in range(0, len(asked), _SHARED)]
    while waiting:
        some = waiting.pop()
        widest = max(int(np.where(e - s < _COMMON, e - s, 1).max()) for s, e in (windows[p] for p in some.tolist()))
        runs = _Runs(quotes, q0[some], q0[some + 1], texts, t0[some], t0[some + 1], letters, widest)
        if runs.table is None and len(some) > 1:
            waiting += np.array_split(some, 2)
            continue
        done = 0
        for turn in _TURNS:
            open_ = [p for p in some.tolist() if out[p] is None and len(windows[p][0]) > done]
            if not open_:
                break
            start, end = (np.concatenate([windows[p][i][done : done + turn] for p in open_]) for i in (0, 1))
            of = np.repeat(open_, [len(windows[p][0][done : done + turn]) for p in open_])
            g, ratios, short = np.searchsorted(some, of), np.zeros(len(of)), (end - start < _COMMON) & (runs.table is not None)
            for c in _slices(short.nonzero()[0]):
                ratios[c] = runs.ratios(g[c], q0[of[c] + 1] - q0[of[c]], start[c], end[c], floors[of[c]])
            for c in _slices((~short).nonzero()[0]):
                most = None if runs.table is None else runs.longest[g[c]]
                ratios[c] = _ratios(quotes, texts, letters, q0[of[c]], q0[of[c] + 1], t0[of[c]] + start[c], t0[of[c]] + end[c], floors[of[c]], most)
            for k in np.flatnonzero(ratios >= floors[of])[::-1].tolist():  # the first one found stays
                out[of[k]] = float(ratios[k])
            done += turn
    return out


def _slices(at: np.ndarray) -> list[np.ndarray]:
    return [at[i : i + _WINDOWS] for i in range(0, len(at), _WINDOWS)]


@F.pandas_udf(DoubleType())
def near_window_ratio(needles: pd.Series, hays: pd.Series, floors: pd.Series) -> pd.Series:
    """A similarity that reaches the floor, the first one found; null where none does, which most pairs' bounds tell alone."""
    return pd.Series(near_ratios(list(zip(needles, hays, floors))), dtype="float64")
