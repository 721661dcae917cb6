"""Every training-data operator on hand-made rows: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, exact_dedup, packing, passages, quality, sharding, simhash, suffix_dedup, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, block int, keep_id string, words int, n_chars long"


def words(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(1 + i % 9)) + str(i % 7) for i in (r.randrange(vocabulary) for _ in range(n)))


LONG = words(1, 3000, 4000)
SHARED = words(2, 60, 5000)
TEXTS = [
    None, "", " \t\n", "one", "one two", "a\x0bb  c\r\nd", LONG, LONG, LONG + " end", "Ünïcödé 中文 text 😀 " * 9, "x" * 20_000,
    words(3, 120) + " " + SHARED + " " + words(4, 90), SHARED + " " + words(5, 100), words(6, 80) + "\n" + SHARED.upper(), "same line\n" * 40, words(7, 200), "<|endoftext|> [INST] \\",
    LONG[:6000], LONG[50:4000] + "é", "ééé" * 40 + "tail",
]
ROWS = [(i if i != 15 else None, t, "en", 1, "k", 2, len(t or "")) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], ROWS[0], (3, "one", None, None, None, None, None), (40, "one", "x", 0, "", 0, 3), (41, "One", "x", 0, "", 0, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# quality rules


def base_counts(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]", text) if w]
    grams = {}
    for i in range(len(ws) - 2):
        grams.setdefault(tuple(ws[i : i + 3]), []).append(i)
    rep = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


def test_quality_counts(docs, none):
    got = plain(quality.quality_metrics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(((r[0], *base_counts(r[1])) for r in ROWS), key=repr)
    kept = quality.judge(quality.quality_metrics(docs)).select("base_failed", "kept", "n_words", "n_repeat_words").collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in kept)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(none).count() == 0


def test_quality_is_native(docs):
    assert "Python" not in quality.keep_good(docs)._jdf.queryExecution().executedPlan().toString()


# exact dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, none):
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = []
    for r in ROWS:
        ids = groups[norm(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), keep is None or r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    assert plain(exact_dedup.dedup_decisions(docs).collect()) == sorted(want, key=repr)
    assert exact_dedup.dedup_decisions(none).count() == 0
    assert exact_dedup.keep_first(docs).columns == docs.columns


def test_a_run_over_many_partitions_is_one_group(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise(F.lit("copy  of\tall")).alias("text"))
    got = exact_dedup.dedup_decisions(many).where("group_size > 1").agg(F.count(F.lit(1)), F.min("keep_id"), F.max("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (2700, 1, 1, 2700, 1)


# SimHash


def fingerprint(t):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, radius=3):
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= radius) for i in range(len(fps))]
        new = [new[new[i]] for i in range(len(fps))]
        if new == label:
            return label
        label = new
    return label


def test_simhash(docs, none):
    fps = [fingerprint(r[1]) for r in ROWS]
    label = brute_components(fps)
    first = {}
    for r, k in zip(ROWS, label):
        ids = [x for x in (first.get(k), r[0]) if x is not None]
        first[k] = min(ids) if ids else None
    want = sorted(((r[0], f % (1 << 64), first[k]) for r, f, k in zip(ROWS, fps, label)), key=repr)
    assert plain((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_representatives(docs).columns == docs.columns


def test_links_span_the_components_of_all_pairs(spark):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ ((1 << r.randrange(64)) if r.random() < 0.5 else 0) for c in centres for _ in range(40)} | {r.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {x.node: x.root for x in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    label = brute_components(fps)
    got = {}
    for f, k in zip(signed, label):
        got.setdefault(found.get(f, f), set()).add(k)
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(label))


def test_xxh64_of_all_lengths():
    data = bytes(random.Random(1).randrange(256) for _ in range(3000))
    size = np.arange(0, 140)
    start = np.arange(140) * 7
    assert simhash.xxh64(data, start, size).tolist() == [xxhash.xxh64(data[s : s + n], seed=42).intdigest() for s, n in zip(start.tolist(), size.tolist())]


# suffix-array dedup


def brute_removal(rows, depth=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - depth + 1) if d is not None else ():
            w = b[p : p + depth]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - depth + 1) if d is not None else ():
            if first[b[p : p + depth]] < d:
                hit[p : p + depth] = b"\1" * depth
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((d, len(b), sum(hit), len(re.findall(rb"\x01+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_suffix_dedup(docs, none, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    assert plain(suffix_dedup.repeats_removed(docs).collect()) == brute_removal([r[:2] for r in ROWS])
    assert suffix_dedup.repeats_removed(none).count() == 0


def test_suffix_dedup_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    r = random.Random(9)
    base = words(11, 300, 5000)
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randrange(8)):
            t[r.randrange(len(t))] = r.choice("xyz")
        rows.append((i * 3 % 61, "".join(t)))
    assert plain(suffix_dedup.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_removal(rows)


def test_what_stays_of_texts(docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert all(r.text and r.n_chars == len(r.text) for r in out.select("text", "n_chars").collect())


# passages


def test_repeated_passages_are_linked(docs, none):
    got = passages.near_duplicate_passages(docs).collect()
    linked = {(r.doc_id, r.other_id) for r in got}
    assert {(12, 11), (13, 11), (7, 6), (8, 6)} <= linked
    assert not {r.doc_id for r in got} & {0, 1, 2, 3, 4, 5, None}
    assert all(r.other_id < r.doc_id and r.similarity >= 0.8 and r.last_word - r.first_word >= 49 for r in got)
    assert {r.class_id for r in got if r.doc_id in (12, 13)} == {11}
    assert passages.near_duplicate_passages(none).count() == 0


def brute_pairs(texts):
    """(later, earlier) of texts that are one passage each, by the token sets of all pairs."""
    sets = []
    for t in texts:
        ws = t.split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)})
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_copies_of_a_text_that_is_not_the_first(spark):
    r, texts = random.Random(12), []
    for family in range(12):
        clean = words(100 + family, 50, 4000).split()
        for copy in range(20):
            t = list(clean)
            if copy != 6:
                t[r.randrange(50)] = f"edit{copy}"
            texts.append(" ".join(t))
    got = passages.near_duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    near = brute_pairs(texts)
    assert {(x.doc_id, x.other_id) for x in got} <= near
    later = {i for i, j in near if j % 20 == 6}
    assert len(later & {x.doc_id for x in got}) >= 0.9 * len(later)


def test_near_passages_with_and_without_other_owners(spark):
    """Passages of 50 to 60 words at a similarity of 0.8 to 0.9, also where forty earlier documents quote 12 words of them."""
    r, texts, pairs = random.Random(31), [], []
    quoted = [words(900 + k, 50 + k % 11, 5000).split() for k in range(60)]
    for k in range(40):
        text = words(2000 + k, 60, 5000).split()
        for q in quoted[:30]:
            a = r.randrange(len(q) - 12)
            text += q[a : a + 12] + words(3000 + 100 * k + len(text), 40, 5000).split()
        texts.append(" ".join(text))
    for k, q in enumerate(quoted):
        edited = list(q)
        edited[r.randrange(10, len(q) - 10)] = f"edit{k}"
        assert brute_pairs([" ".join(q), " ".join(edited)])
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join([words(5000 + 2 * k + i, 80, 5000), " ".join(t), words(7000 + 2 * k + i, 50, 5000)]) for i, t in enumerate((q, edited))]
    got = passages.near_duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(x.doc_id, x.other_id) for x in got}
    for some in (pairs[:30], pairs[30:]):
        assert sum((b, a) in found for a, b in some) >= 0.9 * len(some)
    assert not {d for pair in found for d in pair} & set(range(40))


def test_a_passage_of_which_others_own_the_signatures(spark):
    passage = words(51, 110, 5000).split()
    texts = [f"{words(60 + k, 70, 5000)} {' '.join(passage[2 * k : 2 * k + 12])} {words(160 + k, 70, 5000)}" for k in range(40)]
    rows = list(enumerate(texts)) + [(1000 + k, f"{words(260 + k, 60, 5000)} {' '.join(passage)}") for k in range(2)]
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.other_id) for x in got} == {(1001, 1000)}


def test_each_two_near_texts_are_linked(spark):
    """Edited copies of a passage, near each other or near a third only, beside whole copies: no near pair of different texts is left out."""
    r, texts = random.Random(77), []
    for family in range(6):
        clean = words(300 + family, 60 + 10 * family, 5000).split()
        for copy in range(36):
            t = list(clean)
            for _ in range(copy % 3):
                at = r.randrange(len(t))
                t[at : at + r.randrange(2)] = [f"edit{copy}x{family}"]
            texts.append(" ".join(t))
    texts += texts[40:50] * 3
    got = passages.near_duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    first = {}
    stands = [first.setdefault(t, i) for i, t in enumerate(texts)]
    need = {(i, j) for i, j in brute_pairs(texts) if stands[i] == i and stands[j] == j}
    found = {(x.doc_id, x.other_id) for x in got}
    assert len(need & found) >= 0.98 * len(need)
    assert {i for i, j in enumerate(stands) if i != j} <= {i for i, _ in found}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    cut = lambda d, a, z: {tuple(texts[d].split()[i : i + 5]) for i in range(a, z - 3)}
    for x in got:
        one, two = cut(x.doc_id, x.first_word, x.last_word), cut(x.other_id, x.other_first_word, x.other_last_word)
        assert one <= sets[x.doc_id] and two <= sets[x.other_id] and x.last_word - x.first_word >= 49
        assert x.similarity == pytest.approx(len(one & two) / len(one | two)) and x.similarity >= 0.8 - 1e-9


def test_parts_of_an_owner_with_many_texts(spark, monkeypatch):
    """Cells of two parts find what one cell finds."""
    clean, texts = words(401, 70, 5000).split(), []
    for copy in range(60):
        t = list(clean)
        t[(7 * copy) % 70] = f"edit{copy}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {(x.doc_id, x.other_id) for x in passages.passage_links(docs).collect()}
    monkeypatch.setattr(passages, "MEMBERS", 9)
    assert {(x.doc_id, x.other_id) for x in passages.passage_links(docs).collect()} == whole
    monkeypatch.setattr(passages, "FEW", 2)
    assert {(x.doc_id, x.other_id) for x in passages.passage_links(docs).collect()} == whole
    assert len(whole & brute_pairs(texts)) >= 0.98 * len(brute_pairs(texts))


def families():
    """Edited copies: near the owner of their signatures, near each other only, and whole copies of some."""
    r, texts = random.Random(78), []
    for family in range(4):
        clean = words(700 + family, 70, 5000).split()
        if family % 2:  # texts that own signatures of the passage and are near to none
            texts += [f"{words(720 + 10 * family + k, 60, 5000)} {' '.join(clean[14 * k : 14 * k + 14])} {words(820 + 10 * family + k, 60, 5000)}" for k in range(5)]
        for copy in range(40):
            t = list(clean)
            for _ in range(copy % 5):
                t[r.randrange(len(t))] = f"edit{copy}x{r.randrange(1000)}"
            texts.append(" ".join(t))
    return texts + texts[20:60] + [words(900 + k, 60, 5000) for k in range(10)] + ["", None]


@pytest.mark.parametrize("members", [256, 9])
def test_classes_are_those_of_all_links(spark, monkeypatch, members):
    texts = families()
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[3])], "doc_id long, text string")
    root = list(range(len(texts)))
    for x in passages.passage_links(docs).collect():
        a, b = root[x.doc_id], root[x.other_id]
        root = [min(a, b) if k in (a, b) else k for k in root]
    monkeypatch.setattr(passages, "MEMBERS", members)
    monkeypatch.setattr(passages, "FIRST", members)
    got = passages.passage_classes(docs).collect()
    assert sorted((x.doc_id, x.class_id) for x in got) == list(enumerate(root))
    assert {x.doc_id for x in got if x.linked} == {k for k, c in enumerate(root) if root.count(c) > 1}
    assert max(map(root.count, root)) >= 40


def test_classes_of_no_documents(none):
    assert passages.passage_classes(none).count() == 0


def test_links_that_join_grow_with_the_texts(spark, monkeypatch):
    """A family that no owner has joined yet: as many links as it takes, not those of all pairs."""
    clean, texts = words(401, 70, 5000).split(), []
    for copy in range(60):
        t = list(clean)
        t[(7 * copy) % 70] = f"edit{copy}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = passages._owner_links(docs).where("other_id IS NULL").select(*passages._names(passages._OPEN)).cache()
    own = runs.select("doc_id", "owner", "text", F.col("doc_id").alias("label"))
    all_links = passages.further_links(runs).collect()

    def joins(links):
        root, n = list(range(60)), 0
        for x in links:
            a, b = root[x.doc_id], root[x.other_id]
            n += a != b
            root = [min(a, b) if k in (a, b) else k for k in root]
        return n

    assert len(all_links) > 500 and joins(all_links) > 40
    for members in (256, 6):
        monkeypatch.setattr(passages, "MEMBERS", members)
        placed = runs.join(passages._bridges(own), ["doc_id", "owner", "text"]).withColumn("bucket", F.pmod(F.xxhash64("owner", "low", "high"), F.lit(100 * (members < 60) + 1)))
        links = placed.groupBy("bucket").applyInArrow(passages._joining_links, passages._JOIN).collect()
        assert joins(links) == joins(all_links) and len(links) <= (placed.count() if members < 60 else joins(all_links))
        assert all((x.label, x.other_label) == (x.doc_id, x.other_id) and x.similarity >= 0.8 - 1e-9 for x in links)


@pytest.mark.parametrize("few", [24, 1])
def test_links_do_not_depend_on_how_many_runs_a_signature_has(monkeypatch, few):
    """A run that is near as a whole only, beside one that overlaps it and is not near."""
    one = np.arange(13, 86, dtype=np.uint32)
    two = np.where(((one >= 40) & (one < 46)) | (one >= 68), one + 1000, one).astype(np.uint32)
    runs = np.array([[13, 22, 0], [23, 40, 10]], np.int32).tobytes()
    row = {"owner": 1, "keys": np.array([5, 6], np.uint64).tobytes(), "runs": runs, "kinds": np.full(2, -1, np.int64).tobytes(), "low": 0, "high": 0, "side": 0}
    table = pa.Table.from_pylist([row | {"doc_id": d, "text": d, "tokens": t.tobytes()} for d, t in ((7, one), (9, two))])
    monkeypatch.setattr(passages, "FEW", few)
    (got,) = passages._near_links(table).to_pylist()
    assert (got["doc_id"], got["other_id"], got["first_word"], got["last_word"]) == (9, 7, 13, 13 + 55 + 3)
    assert got["similarity"] == pytest.approx(49 / 61)


def test_near_starts_are_those_of_all_stretches():
    r, n = np.random.default_rng(8), passages.MIN_TOKENS
    for _ in range(20):
        a = r.choice(1 << 20, 90, replace=False).astype(np.uint32)
        b = np.concatenate([a[5:40], a[41:90], r.choice(np.arange(1 << 21, 1 << 22), 9, replace=False).astype(np.uint32)])
        b[r.integers(0, len(b), 3)] = r.choice(np.arange(1 << 23, 1 << 24), 3, replace=False)
        got = passages.near_starts(np.concatenate([a, b]), *(np.array([x]) for x in (0, 90, 90, len(b))))
        best = {i: max(len({*a[i : i + n].tolist()} & {*b[j : j + n].tolist()}) for j in range(len(b) - n + 1)) for i in range(90 - n + 1)}
        assert dict(zip(got[1].tolist(), got[3].tolist())) == {i: c for i, c in best.items() if c >= 0.8 * (2 * n - c)}


def test_matches_beside_repeated_lines_and_in_another_order():
    line, one, two = (words(k, n, 5000).split() for k, n in ((201, 6), (202, 200), (203, 100)))
    tokens = lambda *parts: passages.tokens_of([" ".join(sum(parts, [])).encode()])[0]
    held = lambda found: sum(j - i + 1 for _, i, j, _, _ in found)
    assert held(passages.matches(tokens(line * 5, one), passages.Other(tokens(line * 100, one)))) >= 196
    assert held(passages.matches(tokens(one, two), passages.Other(tokens(two, words(204, 300, 5000).split(), one)))) >= 196 + 96 - 4


def test_best_match_is_the_best_of_all_stretches():
    r = np.random.default_rng(5)
    for _ in range(50):
        a, b = r.integers(0, 30, 12).astype(np.uint64), r.integers(0, 30, r.integers(5, 60)).astype(np.uint64)
        n = min(len(a), len(b))
        of = lambda i: len({*a.tolist()} & {*b[i : i + n].tolist()}) / len({*a.tolist()} | {*b[i : i + n].tolist()})
        score, x, y = passages.best_match(a, b)
        assert score == max(map(of, range(len(b) - n + 1))) == of(x) and y == x + n - 1


def test_compact_windows_hold_each_stretch_once():
    r = np.random.default_rng(3)
    tokens, counts = r.integers(0, 2**63, 400, dtype=np.uint64), np.array([150, 10, 240])
    row, low, at, high, _ = passages.compact_windows(tokens, counts, 1)
    start = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        for i in range(start[k], start[k] + n - passages.MIN_TOKENS + 1):
            j = i + passages.MIN_TOKENS - 1
            assert ((row == k) & (low <= i) & (i <= at) & (at <= j) & (j <= high)).sum() == 1


# BPE and packing


def tokenizer(path):
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(path)


def noise(n, seed):
    r = random.Random(seed)
    al = "ab'stremvldLLOS  \n\t1²2é中😀ǅ—“.!?_ 　́<|>ΣςİIÅÀÝŸйЙ"
    return ["".join(r.choice(al) for _ in range(r.randrange(40))) for _ in range(n)] + ["<|endoftext|>A", "<|ENDOFTEXT|>", "a" * 300, " " * 60 + "a", "ab" * 900]


def test_bpe_equals_the_library(docs):
    t, texts = tokenizer(BYTE), noise(3000, 4) + [x or "" for x in TEXTS]
    v = bpe.load(BYTE)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    got = [x.tolist() for x in bpe.encode_batch(v, texts)]
    assert got == want
    assert [bpe.decode(v, np.array(i, np.int64)) for i in want] == [t.decode(i, skip_special_tokens=False) for i in want] == texts
    ids = [i for r in ROWS for i in [t.encode(r[1] or "", add_special_tokens=False).ids]]
    rows = sorted(((r[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, i in zip(ROWS, ids)), key=repr)
    assert plain(bpe.digests(docs, BYTE).collect()) == rows


def test_long_texts_are_cut_where_words_begin(monkeypatch):
    v = bpe.load(BYTE)
    whole = [x.tolist() for x in bpe.encode_batch(v, [LONG, "it's  a\n b <|endoftext|>" + LONG])]
    monkeypatch.setattr(bpe, "SLICE", 300)
    assert [x.tolist() for x in bpe.encode_batch(v, [LONG, "it's  a\n b <|endoftext|>" + LONG])] == whole


def test_packing(docs, none):
    t = tokenizer(WORD)
    texts = noise(2000, 6)
    assert [x.tolist() for x in packing.lower_ids(WORD, texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    got = packing.pack(docs, WORD, 256).collect()
    want = []
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0], k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256)]
    assert plain(tuple(r)[:5] for r in got) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(none, WORD).count() == 0


def test_plans_use_every_piece_and_are_near_the_bound():
    lengths = np.minimum(2048, np.random.default_rng(1).lognormal(6.3, 1.1, 20_000).astype(int) + 1)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    plan, used = packing.Plan(counts), {}
    for parts, times in plan.patterns:
        assert sum(parts) <= 2048
        for p in parts:
            used[p] = used.get(p, 0) + times
    assert used == counts
    assert sum(times for _, times in plan.patterns) <= 1.002 * -(-int(lengths.sum()) // 2048)


# chat


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", chat.CONTROL_TEXT), (1, 1, "assistant", "\\l<a>[b]\\\\e"), (2, 1, "assistant", None), (2, 0, None, "x"), (3, 5, "user", ""), (3, 5, "user", ""), (None, 0, "system", "s"), (4, 0, "odd<role>", "t"), (6, 0, "user", "u"), (6, 1, "end", "t"), (6, 2, ":user", "</s>"), (6, 3, ":", None), (6, 4, "assistant", "a"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a" * 50_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    out = chat.format_conversations(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.conv_id: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    for c in got:
        want = [(r or "", t or "") for k, _, r, t in sorted(turns, key=lambda x: (str(x[0]), x[1], x[2] or "", x[3] or "")) if k == c]
        assert [tuple(x) for x in got[c].back] == want
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: False, 5: True, 6: False}
    assert {c: r.bad_turn for c, r in got.items()} == {1: None, 2: 0, 3: 1, None: None, 4: 0, 5: None, 6: 1}
    assert [s.text for s in got[5].segments if s.loss] == ["a" * 50_000]
    assert "[INST]" not in got[1].formatted and "</s>" not in got[1].formatted
    assert chat.format_conversations(df.limit(0)).count() == 0


# URLs


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = ["http://A.Example.com/en/7?x=1", "https://b.example.com/en/8", "x.com/en/", None, "", "ftp://net/de/", "http://notnet.org/de/1", "http://example.net/de/8#a", "http://m.example.net/de/9", "http://org/es/", "http://éx.org/es", "http://h?q", "a://b://c/en/"]


def test_url_rules(spark):
    urls = URLS + ["http://example.com/" + "a" * 300_000, "http://www.example.net/de/" + "1" * 100_000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.train(df)).collect()}
    assert len(got) == 2 * len(urls)
    for i, u in enumerate(urls * 2):
        host, path, rule, verdict = brute_rule(u)
        assert got[i][:3] == (host, path, rule), u
        assert got[i][3] == verdict if rule else got[i][3] in ("allow", "block"), u
        assert got[i] == got[i % len(urls)]
    assert url_filter.judge(df.limit(0), url_filter.train(df.limit(0))).count() == 0


def labelled_urls(n, seed):
    """(url, bad): bad hosts have many hyphens and digits, good ones a short word; a tenth looks like the other kind."""
    r, out = random.Random(seed), []
    for i in range(n):
        bad = r.random() < 0.3
        looks = bad if r.random() < 0.9 else not bad
        host = f"{words(seed * n + i, 1)}-{words(i, 1)}-{r.randrange(9999)}" if looks else words(seed * n + 7 * i, 1)
        out.append((f"http://{host}.example.org/{'a' if looks else 'en'}/{r.randrange(99)}", int(bad)))
    return out


def test_trees_carry_labels_over_to_unseen_urls(spark):
    seen, unseen = (spark.createDataFrame(labelled_urls(n, seed), "url string, bad int") for n, seed in ((3000, 1), (1000, 2)))
    pages = seen.unionByName(unseen).select(F.monotonically_increasing_id().alias("page_id"), "url")
    model = url_filter.train(pages, seen)
    got = url_filter.judge(unseen.withColumn("page_id", F.col("bad").cast("long")), model, rules=()).collect()
    assert sum((r.verdict == "block") == (r.page_id == 1) for r in got) / len(got) > 0.85  # 0.9 is the best there is


def test_without_labels_the_rules_are_the_labels(spark):
    urls = [f"http://h{i % 7}.{'com/en' if i % 2 else 'net/de'}/{i}" for i in range(200)] + ["http://h3.other/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = url_filter.ruled_labels(pages)
    assert labels.count() == 200 and labels.agg(F.sum("bad")).first()[0] == 100
    assert url_filter.train(pages).trees.trees


def test_labels_do_not_leak_through_the_suffix(spark):
    """Every host has a suffix of its own and labels mean nothing: out of fold, no rate tells the label."""
    r = random.Random(4)
    rows = [(f"http://a.s{i}.x{i}/p", r.randrange(2)) for i in range(600)] + [(None, 1), ("no host", 1), ("http://q.r/", None)]
    labelled = spark.createDataFrame(rows, "url string, bad int")
    model = url_filter.train(labelled.select("url"), labelled)
    assert 9 not in {t[0] for t in model.trees.trees if isinstance(t, tuple)}


def test_trees_as_columns_score_like_the_trees(spark):
    x = np.random.default_rng(1).normal(size=(500, 2))
    model = url_filter.boost(x, (x[:, 0] * x[:, 1] > 0).astype(float))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    got = [r.s for r in df.select(model.column(("a", "b")).alias("s")).collect()]
    assert np.allclose(got, model.score(x)) and ((np.array(got) > 0) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_every_suffix_keeps_its_statistics(spark):
    urls = [(i, f"http://www.site{k}.com/a/{i}", int(k % 3 == 0)) for i, k in ((i, i % 150) for i in range(600))]
    pages = spark.createDataFrame(urls, "page_id long, url string, bad int")
    model = url_filter.train(pages, pages.select("url", "bad"), rows=40)
    assert model.suffixes.count() == model.n_suffixes == 150 and model.total == 600 and abs(model.prior - 1 / 3) < 1e-9
    got = model.with_features(url_filter.url_parts(pages, "page_id")).select("page_id", "suffix_rate", "suffix_share").collect()
    assert len(got) == 600
    assert all(np.isclose(r.suffix_share, 4 / 600) and np.isclose(r.suffix_rate, (4 * (r.page_id % 150 % 3 == 0) + 20 / 3) / 24) for r in got)
    assert url_filter.judge(pages, model).count() == 600


# sharding


def test_shards(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=60_000)
    odd = docs.withColumns({"_shard": F.lit("s"), "_group": F.lit(1), "_metadata": F.lit("m")})
    for part in odd.randomSplit([1.0, 1.0, 1.0], 1):
        store.append(part, rows=3)
    before, count = store.version(), store.manifest().count()
    first = plain(store.read().collect())
    while store.compact():
        pass
    assert store.manifest().count() < count
    assert plain(store.read().collect()) == plain(store.read(before).collect()) == first == plain(odd.collect())
    assert store.manifest().agg(F.sum("rows")).first()[0] == docs.count() == store.read(shard="at").where("at IS NOT NULL").count()
    with pytest.raises(sharding.CommitConflict):
        store.commit(store.manifest(), store.version())
    with pytest.raises(ValueError):
        store.read(shard="_SHARD")
    store.append(odd.withColumn("new", F.lit(2)).limit(4))
    assert store.read().where("new = 2").count() == 4 and store.read().count() == docs.count() + 4
    with pytest.raises(ValueError):
        store.append(odd.withColumn("lang", F.lit(2)))
    last = plain(store.read().collect())
    assert store.vacuum(keep=1) > 0 and store.versions() == [store.version()] and plain(store.read().collect()) == last


def test_shards_of_an_empty_table(spark, none, tmp_path):
    empty = sharding.ShardStore(spark, f"file://{tmp_path}/empty")
    assert empty.version() == 0 and empty.manifest().count() == 0 and empty.read().count() == 0 and not empty.compact()
    empty.append(none)
    assert empty.read().columns == none.columns and empty.read().count() == 0 and not empty.compact()
    none.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    assert sharding.op4_sharding(spark, f"file://{tmp_path}/sf").count() == 0


def test_every_document_stands_in_the_shard_that_the_query_names(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    got = sharding.op4_sharding(spark, f"file://{tmp_path}/sf").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    sizes = {(r.shard, r.shard_rows, r.shard_bytes, r.version) for r in got}
    assert len(sizes) == len({s[0] for s in sizes}) and sum(s[1] for s in sizes) == len(ROWS)
    assert all(sum(r.shard == s[0] for r in got) == s[1] for s in sizes)


def test_one_of_many_writers_commits(spark, docs, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = sharding.ShardStore(spark, f"file://{tmp_path}/race")
    store.append(docs)

    def attempt(_):
        try:
            store.commit(store.manifest(1), 2, store.schema(1))
            return True
        except sharding.CommitConflict:
            return False

    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(attempt, range(4))) == 1


# the pipeline


def brute_quality(text):
    n, chars, symbols, dup, rep = base_counts(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stop = sum(w in quality.STOP_WORDS for w in re.split(r"[\x20\x09-\x0D]", text or ""))
    return n >= 50 and 100 * rep <= 50 * n and 2 <= chars / n <= 15 and symbols / n <= 0.2 and stop / n >= 0.01 and (not lines or dup / len(lines) <= 0.6)


def brute_pipeline(rows):
    """doc_id and what stays of its text, stage by stage; doc_ids are unique."""
    kept = [(d, t) for d, t in rows if brute_quality(t)]
    first = {}
    for d, t in sorted(kept):
        first.setdefault(norm(t), d)
    kept = [(d, t) for d, t in kept if first[norm(t)] == d]
    label = brute_components([fingerprint(t) for _, t in kept])
    least = {}
    for (d, _), k in zip(kept, label):
        least[k] = min(least.get(k, d), d)
    kept = [(d, t) for (d, t), k in zip(kept, label) if least[k] == d]
    grams, out = {}, {}
    for d, t in sorted(kept):
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if grams.setdefault(b[p : p + 50], d) != d:
                hit[p : p + 50] = True
        if stays := bytes(np.frombuffer(b, np.uint8)[~hit]).decode("utf-8", "ignore"):
            out[d] = stays
    return out


def prose(seed, n):
    ws = words(seed, n, 3000).split()
    return " ".join(w if i % 9 else "the" for i, w in enumerate(ws))


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as C

    shared = prose(77, 70)
    texts = [prose(k, 90 + 7 * k) for k in range(24)] + [None, "", " \n", "x" * 3000, "same line of the text\n" * 40, "# * $ % & | < > " * 30]
    texts += [texts[3], texts[3].replace(" ", "\n\t"), texts[5] + " éé", texts[6].replace(" the ", " a ", 1)]
    texts += [f"{prose(100 + k, 80)} {shared} {prose(200 + k, 60 + k)}" for k in range(5)] + [prose(300, 20_000)]
    rows = list(zip(random.Random(3).sample(range(1000), len(texts)), texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text"), "_row": F.lit(1), "_keep": F.lit("k"), "fp": F.lit(2), "block": F.lit(None).cast("int")})
    df.repartition(3).write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    want = brute_pipeline(rows)
    docs = spark.read.parquet(f"file://{tmp_path}/sf/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, ""), "test")
        assert docs.columns == df.columns
    assert {r.doc_id: r.text for r in docs.collect()} == want
    tok, pieces = tokenizer(WORD), C.run(spark, f"file://{tmp_path}/sf").collect()
    length, at = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == length.get(r.doc_id, 0)
        length[r.doc_id] = r.start + r.length
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert length == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()} and max(at.values()) <= 2048


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline as C

    none.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    assert C.run(spark, f"file://{tmp_path}/sf").count() == 0


def test_a_dead_writer_stops_no_one(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/dead", target_bytes=60_000)
    store.append(spark.range(10).select(F.col("id").alias("a")))
    (tmp_path / "dead/versions/v00000002").write_text("")  # died before it wrote what the version is
    (tmp_path / "dead/versions/_draft-1").write_text("{")
    assert store.version() == 1 and store.append(spark.range(10, 13).select(F.col("id").alias("a"))) == 2
    with pytest.raises(sharding.CommitConflict):
        store.commit(store.manifest(), 2)
    assert sorted(r.a for r in store.read().collect()) == list(range(13)) and sorted(r.a for r in store.read(1).collect()) == list(range(10))


def test_names_that_differ_by_case_are_one_column(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/case")
    store.append(spark.createDataFrame([(1, "x")], "A long, text string"))
    store.append(spark.createDataFrame([(2, "y", 5)], "a long, TEXT string, New int"))
    assert store.read().columns == ["A", "text", "New"] and plain(store.read().collect()) == plain([(1, "x", None), (2, "y", 5)])
    for bad in ("a string", "b int, B int"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], bad))
    assert store.version() == 2


def test_appends_between_compactions_and_what_vacuum_leaves(spark, tmp_path):
    root = tmp_path / "many"
    store = sharding.ShardStore(spark, f"file://{root}", target_bytes=4_000)
    for k in range(4):
        store.append(spark.range(k * 50, k * 50 + 50).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(3), rows=5)
        while store.compact():
            pass
    assert sorted(r.id for r in store.read().collect()) == list(range(200))
    (root / "data/c99-orphan").mkdir()
    (root / "data/c99-orphan/part-0").write_text("left by a failed attempt")
    assert store.vacuum() > 0 and (root / "data/c99-orphan").exists()
    store.vacuum(keep=1, grace_hours=-1)
    live = {r.shard.rsplit("/", 1)[1] for r in store.manifest().collect()}
    assert {f.name for f in root.glob("data/*/*.parquet")} == live
    assert len(store.versions()) == len(list((root / "manifests").iterdir())) == 1 and not (root / "data/c99-orphan").exists()
    assert sorted(r.id for r in store.read().collect()) == list(range(200))


def test_one_round_merges_a_bounded_number_of_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ROUND_SHARDS", 5)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/rounds", target_bytes=3_000)
    store.append(spark.range(200).select("id").repartition(4), rows=10)
    n, rounds = store.manifest().count(), 0
    while store.compact():
        rounds += 1
    assert rounds > 1 and store.manifest().count() < n and store.read().count() == 200
