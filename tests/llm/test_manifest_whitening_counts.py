"""The Merkle manifest, the whitening and the token counts against brute force: nulls, ties, repeats, empty tables, odd columns."""

import hashlib
import json
import os
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle, token_counts, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def way(tree, k):
    out = []
    for nodes in tree[:-1]:
        b = k - k % 3
        out.append(("".join(nodes[b:k]), "".join(nodes[k + 1 : b + 3])))
        k //= 3
    return out


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    trees = {s: levels([x[2] for x in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for k, (_, _, own, r) in enumerate(groups[s]):
            sides = way(trees[s], k) + way(top, names.index(s))
            node = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                node = leaf(r, r["text"].replace("\n", ""))
            for left, right in sides:
                node = sha(left + node + right)
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in sides)), node, node == top[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, digest string"


def manifest_rows(n):
    r = random.Random(n)
    texts = [None, "", "\n", "a\nb", "Ünï\n中文😀", "x" * 5000 + "\n"]
    sources = [None, "", "hot", "hot", "é", "Z", *(f"s{k}" for k in range(n // 40))]
    out = [(r.choice([None, *range(n)]), r.choice(texts), r.choice([None, "en"]), r.choice(sources), r.choice([None, 3]), "t", 1, "d") for _ in range(n)]
    return out + out[: n // 3]


def tampered():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))


@pytest.mark.parametrize("n", [1, 2, 27, 400])
def test_manifest(spark, n):
    rows = manifest_rows(n)
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_manifest([dict(zip(docs.columns, r)) for r in rows])
    assert plain(merkle.proofs(merkle.document_leaves(docs, tampered()), "doc_id").collect()) == want


def test_manifest_of_one_large_group(spark):
    docs = spark.range(6561).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    got = merkle.proofs(merkle.document_leaves(docs, tampered()), "doc_id").collect()
    assert plain(got) == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.proofs(merkle.document_leaves(none, tampered()), "doc_id").collect() == []


def test_mountains_cover_a_run_wherever_it_begins():
    leaves = [str(k) for k in range(400)]
    tree = levels(leaves)
    r = random.Random(5)
    for start, end in [(0, 81), (0, 82), (80, 83), (1, 243), *((lambda a: (a, r.randrange(a + 1, 400)))(r.randrange(399)) for _ in range(50))]:
        m, seen, at = merkle.Mountains(start), [], start
        while at < end:
            step = r.randrange(1, 60)
            seen += m.push(leaves[at : min(end, at + step)])
            at += step
        seen += m.peaks()
        covered = sorted(k for level, place, _, open_ in seen if open_ for k in range(place * 3**level, (place + 1) * 3**level))
        assert covered == list(range(start, end))
        # where the whole tree has a node over fewer leaves, at its right end, a run cannot know it yet
        assert all(tree[level][place] == node for level, place, node, _ in seen)


# whitening


def brute_whitening(rows, keep=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    y = (x - np.array([int(t) / n for t in s], object)).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    return n, [int(((n * r - s) ** 2).sum()) for r in x], y @ u / np.sqrt(e), e / np.trace(v)


VECTORS = "vec_id long, embedding array<float>, label int, v int, parts int, i string"


def test_whitening(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 40)) @ np.diag(np.logspace(1, -1, 40)) + r.normal(size=40) * 5
    good = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)] + [(None, base[0].astype(np.float32).tolist())] * 3 + [(7, base[1].astype(np.float32).tolist())] * 200
    bad = [(1000, None), (1001, [None] * 40), (1002, [float("nan")] * 40), (1003, [float("inf")] + [0.0] * 39), (1004, [1.0] * 39), (1005, [])]
    table = spark.createDataFrame([(k, v, 1, 2, 3, "x") for k, v in good + bad], VECTORS).repartition(5)
    got = whitening.whitened(table).toPandas()
    n, deviation, z, explained = brute_whitening(good)
    assert set(got.n) == {n} and len(got) == n * 32 and sorted(got.component.unique()) == list(range(1, 33))
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, explained, rtol=1e-6)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    first = got[got.vec_id == 9].sort_values("component").whitened.to_numpy()
    assert np.allclose(np.abs(first), np.abs(z[9]), atol=1e-7)


def test_whitening_of_vectors_without_spread(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0, "")], VECTORS)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    flat = whitening.whitened(spark.createDataFrame([(k, [float(k), 5.0, float(-k)], 0, 0, 0, "") for k in range(9)], VECTORS)).collect()
    assert {r.component for r in flat if r.whitened is None} == {2, 3} and max(r.identity_error for r in flat) < 1e-12
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 0, 0, 0, "")], VECTORS)).collect() == []


def test_sums_are_exact_for_entries_out_of_proportion(spark):
    rows = [(k, [float(2**50 * (k % 3)), 1.0 + k, -3.5 * (k % 2)], 0, 0, 0, "") for k in range(30)]
    _, fitted = whitening.fit(spark.createDataFrame(rows, VECTORS).repartition(4))
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v, *_ in rows]
    assert fitted.sums == [sum(c) for c in zip(*x)]
    assert whitening._whole([p for k in whitening._limbs([-(2**120), 5, 2**99 + 1]) for p in k]) == [-(2**120), 5, 2**99 + 1]


@pytest.mark.parametrize("dims", [1, 2, 3, 17, 64])
def test_jacobi_finds_small_eigenvalues(dims):
    r = np.random.default_rng(dims)
    scale = np.logspace(0, -7, dims)
    corr = r.normal(size=(dims, 4 * dims))
    corr = corr @ corr.T / (4 * dims)
    matrix = scale[:, None] * corr * scale  # graded: small eigenvalues are well determined, but not to a solver that looks at the norm
    value, vector = whitening.jacobi(matrix)
    inverse = np.linalg.inv(corr) / scale[:, None] / scale
    assert np.all(np.diff(value) <= 0) and np.isclose(1 / value[-1], np.linalg.eigvalsh(inverse)[-1], rtol=1e-9)
    assert np.allclose(vector.T @ vector, np.eye(dims), atol=1e-12) and np.allclose(vector * value @ vector.T, matrix, atol=1e-14)


def test_rounds_pair_each_with_each_once():
    for dims in range(1, 12):
        pairs = [tuple(p) for one in whitening.rounds(dims) for p in one] if dims > 1 else []
        assert sorted(pairs) == [(a, b) for a in range(dims) for b in range(a + 1, dims)]
        assert all(len(set(one.ravel())) == one.size for one in whitening.rounds(dims)) if dims > 1 else True


# token counts


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def hard_texts():
    r = random.Random(8)
    marks = [*"aab'st reve \n\té中ß́İKΣς.-_#1😀", "<|endoftext|>", "<|startoftext|>", "'ll"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = ["".join(r.choice(marks) for _ in range(r.randrange(60))) for _ in range(400)]
    out += ["", " ", "x" * 20_000, "a" * 4097, "ab" * 3000, "".join(r.choices(letters, k=3000)), "".join(r.choices(letters, k=5000)), "中" * 3000, "aaa " * 700]
    return out + ["word " * 1_000_000]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_are_the_librarys(path):
    texts, t = hard_texts(), library(path)
    assert token_counts.Counter(path).counts(texts).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_ranks_out_of_order(tmp_path):
    """A vocabulary whose products may merge before further occurrences of their own pair."""
    from quillspark.llm import bpe

    alphabet = [*bpe.byte_letters().values()]
    merges = [("ab", "a"), ("b", "ab"), ("a", "b"), ("a", "a"), ("aa", "b"), ("aba", "b")]
    made = [a + b for a, b in merges]
    vocab = {c: k for k, c in enumerate([*alphabet, *(c + "</w>" for c in alphabet), *dict.fromkeys(made)])}
    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= {"vocab": vocab, "merges": [" ".join(m) for m in merges]}
    spec["added_tokens"] = []
    path = str(tmp_path / "odd.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    counter, t, r = token_counts.Counter(path), library(path), random.Random(2)
    assert counter.impatient.any()
    texts = ["".join(r.choice("aabc") for _ in range(r.randrange(1, 40))) for _ in range(800)]
    assert counter.counts(texts).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_counts_of_rows(spark):
    texts = [None, "", "one two", "Ü" * 10, "word " * 3000, "one two"]
    docs = spark.createDataFrame([(k if k != 1 else None, x, 1, "z") for k, x in enumerate(texts)], "doc_id long, text string, n_tokens int, words string").repartition(2)
    t = library(WORD)
    want = [(k if k != 1 else None, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in enumerate(texts)]
    got = token_counts.token_counts(docs, WORD)
    assert plain(got.collect()) == plain((*w, w[2] > 2048) for w in want)
    assert token_counts.token_counts(docs.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        token_counts.Counter("piece.model")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_on_the_tables(spark):
    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    t = library(WORD)
    got = token_counts.op13_token_counts(spark, SF).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens) for r in got] == [(len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for x in docs]
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, z, explained = brute_whitening([(r.vec_id, r.embedding) for r in table])
    white = whitening.op12_whitening(spark, SF).toPandas().set_index(["vec_id", "component"]).sort_index()
    assert len(white) == n * 32 and white.identity_error.max() < 1e-9
    assert np.allclose(white.explained.to_numpy().reshape(-1, 32)[0], explained, rtol=1e-9)
    one = SimpleNamespace(id=table[3].vec_id)
    assert np.allclose(np.abs(white.loc[one.id].whitened.to_numpy()), np.abs(z[3]), atol=1e-6) and white.loc[one.id].deviation.iloc[0] == deviation[3]
