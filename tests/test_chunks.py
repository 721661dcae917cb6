"""Chunks across pages against a plain loop, with books cut into many runs."""

import random

import pytest

from quillspark.operators import chunks as C

SCHEMA = "book string, page long, parts array<string>"


def by_loop(rows, budget, gap):
    """(book, chunk, first_page, last_page, text), part by part."""
    out = []
    for book in {r[0] for r in rows}:
        done, open_ = [], []
        size = lambda: sum(map(len, (p for _, p in open_))) + gap * (len(open_) - 1)
        for _, page, parts in sorted((r for r in rows if r[0] == book and r[1] is not None), key=lambda r: r[1]):
            for p in filter(None, parts or []):
                if open_ and (len(p) > budget or size() + gap + len(p) > budget):
                    done.append(open_)
                    open_ = []
                if len(p) > budget:
                    done += [[(page, p[i : i + budget])] for i in range(0, len(p), budget)]
                else:
                    open_ = [*open_, (page, p)]
        done += [open_] if open_ else []
        out += [(book, i, c[0][0], c[-1][0], ("\n" * gap).join(p for _, p in c)) for i, c in enumerate(done, 1)]
    return sorted(out, key=repr)


@pytest.fixture
def many_runs(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "11"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("budget, gap, longest", [(10, 2, 6), (10, 2, 25), (30, 0, 9), (5, 1, 5)])
def test_chunks_equal_the_loop(spark, many_runs, budget, gap, longest):
    rng = random.Random(budget * longest)
    word = lambda: "".join(rng.choices("abcdé中", k=rng.randint(0, longest)))
    rows = [("hot", i * 3, [word() for _ in range(rng.randint(0, 7))]) for i in range(150)]
    rows += [(b, i, [word() for _ in range(rng.randint(0, 3))]) for b in ("b", "c", None) for i in range(4)]
    rows += [("empty", 1, []), ("empty", 2, None), ("empty", 3, ["", None]), ("late", None, ["x"]), ("one", 7, ["x" * budget])]
    rng.shuffle(rows)
    got = C.pages_chunked(spark.createDataFrame(rows, SCHEMA), budget, gap).collect()
    assert sorted(((r.book, r.chunk, r.first_page, r.last_page, r.text) for r in got), key=repr) == by_loop(rows, budget, gap)
    assert len({r.chunk for r in got if r.book == "hot"}) > 30


def test_no_pages_give_no_chunks(spark, many_runs):
    assert C.pages_chunked(spark.createDataFrame([], SCHEMA), 10).count() == 0
    assert C.pages_chunked(spark.createDataFrame([("a", 1, [])], SCHEMA), 10).count() == 0


def test_a_run_is_a_function_of_how_full_the_chunk_is():
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(60):
        sizes = [[rng.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 6))]
        run = C.Run(pa.table({"page": list(range(len(sizes))), "sizes": pa.array(sizes, pa.list_(pa.int32()))}), 13, 2)
        f = run.function()
        for filled in range(14):
            n, begun = filled, 0
            for s in (x for xs in sizes for x in xs):
                if s > 13:
                    n, begun = 0, begun + -(-s // 13)
                elif n and n + 2 + s <= 13:
                    n += 2 + s
                else:
                    n, begun = s, begun + 1
            assert C._after(f, filled) == (n, begun), (sizes, filled)
