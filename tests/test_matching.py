"""Containment by runs of characters, window bounds and citation statuses against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import udf
from quillspark.functions.udf import WIDTHS, near_ratios, window_bounds, window_ratio
from quillspark.operators import joins as J
from quillspark.operators.qgrams import contained


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def strings(seed, n, most):
    r = random.Random(seed)
    return ["".join(r.choice("ab é中😀\n.*") for _ in range(r.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("hot", [100_000, 0])
def test_contained_is_every_pair(spark, hot):
    needles, hays = strings(1, 120, 5) + strings(2, 40, 14) + [None, "not there at all"], strings(3, 150, 60) + [None, ""]
    needles += [h[3:20] for h in hays if h and len(h) > 25] + needles[:5]
    a = spark.createDataFrame(list(enumerate(needles)), "n long, needle string").repartition(3)
    b = spark.createDataFrame(list(enumerate(hays)), "h long, hay string").repartition(3)
    got = [tuple(r) for r in contained(a, "n", "needle", b, "h", "hay", hot=hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, x in enumerate(needles) if x for j, y in enumerate(hays) if y and x in y}
    assert contained(a.limit(0), "n", "needle", b, "h", "hay").columns == ["n", "h"] and contained(a, "n", "needle", b.limit(0), "h", "hay").count() == 0


def test_quotes_of_any_length_are_found_without_a_nested_loop(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choice(["river", "bank", "old", "town", "a", "of", "é"]) for _ in range(r.randrange(40))) for _ in range(60)]
    quotes = [t[a : a + r.randrange(1, 80)] for t in texts for a in [r.randrange(40)]] + ["", "ver ba", "nothing of this kind is there"]
    q = spark.createDataFrame(list(enumerate(quotes)), "q int, quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    want = {(i, j) for i, x in enumerate(quotes) if x for j, y in enumerate(texts) if x in y}
    for small in (J.small, lambda df: df):
        monkeypatch.setattr(J, "small", small)
        found = J.containment(q, t, "q", "quote", "t", "text")
        assert {tuple(x) for x in found.collect()} == want
        assert not any("NestedLoop" in p or "Cartesian" in p for p in plan_of(found))


def test_gazetteer_of_any_size_without_a_nested_loop(spark):
    r = random.Random(6)
    entries = ["".join(r.choice("abcde ") for _ in range(r.randrange(1, 9))) for _ in range(400)] + ["", None]
    names = ["".join(r.choice("abcde ") for _ in range(r.randrange(12))) for _ in range(300)] + entries[:20] + [None]
    gaz = spark.createDataFrame([(r.randrange(10**6), e) for e in entries], "ord int, entry string")
    order = {}
    for x in gaz.collect():
        order[x.entry] = min(x.ord, order.get(x.entry, x.ord))
    want = {}
    for n in set(names):
        near = [e for e in order if n and e and (e in n or n in e)]
        want[n] = (n, "exact") if n is not None and n in order else (min(near, key=order.get), "substring") if near else (None, "missing")
    found = J.gazetteer_match(spark.createDataFrame([(n,) for n in names], "name string"), gaz)
    assert {x.name: (x.entry, x.how) for x in found.collect()} == want
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plan_of(found))


def all_windows(quote, text):
    n = len(quote)
    for w in sorted({int(n * s) for s in WIDTHS}):
        for a in range(0, max(len(text) - w, 0) + 1, max(1, n // 5)):
            yield a, min(a + w, len(text))


@pytest.mark.parametrize("most", [20, 70, 200])
def test_no_window_is_above_its_bound(most):
    r = random.Random(most)
    for _ in range(40):
        quote, text = ("".join(r.choice("abcdé😀 ") for _ in range(n)) for n in (r.randrange(4, most), r.randrange(1, 300)))
        bound, start, end = window_bounds(quote, text)
        assert sorted(zip(start.tolist(), end.tolist())) == sorted(all_windows(quote, text))
        ratios = [difflib.SequenceMatcher(None, quote, text[a:b]).ratio() for a, b in zip(start, end)]
        assert all(x <= b + 1e-12 for x, b in zip(ratios, bound))
        best = 1.0 if quote in text else max(ratios)
        assert window_ratio(quote, text) == best
        for floor in (0.4, 0.72):
            assert window_ratio(quote, text, floor) == (best if best >= floor else None)


def test_seven_statuses(spark):
    pages = spark.createDataFrame([(1, "We left the old town by the river before noon, with heavy bags and little hope."), (2, None)], "page int, text string")
    cases = {
        "found": ("1", "OLD-TOWN by the", "n"), "approximate": ("1", "the old towns by a river befor noon", "n"), "citation_mismatch": ("1", "zzzz yyyy xxxx", "n"), "missing_page": ("9", "x", "n"),
        "invalid_page": ("no", "x", "n"), "empty_quote": ("1", "!?", "n"),
    }
    blank = [(None, "x", "n"), ("", "x", "n"), ("1", " 　", "n"), ("1", None, "n"), ("1", "old town", " "), ("1", "old town", None)]
    refs = spark.createDataFrame([(s, *c) for s, c in cases.items()] + [("missing_ref_field", *b) for b in blank], "want string, page string, quote string, note string")
    for scores in (True, False):
        got = J.quote_status(refs, pages, note="note", scores=scores).select("want", "status", "score").collect()
        assert all(r.want == r.status for r in got) and len(got) == 12
        assert all((r.score is None) == (not scores and r.status == "citation_mismatch") for r in got)


def test_claims_of_all_fields_that_the_evidence_lacks(spark):
    from quillspark.operators import evidence as E

    fields = {f: None for f in E.AUDITED_FIELDS} | {
        "route_summary": "从健德门出发；到Ｏｌｄ Town；⑫。全程88公里",
        "walking_directions": ["左转沿无名路走过去", None, "书中未明示"],
        "terrain": "平坦开阔的大片农田与果园相间分布",
        "lodging": "the note carries this one",
    }
    kinds = ", ".join(f"{f} array<string>" if f == "walking_directions" else f"{f} string" for f in E.AUDITED_FIELDS)
    segments = spark.createDataFrame([(1, ["old town", None, ""], *fields.values()), (2, [], *fields.values())], f"seg int, names array<string>, {kinds}")
    pages = spark.createDataFrame([(3, "从健德门出发的早晨，全程８８公里"), (4, "something else")], "page int, text string")
    refs = spark.createDataFrame([(1, 0, "3", "the old town", None), (1, 1, "4", None, "a NOTE carries: THE note carries this one"), (1, 2, "x", "左转沿无名路走过去", "")], "seg int, ord int, page string, quote string, note string")
    got = E.unsupported_claims(segments, refs, pages, "seg", "ord", E.named_places(F.col("names"))).collect()
    one = {(r.field, r.claim): (sorted(r.anchors), sorted(r.lacking), r.pages) for r in got if r.seg == 1}
    # ⑫ is no number, and such short claims without anchors pass; the reference without a page gives no evidence
    assert one == {("terrain", "平坦开阔的大片农田与果园相间分布"): ([], [], "3,4")}
    two = {r.claim: (r.support, r.pages) for r in got if r.seg == 2}
    assert set(two) == {"从健德门出发", "全程88公里", "平坦开阔的大片农田与果园相间分布", "the note carries this one"} and all(v == ("none", "") for v in two.values())


def test_claims_are_dealt_out_before_they_are_compared(spark):
    from quillspark.operators import evidence as E

    segments = spark.createDataFrame([(1, *E.AUDITED_FIELDS)], "seg int, " + ", ".join(f"{f} string" for f in E.AUDITED_FIELDS))
    pages = spark.createDataFrame([(7, "nothing")], "page int, text string")
    refs = spark.createDataFrame([(1, 0, "7", "q", "n")], "seg int, ord int, page string, quote string, note string")
    logical, physical = plan_of(E.unsupported_claims(segments, refs, pages, "seg", "ord", E.named_places(F.array(F.lit("a")))))
    # from the top down: a filter on the outcome must not take the comparison below the exchange
    assert physical.count("near_window_ratio") == 1 and 0 < physical.index("near_window_ratio") < physical.index("REPARTITION_BY_NUM")
    # keys of keywords are values by then, not worked out for each claim
    assert "[健德门,健德门]" in logical


def test_circled_numbers_are_no_anchors(spark):
    from quillspark.operators import evidence as E

    claims = spark.createDataFrame([(1, "⑫ bags of rice and flour"), (1, "１２ bags of rice and flour"), (1, "ﬁne place to stay")], "seg int, claim string")
    pages = spark.createDataFrame([(7, "nothing")], "page int, text string")
    refs = spark.createDataFrame([(1, 7)], "seg int, page int")
    got = {r.claim: list(r.anchors) for r in E.audited_claims(claims, E.evidence_text(refs, pages, "seg", "page", "text"), "seg", ("fine",)).collect()}
    assert got == {"⑫ bags of rice and flour": [], "１２ bags of rice and flour": ["１２"], "ﬁne place to stay": ["fine"]}


def test_form_feeds_end_lines(spark):
    from quillspark.functions import text as T

    row = spark.createDataFrame([("a\f12\fb ||\x85c\xa0 d​\x0b 3 ",)], "t string").select(T.clean_ocr_text(F.col("t")).alias("t")).first()
    assert row.t == "a\nb\nc d"


def test_near_ratios_are_those_of_one_pair_at_a_time():
    rng, pairs = random.Random(5), [("", "abc", 0.5), (None, "abc", 0.5), ("abc", "xabcx", 0.5)]
    for _ in range(150):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz", "山河城abc"])
        some = lambda sizes: "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        quote, text = some([1, 3, 20, 70, 170, 300]), some([1, 30, 150, 500])
        at = rng.randrange(len(text))
        pairs.append((quote, text[:at] + rng.choice(["", quote[len(quote) // 4 :]]) + text[at:], rng.choice([0.42, 0.45, 0.72, 0.9])))
    want = [window_ratio(q, t, floor, True) if q and t else None for q, t, floor in pairs]
    assert near_ratios(pairs) == want
    assert 20 < sum(x is None for x in want) < 130


@pytest.mark.parametrize("most", [1 << 26, 1 << 16, 1])
def test_blocks_from_a_table_of_runs_are_those_of_difflib(monkeypatch, most):
    monkeypatch.setattr(udf, "_TABLE", most)  # no table at all is the way before
    rng, pairs = random.Random(8), []
    for n in [4, 11, 62, 63, 64, 90, 126, 127, 140, 200, 264] * 4:
        letters = rng.choice(["ab", "abcdefgh", "etaoinshrdlu"])
        quote = "".join(rng.choice(letters) for _ in range(n))
        text = "".join(rng.choice(letters + "é") for _ in range(rng.choice([1, 40, 300])))
        pairs.append((quote, text + quote[n // 3 : n // 3 * 2] + text[: n // 2] + quote[: n // 4], rng.choice([0.3, 0.45, 0.6, 0.8])))
    assert near_ratios(pairs) == [window_ratio(q, t, floor, True) for q, t, floor in pairs]


def test_most_windows_are_told_without_their_own_table(monkeypatch):
    """Comparing each window by itself grows with the square of the quote: short windows are looked up, and of long ones those that
    have too few rare characters are given up."""
    compared, whole = [], udf._longest
    monkeypatch.setattr(udf, "_longest", lambda a, sizes, *x: compared.append(len(sizes)) or whole(a, sizes, *x))
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    pairs = [(some(n), some(480), 0.45) for n in (20, 60, 120, 240) for _ in range(8)]
    assert near_ratios(pairs) == [window_ratio(q, t, floor, True) for q, t, floor in pairs]
    assert sum(compared) == 0
