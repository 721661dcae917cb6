"""Evidence resolution against a plain loop over segments, on random rules."""

import copy
import random
import re
import unicodedata

from quillspark.operators import resolution as R


def key(t):
    t = re.sub(r"\s+", "", unicodedata.normalize("NFKC", t or "").lower())
    return re.sub(r"[`~!@#$%^&*_+=|\\/<>{}\[\]（）()【】《》“”\"'‘’：:；;，,。.!！?？、-]", "", t)


def short(t, n):
    t = re.sub(r"\s+", " ", t or "").strip()
    return t if len(t) <= n else t[: n - 1] + "…"


def put(items, x):
    if x not in items:
        items.append(x)


def said(ref, pages):
    try:
        page = int(ref[0])
    except (TypeError, ValueError):
        return "invalid page"
    return "found" if key(ref[1]) and key(ref[1]) in key(pages.get(page)) else "quote not found in OCR page"


def grow(refs, new, pages):
    told, added = [], []
    for r in new:
        told.append(f"p{r[0] or ''}:{said(r, pages)}")
        if told[-1].endswith(":found") and not any(x[0] == r[0] and key(x[1]) == key(r[1]) for x in refs):
            refs.append(list(r))
            added.append(f"p{r[0]} {r[1]}")
    return told, added


def loop(segments, rules, cleanups, pages):
    out = {}
    for sid, title, fields, book, chapters, review, evidence, status in copy.deepcopy(segments):
        book, chapters, review, evidence = book or [], chapters or [], review or [], evidence or []
        is_title = lambda r: "标题" in (r[2] or "") or "章节" in (r[2] or "") or bool((title or "").strip()) and key(r[1]) == key(title)
        titled = [r for r in book if is_title(r)]
        refs = [list(r) for r in book if not is_title(r)]
        for r in titled:
            put(chapters, (r[0], r[1], "章节或段落标题来源"))
        if titled:
            put(evidence, f"已将 {len(titled)} 条章节/路线标题引用移入 chapter_refs，book_refs 仅保留路线事实证据。")
        log = []
        for _, _, field, claim, action, value, note, new in sorted((r for r in rules if r[0] == sid), key=lambda r: r[1]):
            before = fields.get(field)
            if action is None:
                action, note = "cleared_to_unspecified", "未配置补充证据，按保守规则降级。"
                value = "书中未明示" if field in R.FACT_FIELDS else before
            told, added = grow(refs, new or [], pages)
            valid = all(t.endswith(":found") for t in told)
            fields[field] = value
            kept = action == "supported_with_new_book_ref" and valid
            if not kept:
                middle = " 原内容含无法由本段 book_refs 支撑的信息；原内容：" if action == "rewritten_without_unsupported_part" else " 原内容："
                put(review, f"证据不足，待人工复核：{field}{middle}{short(before, 180)}")
            status = "warning"
            put(evidence, f"{field}: {action}; {note or '已按书中证据清理。'}")
            if not valid:
                put(evidence, f"{field}: 补充引文未全部通过页内校验，已保守处理。")
            log.append((field, claim, action, short(before, 220), short(value, 220), " | ".join(added), "no" if kept else "yes", " | ".join(told) or "无新增引文", note or ""))
        done = None
        for _, more, new, updates, note in (c for c in cleanups if c[0] == sid):
            told, added = grow(refs, new or [], pages)
            updated = []
            for page, old, fresh in updates or []:
                for r in refs:
                    if r[0] == page and key(old) and key(r[1]) == key(old):
                        r[1] = fresh
                        updated.append(f"p{page} quote updated")
            for f, v in sorted((more or {}).items()):
                fields[f] = v
                put(evidence, f"{f}: 标题引用移出后补充正文证据并收紧表达。")
            if note:
                put(review, note)
            for u in updated:
                put(evidence, u)
            if more or added or updated:
                status, done = "warning", (", ".join(sorted(more or {})) or "book_refs", " | ".join(added + updated), " | ".join(told) or "无新增引文", note or "")
        if not refs:
            status = "fail"
            put(evidence, "该段只有 chapter_refs 或缺少路线事实 book_refs。")
        out[sid] = (fields, [tuple(r) for r in refs], chapters, review, evidence, status or ("warning" if chapters else "pass"), len(titled), log, done)
    return out


def test_resolution_equals_the_loop(spark):
    r = random.Random(12)
    pages = {p: " ".join(r.choice(["Ａlpha", "beta,", "gamma", "delta", "标题"]) for _ in range(12)) for p in range(1, 8)}
    quote = lambda: r.choice(["alpha BETA", "beta gamma", "delta", "nowhere", "", None, "Alpha—beta", "gamma delta gamma"])
    ref = lambda: (r.choice(["1", "2", "3", "7", "99", "x", None]), quote(), r.choice(["n", "章节", None, ""]))
    names = ["resupply", "terrain", "lodging"]
    some = lambda f, n: r.choice([None, [f() for _ in range(r.randrange(n))]])
    segments = [(f"s{i}", r.choice(["Delta", "", None, "other"]), {n: r.choice([None, "text  of\nit", "x" * 300]) for n in names[: r.randrange(1, 4)]}, some(ref, 5), some(ref, 3), r.choice([None, ["a"]]), r.choice([None, ["b"]]), r.choice([None, "pass"])) for i in range(60)]
    rules = [(f"s{r.randrange(64)}", o, r.choice(names), "claim", r.choice([R.SUPPORTED, R.REWRITTEN, R.CLEARED, None]), r.choice([None, "new"]), r.choice([None, "why", ""]), some(ref, 4)) for o in range(90)]
    cleanups = [(f"s{i}", r.choice([None, {}, {"terrain": "flat", "resupply": None}]), some(ref, 3), some(lambda: (r.choice(["1", "2"]), quote(), "fresh gamma"), 3), r.choice([None, "", "look"])) for i in range(0, 66, 2)]
    refs = f"array<{R.REF}>"
    done = R.resolved(
        spark.createDataFrame(segments, f"id string, title string, fields map<string,string>, book_refs {refs}, chapter_refs {refs}, review_notes array<string>, evidence_notes array<string>, evidence_status string"),
        spark.createDataFrame(rules, f"id string, ord int, field string, claim string, action string, new_value string, note string, refs {refs}"),
        spark.createDataFrame(cleanups, f"id string, fields map<string,string>, refs {refs}, updates array<struct<page:string,old_quote:string,new_quote:string>>, review_note string"),
        spark.createDataFrame(list(pages.items()), "page int, text string"),
    )
    want = loop(segments, rules, cleanups, pages)
    got = done.collect()
    assert len(got) == len(want)
    for x in got:
        mine = (x.fields, [tuple(b) for b in x.book_refs], [tuple(c) for c in x.chapter_refs], x.review_notes, x.evidence_notes, x.evidence_status, x.moved, [tuple(e) for e in x.log], tuple(x.cleanup) if x.cleanup else None)
        assert mine == want[x.id], x.id
    assert R.change_log(done).count() == sum(len(w[7]) for w in want.values())


def test_the_query_equals_the_loop(spark):
    import os

    import pytest

    from quillspark.plans.resolution_queries import g24, n12_log, resolution_inputs

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    segments, rules, cleanups, pages = (x.collect() for x in resolution_inputs(spark, sf))
    flat = lambda refs: [tuple(r) for r in refs] if refs is not None else None
    want = loop(
        [(s.id, s.title, dict(s.fields), flat(s.book_refs), flat(s.chapter_refs), s.review_notes, s.evidence_notes, s.evidence_status) for s in segments],
        [(*r[:-1], flat(r.refs)) for r in rules], [(c.id, c.fields, flat(c.refs), flat(c.updates), c.review_note) for c in cleanups], {p.page: p.text for p in pages},
    )
    got = g24(spark, sf).collect()
    assert len(got) == len(want) > 0
    for x in got:
        assert (x.fields, flat(x.book_refs), flat(x.chapter_refs), x.review_notes, x.evidence_notes, x.evidence_status, x.moved, flat(x.log), tuple(x.cleanup) if x.cleanup else None) == want[x.id]
    assert {(r.id, r.place, *tuple(r)[2:]) for r in n12_log(spark, sf).collect()} == {(i, k, *e) for i, w in want.items() for k, e in enumerate(w[7])}
    assert any(w[8] for w in want.values())
