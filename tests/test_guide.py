"""Guide composites and constraint suites on rows worked out by hand."""

from pyspark.sql import functions as F

from quillspark.operators import guide as U
from quillspark.operators import suites as S

STOP = "array<struct<place_name:string,then_context:array<string>,now_context:string,source_status:string,source_name:string,coordinate_status:string,review_note:string>>"


def stop(name, then=None, now=None, source=None, coordinate=None, note=None):
    return (name, then, now, source, None, coordinate, note)


def said(findings, rule=None):
    return sorted((r.path, r.message) for r in findings.collect() if rule is None or r.rule_id == rule)


def test_cut_text_strips_falls_back_and_ends_in_an_ellipsis(spark):
    df = spark.createDataFrame([("  ab  ",), (" \n",), (None,), ("abcd efgh",)], "t string")
    assert [r[0] for r in df.select(U.cut_text(F.col("t"), "none", 6)).collect()] == ["ab", "none", "none", "abcd…"]


def test_embedded_places(spark):
    rows = [
        (1, [stop("A", ["x", "", None, "y"], "now", "public_source", "public_coordinate", "n"), stop("B"), stop("A", source="draft", coordinate="approximate_coordinate")], ["Z"]),
        (2, [stop("A")], []), (3, [], ["P", "Q", "R", "S"]), (4, None, None), (5, [stop(c) for c in "abcdefg"], None),
    ]
    df = spark.createDataFrame(rows, f"id int, route {STOP}, places array<string>")
    got = {r.id: r.e for r in df.select("id", U.embedded_places(F.col("route"), F.col("places"), F.lit("")).alias("e")).collect()}
    a, b, again = got[1]
    assert (a.role, again.role) == ("抵达或收束地点",) * 2 and b.role == "途经或观察地点"  # a name's role is that of its last place
    assert (a.then_perspective, a.today_perspective, a.source_label, a.coordinate_label, a.review_note) == ("x、y", "now", "已有公开来源", "已有公开坐标", "n")
    assert (again.source_label, again.coordinate_label, b.source_status, b.coordinate_status) == ("待补充公开来源", "近似坐标", "needs_source_review", "needs_coordinate_review")
    assert got[2][0].role == "核心地点"
    assert [(e.place_name, e.role) for e in got[3]] == [(c, "地点线索") for c in "PQR"]
    assert got[4] == []
    assert [e.place_name for e in got[5]] == list("abcde") and got[5][4].role == "途经或观察地点"


def test_review_tasks_keep_the_first_of_equal_blocks(spark):
    blocks = spark.createDataFrame([("l1", 1, "b1", "x" * 90, "other", True, False), ("l1", 2, "b1", "y", "r", True, False), ("l1", 3, "b2", "z" * 281, None, False, True), ("l1", 4, "b3", None, "r", None, None), ("l2", 1, "b1", "x", "r", False, False)],
                                   "letter_id string, block_index long, block_id string, block_text string, reading_role string, core boolean, extra boolean")
    asked = spark.createDataFrame([("q2", "b3"), ("q1", "b3"), ("q3", None), (None, "b2")], "question_id string, block_id string")
    got = {r.block_task_id: r for r in U.review_tasks(blocks, asked).collect()}
    assert sorted(got) == ["block-l1-001", "block-l1-003", "block-l1-004", "block-l2-001"]
    first, extra, linked, other = (got[k] for k in sorted(got))
    assert [t.review_priority for t in (first, extra, linked, other)] == ["P0", "P2", "P1", "P2"]
    assert [t.current_placement for t in (first, extra, linked, other)] == ["core", "extra", "source", "source"]
    assert linked.linked_question_id == "q1;q2" and linked.block_text == "" and extra.linked_question_id == ""
    assert "possibly" not in first.suggested_checks and "; possibly long; possible core upgrade" in extra.suggested_checks and "possibly short" in linked.suggested_checks
    assert "recategorized" in first.review_question and "recategorized" in extra.review_question and "recategorized" not in other.review_question
    assert U.review_tasks(blocks.limit(0), asked).count() == 0


def test_task_blockers_name_the_first_broken_row(spark):
    schema = "k int, priority string, result string, notes string"
    def found(rows, promised):
        r = U.task_blockers(spark.createDataFrame(rows, schema), "k", F.lit(promised)).collect()[0]
        return r.total, r.blank, r.blockers
    assert found([(1, "P0", "pass", None), (2, "P2", "deferred", "later")], 2) == (2, 0, [])
    assert found([(1, "P2", "deferred", " "), (2, "P2", "fail", None)], 2) == (2, 0, ["p2_deferred_without_notes", "illegal_manual_result"])
    assert found([(2, "P2", "deferred", None), (1, "P2", "", None)], 3) == (2, 1, ["manual_review_summary_mismatch", "p2_not_pass_or_deferred"])
    assert found([(1, "P0", "", None), (2, "P1", "blocked", None)], 2) == (2, 1, ["manual_review_incomplete", "p0_p1_not_all_pass", "manual_review_blocked"])
    assert found([], 0) == (0, 0, [])


def test_added_projects_and_promotion(spark):
    old = spark.createDataFrame([("a", "A")], "slug string, title string")
    new = spark.createDataFrame([("a", "B"), ("b-2", "D"), ("b-2", "C"), ("Bad", "E"), (None, "F"), ("x--y", "G")], "slug string, title string")
    got = {(r.slug, r.title): r.refused for r in U.added_projects(old, new).collect()}
    assert got == {("a", "A"): None, ("a", "B"): "slug exists", ("b-2", "C"): None, ("b-2", "D"): "slug exists", ("Bad", "E"): "invalid slug", (None, "F"): "invalid slug", ("x--y", "G"): "invalid slug"}
    payload = spark.createDataFrame([("draft",)], "status string")
    assert U.promoted(payload, False, "yes", "yes", "final").first().status == "draft"
    assert U.promoted(payload, True, "yes", "yes", "final").first().status == "final"


def test_coordinate_stats_of_no_places(spark):
    r = U.coordinate_stats(spark.createDataFrame([], "coordinate_status string, coordinate_source_type string")).collect()[0]
    assert (r.total_place_count, r.coordinate_ready_count, r.coordinate_source_type_counts) == (0, 0, "{}")


POINT = "struct<name:string,lat:double,lng:double>"
SEGMENT = f"id string, place int, `order` int, title string, start {POINT}, end {POINT}, via array<{POINT}>, refs array<struct<page:int,quote:string,note:string>>, movement_type string, continuity_status string, walkability_status string, modern_followability string, gap_notes array<string>, do_not_connect boolean, review_notes string"
GOOD = ("s1", 1, 1, "t", ("A", 1.0, 2.0), ("B", 3.0, 4.0), [], [(5, "q", "n")], "walked", "continuous", "needs_review", "approximate_only", [], False, None)


def segment(**changes):
    names = [c.strip("`").split()[0].strip("`") for c in ("id place order title start end via refs movement_type continuity_status walkability_status modern_followability gap_notes do_not_connect review_notes").split()]
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD))


def test_route_suite(spark):
    run = lambda *rows: said(S.route(spark.createDataFrame(rows, SEGMENT)))
    assert run(segment()) == []
    assert run(segment(order=2)) == [("route", "order must be consecutive")]
    assert run(segment(id=None, start=None)) == [("<missing-id>", "missing id"), ("<missing-id>", "missing start.name")]
    assert run(segment(end=("B", 91.0, 4.0))) == [("s1", "invalid coordinate for B"), ("s1", "invalid coordinate for end B")]
    assert run(segment(via=[("C", None, 4.0)])) == [("s1", "invalid coordinate for C"), ("s1", "missing coordinates but no review_notes")]
    assert run(segment(via=[("C", None, None)], review_notes="r")) == []
    assert run(segment(refs=[(5, "q" * 121, "n"), (None, "", "n")])) == [("s1", "book_ref #1 quote longer than 120 chars"), ("s1", "book_ref #2 must include page, quote, note")]
    assert run(segment(refs=None, gap_notes=None, do_not_connect=None)) == [("s1", "missing book_refs"), ("s1", "missing do_not_connect"), ("s1", "missing gap_notes")]
    assert run(segment(do_not_connect=True, movement_type="vehicle")) == [("s1", "do_not_connect"), ("s1", "do_not_connect requires gap_notes"), ("s1", "movement_type=vehicle")]
    assert run(segment(movement_type=None, modern_followability="x")) == [("s1", "invalid modern_followability"), ("s1", "missing movement_type")]


def test_passages_suite(spark):
    chapters = spark.createDataFrame([(1, "a"), (2, "b")], "chapter int, section_id string")
    items = spark.createDataFrame([(1, 0, "a", "one  two", True, False, "n"), (1, 1, "a", "three four", False, True, ""), (1, 2, "b", "five", None, None, "n"), (1, 3, "a", None, None, None, "n")], "chapter int, item int, section_id string, text string, core boolean, extra boolean, note string")
    sections = spark.createDataFrame([("a", "x one\ntwo"), ("a", "three four"), ("b", "five"), ("a", None)], "section_id string, text string")
    got = S.passages(chapters, items, sections, "C6", {"all": 2, "core": 1}, ("text", "note"), ("three",), 5, 9, chapter_count=2)
    assert said(got, "C6.few") == [("chapters[2]", "expected >=1 core, got 0"), ("chapters[2]", "expected >=2 all, got 0")]
    assert said(got, "C6.field") == [("chapters[1][1]", "missing note"), ("chapters[1][3]", "missing text")]
    assert said(got, "C6.section") == [("chapters[1][2]", "section mismatch")]
    assert said(got, "C6.length") == [("chapters[1][1]", "near the long limit"), ("chapters[1][2]", "too short"), ("chapters[1][3]", "too short")]
    assert said(got, "C6.placeholder") == [("chapters[1][1]", "placeholder marker found")]
    assert said(got, "C6.source") == [("chapters[1][2]", "text not found in its section"), ("chapters[1][3]", "text not found in its section")]
    assert said(got, "C6.chapters") == []


def test_longer_blocks(spark):
    make = lambda *n: spark.createDataFrame([("x" * i,) for i in n], "text string")
    assert said(S.longer_blocks(make(90), make(55))) == [] and said(S.longer_blocks(make(100), make(66)))
    assert said(S.longer_blocks(make(89), make(1))) and said(S.longer_blocks(make(), make()))
