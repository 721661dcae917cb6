"""Texts of letters and reading units on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import templates as P
from quillspark.operators import letters as L

CLUE = "struct<excerpt:string,mode:string,note:string>"


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).collect()[0].v


def test_filled_prints_slots_and_braces(spark):
    c = F.col
    row = ("a", None)
    assert one(spark, P.filled("<{x}|{y}|{{z}}>", x=c("x"), y=c("y")), "x string, y string", row) == "<a||{z}>"
    assert one(spark, P.filled("")) == ""
    with pytest.raises(ValueError):
        P.filled("{missing}", x=c("x"))
    with pytest.raises(ValueError):
        P.filled("{x:>3}", x=c("x"))


def test_previews_lists_and_padding(spark):
    rows = [("abcdef", ["a", "", None, "b", "a"]), ("abc", []), (None, None)]
    df = spark.createDataFrame(rows, "t string, xs array<string>")
    got = df.select(P.preview(F.col("t"), 3).alias("p"), P.listed(F.col("xs"), "none").alias("l"), P.padded(P.some(F.col("xs")), 3, "f", 4).alias("d"), P.by_key(F.col("t"), {"abc": "three"}, "other").alias("k")).collect()
    assert [r.p for r in got] == ["abc...", "abc", ""]
    assert [r.l for r in got] == ["a、b、a", "none", "none"]
    assert [r.d for r in got] == [["a", "b", "f"], ["f"] * 3, ["f"] * 3]
    assert [r.k for r in got] == ["other", "three", "other"]


def test_notes_name_three_places_or_tell_the_kind(spark):
    rows = [("reflection", "A B C D", ["D", "", None, "C", "X", "B", "A"]), ("reflection", "none", ["A"]), ("nothing", None, None), (None, "A", ["A"])]
    df = spark.createDataFrame(rows, "kind string, t string, places array<string>")
    of = (F.col("kind"), F.col("t"), F.col("places"))
    got = df.select(L.excerpt_note(*of).alias("e"), L.block_note(*of).alias("b"), L.reading_use(F.col("kind")).alias("u")).collect()
    assert got[0].e == "感受反思：这段直接触及D、C、B，适合作为理解本封信地点经验的文本入口。" and got[0].b.startswith("感受反思：这段把D、C、B放进")
    assert got[1].e == L.EXCERPT_NOTES["reflection"] and got[1].b == L.BLOCK_NOTES["reflection"] and got[1].u == L.EXCERPT_USES["reflection"]
    assert (got[2].e, got[2].b, got[2].u) == (L.EXCERPT_NOTE, L.BLOCK_NOTE, L.EXCERPT_USE)
    assert got[3].e.startswith("阅读线索：这段直接触及A") and got[3].b.startswith("阅读片段：这段把A放进")


def test_scene_notes_pad_to_three_and_stop_at_six(spark):
    rows = [(list("abcdef"), list("ABCDE"), list("wxyz"), "t"), (None, ["", None], None, "t"), ([], ["A"], [], None), ([], [], [], None)]
    df = spark.createDataFrame(rows, "tags array<string>, places array<string>, themes array<string>, title string")
    many, titled, placed, bare = (r.n for r in df.select(L.scene_notes(*map(F.col, ("tags", "places", "themes", "title"))).alias("n")).collect())
    assert len(many) == 6 and "可见d线索" in many[3] and "A、B、C、D组织" in many[4] and many[5] == "结构主题提示读者关注w、x、y。"
    assert titled == ["本封信以“t”为主要定位，具体场景仍待人工复核。", L.SCENE_FILLER, L.SCENE_FILLER]
    assert placed[0] == "标题和正文线索把A组织成本封信的空间骨架。" and placed[1:] == [L.SCENE_FILLER] * 2
    assert bare[0].startswith("本封信以“”")


def test_reading_steps_name_the_route(spark):
    df = spark.createDataFrame([("A—B",), ("",), (None,)], "r string")
    assert [r[0][0] for r in df.select(L.reading_steps(F.col("r"))).collect()] == ["先看路线：把“A—B”当作本封信的阅读骨架。"] + ["先看路线：把“本封信路线”当作本封信的阅读骨架。"] * 2


def test_briefs_number_the_body_of_each_book(spark):
    sections = [("b", "sec-005", 1, "x", 1, 1), ("b", "sec-006", 9, " two 　 words ", 5, 0), ("b", "sec-030", 2, None, None, 7), ("b", "sec-031", 3, "x", 1, 1), ("b", "sec-0061", 0, "x", 1, 1), ("b", None, 0, "x", 1, 1), ("c", "sec-006", 1, "", 1, None)]
    chunks = [("b", "sec-006", 2, "k2"), ("b", "sec-006", 1, "k1"), ("b", "sec-006", 3, ""), ("b", "sec-006", 4, "k4"), ("b", "sec-006", 5, "k5"), ("c", "sec-007", 1, "z")]
    s = spark.createDataFrame(sections, "book string, section_id string, ord int, title string, char_count int, chunk_count int")
    c = spark.createDataFrame(chunks, "book string, section_id string, ord int, chunk_id string")
    got = {(r.book, r.letter_id): r for r in L.letters_brief(s, c).collect()}
    assert sorted(got) == [("b", "letter-001"), ("b", "letter-002"), ("c", "letter-001")]
    first, second, other = (got[k] for k in sorted(got))
    assert (first.section_id, first.brief, first.chunk_count, first.chunk_ids) == ("sec-030", L.BRIEF_UNTITLED, 7, [])
    assert (second.title, second.chunk_count, second.chunk_ids, second.evidence_ids) == ("two words", 5, ["k1", "k2", "k4", "k5"], ["k1", "k2", "k4"])
    assert "“two words”" in second.brief and other.chunk_count == 0
    assert L.letters_brief(s.limit(0), c).count() == 0


PART = "array<struct<{}:string,{}:string,text:string,note:string>>"


def test_excerpt_answers_quote_the_letter_or_the_first_three(spark):
    e = lambda i, text, note=None: (i, "reflection", text, note)
    rows = [("l2", 2, "c2", "s2", "T", ["A", "B", "C", "D", "E"], [e("core", "x" * 47, "N.")], [e("all", "y")]), ("l1", 1, "c1", "s1", "", None, [], [e("all", "z" * 46)]), ("l3", 3, "c3", "s3", None, [], None, None), ("l1", 4, "c4", "s4", "late", [], [], [])]
    chapters = spark.createDataFrame(rows, f"letter_id string, ord int, chapter_id string, section_id string, title string, places array<string>, core_excerpts {PART.format('anchor_id', 'kind')}, excerpts {PART.format('anchor_id', 'kind')}")
    asked = spark.createDataFrame([("q1", "l1"), ("q2", "l2"), ("q3", ""), ("q4", None), ("q5", "unknown")], "question_id string, letter_id string")
    got = {r.question_id: r for r in L.excerpt_answers(asked, chapters).collect()}
    assert len(got) == 5 and got["q2"].letter_id == "l2"
    assert got["q2"].quick_answer == f"参考回答：先读“{'x' * 46}...”，再把《T》中的地点和移动线索连起来看。" and "N. 再结合 A、B、C、D 的" in got["q2"].deep_answer
    assert [a.anchor_id for a in got["q2"].source_anchor.anchors] == ["core"]
    assert got["q1"].source_anchor.anchors[0].chapter_id == "c4" and "“”" in got["q1"].quick_answer and L.NO_PLACES in got["q1"].deep_answer  # the last of a letter's chapters
    for q in ("q3", "q4", "q5"):
        assert [a.chapter_id for a in got[q].source_anchor.anchors] == ["c1", "c2", "c3"] and got[q].quick_answer == L.SAMPLE_QUICK
        assert [a.anchor_id for a in got[q].source_anchor.anchors] == ["all", "core", None] and got[q].source_anchor.anchor_type == "real_source_excerpt_route_sample"
    none = L.excerpt_answers(asked, chapters.limit(0)).collect()
    assert len(none) == 5 and all(r.source_anchor.anchors == [] for r in none)


def test_block_answers_fall_back_to_the_first_chapter(spark):
    rows = [("l2", 2, "c2", "s2", "T", None, [("b2", "r", "y" * 59, "note")]), ("l1", 1, "c1", "s1", None, [], [])]
    chapters = spark.createDataFrame(rows, f"letter_id string, ord int, chapter_id string, section_id string, title string, core_blocks {PART.format('block_id', 'role')}, blocks {PART.format('block_id', 'role')}")
    asked = spark.createDataFrame([("q1", "l2"), ("q2", "gone"), ("q3", None)], "question_id string, letter_id string")
    got = {r.question_id: r for r in L.block_answers(asked, chapters).collect()}
    assert got["q1"].source_anchor.block_id == "b2" and f"“{'y' * 58}...”" in got["q1"].quick_answer and "进入。note 读完" in got["q1"].deep_answer
    for q in ("q2", "q3"):
        assert got[q].source_anchor.letter_id == "l1" and got[q].source_anchor.block_id is None and "《本封信》" in got[q].quick_answer
    assert got["q2"].letter_id == "gone"


def test_source_clues_fill_up_to_four_without_repeats(spark):
    e = lambda *xs: [(x, None, None) for x in xs]
    rows = [
        (1, "l", e("a", " ", "b"), "a", ["b"], "R", ["P"]), (2, "l", e(*"abcde"), "f", ["s"], "R", ["P"]), (3, None, None, "", None, "", ["P", "", None, "Q"]), (4, "l", [], "f" * 200, [""], None, None),
    ]
    df = spark.createDataFrame(rows, f"k int, l string, own array<{CLUE}>, focus string, scenes array<string>, route string, places array<string>")
    got = {r.k: r.c for r in df.select("k", L.source_clues(*map(F.col, ("l", "own", "focus", "scenes", "route", "places"))).alias("c")).collect()}
    assert [(c.clue_id, c.excerpt) for c in got[1]] == [("l-clue-01", "a"), ("l-clue-03", "b"), ("l-clue-03", "地点线索：P。")]  # numbers as they are given: a blank one counts, an added one counts what stands
    assert [c.excerpt for c in got[2]] == list("abcd") and got[2][0].mode == "short_original_clue" and got[2][0].note == L.CLUE_NOTE
    assert [c.excerpt for c in got[3]] == ["标题和路线把本封信放在“P、Q”这一段旅程中。", "本封信的核心场景围绕 P、Q 展开。", "地点线索：P、Q。"] and got[3][0].clue_id == "letter-clue-01"
    assert [len(c.excerpt) for c in got[4]] == [180, len("地点线索：待人工复核。")] and [c.mode for c in got[4]] == ["structured_reading_clue", "place_clue"]


def test_units_of_nulls_and_of_no_rows(spark):
    schema = (
        "chapter_id string, letter_id string, section_id string, number int, letter_stamp string, title string, route_label string, places array<string>, themes array<string>, chunk_count int, char_count int, source_summary string, letter_summary string, summary string, focus_expanded string, focus string, "
        f"close_reading struct<excerpt_focus:string,why_it_matters:string,then_now_prompt:string>, original_excerpt array<{CLUE}>, scene_notes array<string>, "
        "route_now array<struct<place_name:string,then_context:array<string>,now_context:string,source_status:string,source_name:string,coordinate_status:string,review_note:string>>, then_note string, reading_steps array<string>, then_now string, answer_hint_expanded string, evidence_refs array<string>, review_notice string"
    )
    asks = "question_id string, letter_id string, linked array<string>, scope string, ord int, question string, close_reading_answer string, answer_hint_expanded string, answer_hint string, answer_steps array<string>"
    rest = (None,) * 25
    chapters = spark.createDataFrame([("c1", *rest), ("c2", "l2", None, 2, *rest[3:])], schema)
    questions = spark.createDataFrame([("q-002", "other", None, None, 1, None, "", None, "hint。more", []), ("q-9", "l2", None, None, 2, "own", None, "wide", None, ["s"])], asks)
    units = L.reading_units(chapters, questions)
    got = {r.chapter_id: r.unit for r in units.collect()}
    bare, asked = got["c1"], got["c2"]
    assert bare.one_sentence_guide == L.NO_GUIDE and bare.basic_info.route == "待人工复核" and bare.basic_info.reading_length_hint == L.LENGTH_HINTS[3]
    assert bare.question_answer.question == L.UNIT_NO_QUESTION and bare.question_answer.reference_answer == L.UNIT_NO_ANSWER and bare.question_answer.question_id is None
    assert len(bare.source_clues) == 3 and bare.embedded_places == [] and bare.route_title is None and bare.close_reading_flow.reading_steps == list(L.UNIT_STEPS)
    assert (asked.question_answer.question_id, asked.question_answer.reference_answer, asked.question_answer.answer_steps) == ("q-9", "wide", ["s"])
    told = {r.question_id: (r.letter_anchor, r.answer_summary) for r in L.unit_questions(questions, units).collect()}
    assert told == {"q-002": (None, None), "q-9": ("c2", "wide")}
    only = L.reading_units(chapters, questions.where("ord = 1")).where("chapter_id = 'c2'").collect()[0].unit.question_answer
    assert (only.question_id, only.question, only.reference_answer) == ("q-002", None, "hint。more")  # found by the number in its id
    assert L.flow_summary(units).collect()[0].asDict() == {"letter_units": 2, "source_clue_ready": 2, "embedded_places_ready": 0, "question_answer_ready": 2, "with_question": 1}
    empty = L.reading_units(chapters.limit(0), questions)
    assert empty.count() == 0 and L.flow_summary(empty).collect()[0].letter_units == 0


@pytest.mark.parametrize("chars, chunks, hint", [(1, 6, 0), (4500, 5, 1), (2200, 0, 2), (0, 0, 3), (None, None, 3), (2201, 1, 3)])
def test_length_hints(spark, chars, chunks, hint):
    assert one(spark, L.length_hint(F.col("a"), F.col("b")), "a int, b int", (chars, chunks)) == L.LENGTH_HINTS[hint]
