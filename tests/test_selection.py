"""Choice of excerpts and blocks, walks through JSON, cascades and identity on hand-made rows."""

import random

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.identity import identity
from quillspark.operators import joins as J
from quillspark.operators import review as R
from quillspark.operators import selection as S
from quillspark.operators import walks as K


def brute_choice(rows, roles, k, by_order):
    out = []
    for part in sorted({r[0] for r in rows}):
        mine, taken = sorted((r for r in rows if r[0] == part), key=lambda r: (-r[3], r[4])), []
        wanted = [[r for r in mine if r[2] == role] for role in roles]
        for options in [*wanted, *[mine] * k]:
            new = [r for r in options if r[1] not in {t[1] for t in taken}]
            taken += new[:1] if len(taken) < k else []
        out += [(part, i, *r[1:]) for i, r in enumerate(sorted(taken, key=lambda r: r[4]) if by_order else taken, 1)]
    return out


def test_choice_against_brute_force(spark):
    dice = random.Random(3)
    rows = [(part, dice.choice("abcdefghijklm"), dice.choice(["r1", "r2", "r3", "x"]), dice.randint(0, 6), o) for part in range(40) for o in range(dice.randint(1, 60))]
    df = spark.createDataFrame(rows, "part int, t string, r string, s int, o int").repartition(5)
    for k, by_order in ((1, False), (3, True), (5, False), (5, True)):
        got = sorted(tuple(r) for r in S.choose(df, ["part"], "t", "r", "s", "o", ("r2", "r1", "r3"), k, by_order).collect())
        assert got == sorted(brute_choice(rows, ("r2", "r1", "r3"), k, by_order))


def test_choice_leaves_out_nulls_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "r", 1, 0), (1, "a", None, 1, 1), (1, "b", "r", None, 2), (None, "c", "r", 1, 3)], "part int, t string, r string, s int, o int")
    got = {tuple(r) for r in S.choose(df, ["part"], "t", "r", "s", "o", ("r",), 2).collect()}
    assert got == {(1, 1, "a", None, 1, 1), (None, 1, "c", "r", 1, 3)}
    assert S.choose(df.limit(0), ["part"], "t", "r", "s", "o", ("r",), 2).count() == 0


def sections(spark):
    text = "标题\n第1封 x\n我们从北京出发，坐火车沿着铁路走了很久很久，终于看见了大山。然后到了上海的街上，人很多，朋友请我们吃饭，住在一家小店里面休息了一夜，又说了许多话。\n父母台鉴，写信。\n我觉得非常寂寞，心里想着家里的人，可惜不能回去，只好继续写信给他们看看。\n短句。"
    return spark.createDataFrame([(1, "标题", text, ["上海", "", None]), (2, "t", "", []), (3, None, None, None)], "id int, title string, text string, places array<string>")


def test_section_excerpts_by_hand(spark):
    r = S.section_excerpts(sections(spark), "id", "title", "text", "places").orderBy("id", "place").collect()
    assert [(x.id, x.place, x.role) for x in r] == [(1, 1, "opening_scene"), (1, 2, "place_description"), (1, 3, "closing_moment"), (1, 4, "closing_moment")]
    assert r[0].score == len(r[0].text) + 35 + 30 and r[1].score == len(r[1].text) + 45 + 30  # movement, scenery; place, scenery
    assert r[2].score == len(r[2].text) + 25 and r[3].text.startswith(r[0].text)  # feelings; the head of a paragraph as a spare


def test_section_blocks_by_hand(spark):
    r = S.section_blocks(sections(spark), "id", "title", "text", "places").collect()
    assert [(x.id, x.place, x.role, x.scope) for x in r] == [(1, 1, "opening_scene", "paragraph")]
    long = "。".join(f"第{i}天忽然下起了雨，大家只好在屋子里等候着天晴起来再上山去玩耍一番" for i in range(14)) + "。"
    r = S.section_blocks(spark.createDataFrame([(1, "t", long, ["山"])], "id int, title string, text string, places array<string>"), "id", "title", "text", "places").collect()
    assert [x.scope for x in r] == ["paragraph_group"] and 160 <= len(r[0].text) <= 320 and r[0].score == min(len(r[0].text), 240) + (50 if len(r[0].text) <= 260 else 0) + 55


def test_excerpts_around_by_hand(spark):
    df = spark.createDataFrame([("0123456789abc上海xyz", "t" * 40), ("", None), (None, "title")], "text string, title string")
    got = df.select(S.excerpts_around(F.col("text"), F.array(F.lit("上海"), F.lit(""), F.lit("0"), F.lit("1")), F.col("title")).alias("x")).collect()
    assert [r.x for r in got] == [["3456789abc上海xyz", "0123456789abc上海xy"], [""], ["title"]]


def test_walks_by_hand(spark):
    df = spark.createDataFrame([(1, '{"a":["x",{"b":"y"}],"c":null,"d":"","page":1,"quote":{"page":"p","quote":null}}'), (2, "no json"), (3, None), (4, '"s"'), (5, "[" * 100_000), (6, "")], "id int, j string")
    got = [tuple(r) for r in K.json_strings(df, "id", "j").orderBy("id", "place").collect()]
    assert got == [(1, 1, "$.a[0]", "x"), (1, 2, "$.a[1].b", "y"), (1, 3, "$.d", ""), (1, 4, "$.quote.page", "p"), (2, 1, None, None), (4, 1, "$", "s"), (5, 1, None, None), (6, 1, None, None)]
    got = [tuple(r) for r in K.json_objects(df, "id", "j", ("page", "quote")).where("path IS NOT NULL").orderBy("place").collect()]
    assert got == [(1, 1, "$", "1", '{"page":"p","quote":null}'), (1, 2, "$.quote", "p", None)]


def test_question_cascade_by_hand(spark):
    questions = spark.createDataFrame([("q-001", "L9", ["L1"], "book", 1), ("q-002", None, ["L1"], "letter", 2), ("q-003", "L1", None, "book", 3), ("q-1004", "L8", [], "x", 4), ("q-004", "L8", [], "x", 5)], "question_id string, letter_id string, linked array<string>, scope string, ord int")
    chapters = spark.createDataFrame([(1, "L1", 9), (2, "L5", 1), (3, None, 7), (4, "L7", 1004), (5, "L7", 4), (6, "L7", 77), (7, "L7", None)], "chapter_id int, letter_id string, number int")
    got = {r.chapter_id: r.question_id for r in J.question_of(chapters, questions).collect()}
    assert got == {1: "q-002", 2: "q-001", 3: "q-002", 4: "q-1004", 5: "q-1004", 6: None, 7: None}


def test_membership_and_array_keys_by_hand(spark):
    groups = spark.createDataFrame([(1, ["a", "b"], ["a"], 1), (2, None, ["b", None], 2), (3, [], None, 3)], "g int, x array<string>, y array<string>, ord int")
    items = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "item string")
    assert sorted(tuple(r) for r in J.memberships(items, "item", groups, ["x", "y"]).select("item", "g").collect()) == [("a", 1), ("b", 1), ("b", 2)]
    got = J.by_array_key(items.distinct(), "item", groups.drop("x"), "y", "ord").select("item", "g").collect()
    assert {r.item: r.g for r in got} == {"a": 1, "b": 2, None: None}


def test_identity_by_hand(spark):
    rows = [("书名《远行》 /张三 著\n北京：人民出版社，2001.5\nISBN 978-7-5678-9", None), ("# A  B OCR 文本\n\n李四—著", None), ("ISBN 1\n\n定价 9\n名 字 OCR 文本\n王五 著", "f"), ("上海出版社", "f"), (None, "f")]
    df = spark.createDataFrame(rows, "t string, f string").select(identity(F.col("t"), F.col("f")).alias("x")).select("x.*")
    got = [(r.title, r.author, r.publisher, r.publication_date, r.isbn, [e.field for e in r.evidence]) for r in df.collect()]
    assert got == [
        ("书名《远行》", "张三", "人民出版社", "2001.5", "978-7-5678-9", ["title_author", "publication_info", "isbn"]),
        ("A B", "李四", None, None, None, ["title", "author"]),
        ("名 字", "王五", None, None, None, ["title", "author"]),
        ("f", None, "上海出版社", None, None, ["publisher"]),
        ("f", None, None, None, None, []),
    ]


def test_fills_and_records(spark):
    df = spark.createDataFrame([(["a", "a"], "b"), ([None], None)], "xs array<string>, x string")
    assert [r.y for r in df.select(T.appended(F.col("xs"), F.col("x")).alias("y")).collect()] == [["a", "a", "b"], [None]]
    assert [r.y for r in df.select(T.filled(F.col("xs"), F.array(F.lit("a"), F.lit("c"), F.lit("c"), F.lit("d")), lambda x: x, 3).alias("y")).collect()] == [["a", "a", "c"], [None, "a", "c"]]
    judged = spark.createDataFrame([(" t1 ", "ok ", None, True), ("t2", "", "", False)], "id string, result string, notes string, usable boolean")
    r = R.decision_records(judged, ["id", "result", "notes"]).collect()
    assert [(x.id, x.result, x.notes) for x in r] == [("t1", "ok", "")] and r[0].imported_at


def test_numbers_meet_questions_by_equal_ends(spark):
    chapters = spark.createDataFrame([(1, None, 7), (2, "x", 1007), (3, "x", 12345), (4, "x", None), (5, "x", 45), (6, "x", 9)], "chapter_id int, letter_id string, number long")
    questions = spark.createDataFrame([("Q-1007", "a", [], "book", 2), ("Q-007", "b", [], "book", 3), ("Q-12345", "c", [], "book", 1), ("Q-9000", "c", [], "book", 4), ("Q-1045", "d", [], "book", 5), ("45", "d", [], "book", 0)], "question_id string, letter_id string, linked array<string>, scope string, ord long")
    found = J.question_of(chapters, questions)
    assert {r.chapter_id: r.question_id for r in found.collect()} == {1: "Q-1007", 2: "Q-1007", 3: "Q-12345", 4: "Q-9000", 5: "Q-1045", 6: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "EndsWith" not in plan and "endswith" not in plan.lower()  # no pairs that an equal end of three characters leaves open


def test_identity_looks_for_each_line_once(spark):
    book = spark.createDataFrame([("x" * 60 + "\n a  book \n李四 — 著\n",), ("# T  one OCR 文本\n/x",)], "t string")
    found = book.select(identity(F.col("t"), F.lit("none")).alias("x"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("NEWSTAR") == 1 and plan.count("[—\\-－]*\\s*著$") == 2  # one to find the line, one to take its name
    assert [(r.x.title, r.x.author) for r in found.collect()] == [("a book", "李四"), ("T one", None)]
