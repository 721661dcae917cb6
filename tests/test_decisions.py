"""Rules of decisions on rows worked out by hand."""

from quillspark.operators import decisions as D

FILE = "ord long, block_task_id string, review_result string, replacement_strategy string, review_notes string, reviewer string"


def test_each_rule_in_its_turn(spark):
    rows = [
        (1, None, "keep", "", "", ""), (2, " a ", " keep ", "not_needed", "", ""), (3, "a", "", "", "", ""), (4, "gone", "keep", "", "", ""), (5, "b", None, " ", None, "r"), (6, "c", "", "manual_pick", "", ""),
        (7, "d", "maybe", "weird", "", ""), (8, "e", "keep", "weird", "", ""), (9, "f", "replace", "", " ", ""), (10, "g", "replace", "not_needed", "n", ""), (11, "h", "keep", "manual_pick", "", ""), (12, "done", "keep", "", "Private/", ""),
        (13, "i", "keep", "", "", "D:\\x"), (14, "j", "move_to_core", "use_reflection", "", None), (15, " ", "", "", "", ""), (16, "b", "keep", "", "", ""),
    ]
    tasks = spark.createDataFrame([(k, "defer" if k == "done" else None) for k in ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "done")], "block_task_id string, review_result string")
    file = spark.createDataFrame(rows, FILE)
    judged = D.judged_block_decisions(file, tasks, "ord")
    got = {r.ord: (r.problem, r.blank, r.usable) for r in judged.collect()}
    problem = {k: v[0] for k, v in got.items()}
    assert problem == {
        1: "blank_block_task_id", 2: None, 3: "duplicate_block_task_id", 4: "unknown_block_task_id", 5: None, 6: "missing_review_result", 7: "invalid_review_result", 8: "invalid_replacement_strategy", 9: "review_notes_required",
        10: "replacement_strategy_required", 11: "keep_strategy_must_be_blank_or_not_needed", 12: "overwrite_blocked", 13: "forbidden_marker", 14: None, 15: "blank_block_task_id", 16: "duplicate_block_task_id",
    }
    assert got[5][1:] == (True, False) and got[2][1:] == got[14][1:] == (False, True) and not any(got[k][1] or got[k][2] for k, v in problem.items() if v)
    told = [r.blocker for r in D.blockers(judged, "ord").orderBy("place").collect()]
    assert told[:2] == ["blank_block_task_id", "duplicate_block_task_id:a"] and len(told) == 12
    assert D.import_summary(judged).collect()[0].asDict() == {"rows": 16, "blank": 1, "usable": 2, "invalid": 13, "would_update": 0}
    clean = D.judged_block_decisions(file.where("ord IN (2, 5, 14)"), tasks, "ord")
    assert D.import_summary(clean).collect()[0].would_update == 2
    assert D.judged_block_decisions(file.where("ord = 12"), tasks, "ord", overwrite=True).collect()[0].problem == "forbidden_marker"
    assert D.import_summary(D.judged_block_decisions(file.limit(0), tasks, "ord")).collect()[0].would_update == 0


def test_missing_fields(spark):
    file = spark.createDataFrame([], FILE)
    assert D.missing_fields(file) == [] and D.missing_fields(file.drop("review_notes", "block_task_id")) == ["block_task_id", "review_notes"]
