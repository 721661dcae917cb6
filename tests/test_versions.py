"""A table in versions, and decisions that are written as one or not at all."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillspark.operators import review as R
from quillspark.sources.versioned import VersionConflict, VersionedTable


def test_versions_stay_and_one_writer_wins(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    assert t.version() == 0 and t.write(spark.range(3).toDF("a")) == 1
    (tmp_path / "t/versions/v00000002").write_text("")
    assert t.version() == 1 and t.write(spark.range(5).select(F.col("id").alias("a"), F.lit("x").alias("b"))) == 2
    assert t.read().count() == 5 and t.read(1).columns == ["a"] and t.read(1).count() == 3

    def attempt(k):
        try:
            return t.write(spark.range(k).toDF("a"), after=2)
        except VersionConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(attempt, range(1, 5)), key=str) == [3, None, None, None]
    assert t.versions() == [1, 2, 3] and not list((tmp_path / "t/versions").glob("_draft*"))


def tasks(spark):
    return spark.createDataFrame([("T-a", "P0", 1, "", None), ("T-b", "P0", 2, "pass", "old"), ("T-c", "P1", 3, None, "")], "task_id string, priority string, o int, manual_result string, notes string")


def test_imports_are_all_or_nothing(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.write(tasks(spark))
    rows = [("T-a", 1, " fail ", " n ", "me", "2024"), ("T-c", 2, "pass", "", None, ""), ("T-x", 3, "pass", "", "", ""), ("T-b", 4, "", "", "", "")]
    file = spark.createDataFrame(rows, "task_id string, o int, result string, notes string, reviewer string, reviewed_at string")
    judged = R.judged_decisions(file, tasks(spark).select("task_id", F.coalesce("manual_result", F.lit("")).alias("current")), "task_id", "o", ("pass", "fail"), ("fail",))
    phrase = "IMPORT MANUAL REVIEW DECISIONS INTO p"
    got = R.import_decisions(t, judged, "task_id", "p", apply=True, confirm=phrase)
    assert got == {"version": 1, "rows": 4, "usable": 2, "would_update": 0, "invalid": 1, "blockers": ["unknown id"], "applied": False}
    clean = judged.where("problem IS NULL")
    assert R.import_decisions(t, clean, "task_id", "p")["would_update"] == 2 and t.version() == 1
    assert R.import_decisions(t, clean, "task_id", "p", apply=True, confirm=phrase + " ")["blockers"] == ["missing_exact_import_confirmation"] and t.version() == 1
    assert R.import_decisions(t, clean, "task_id", "p", apply=True, confirm=phrase) == {"version": 2, "rows": 3, "usable": 2, "would_update": 2, "invalid": 0, "blockers": [], "applied": True}
    now = {r.task_id: r for r in t.read().collect()}
    assert [now["T-a"][c] for c in ("manual_result", "notes", "reviewer", "reviewed_at")] == ["fail", "n", "me", "2024"]
    assert [now["T-b"][c] for c in ("manual_result", "notes", "reviewer", "reviewed_at")] == ["pass", "old", "", ""]
    assert now["T-c"].manual_result == "pass" and now["T-c"].reviewed_at.startswith("20")


def test_one_result_by_its_phrase(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.write(tasks(spark))
    update = lambda ref, result, **more: R.update_result(t, ref, result, "task_id", "priority", "o", ("pass", "fail"), ("fail",), ("private/",), **more)
    assert update("t-A", "pass") == {"version": 1, "task": "T-a", "applied": False}
    for bad in (("P0-001", "odd", {}), ("P0-001", "fail", {}), ("P0-001", "pass", {"notes": "see PRIVATE/x"}), ("none", "pass", {}), ("P0-001", "pass", {"apply": True, "confirm": "UPDATE MANUAL REVIEW TASK P0-001"})):
        with pytest.raises(ValueError):
            update(bad[0], bad[1], **bad[2])
    assert t.version() == 1
    assert update("P0-001", "fail", notes="why", reviewer="me", apply=True, confirm="UPDATE MANUAL REVIEW TASK T-a") == {"version": 2, "task": "T-a", "applied": True}
    row = t.read().where("task_id = 'T-a'").first()
    assert (row.manual_result, row.notes, row.reviewer) == ("fail", "why", "me") and row.reviewed_at and t.read().count() == 3
