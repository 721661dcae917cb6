"""Review tasks and decisions: generation, validation all or nothing, application as a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import has_marker, numbered
from quillspark.sources.versioned import VersionedTable


def priority(core: Column, first: Column, linked: Column) -> Column:
    return F.when(core & first, "P0").when(core | linked, "P1").otherwise("P2")


def decision_template(tasks: DataFrame, keep: list[str], blank: list[str]) -> DataFrame:
    return tasks.select(*keep, *[F.lit("").alias(c) for c in blank])


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def judged_decisions(decisions: DataFrame, tasks: DataFrame, key: str, order: str, results: tuple[str, ...], need_notes: tuple[str, ...] = (), markers: tuple[str, ...] = (), overwrite: bool = False, markers_first: bool = False) -> DataFrame:
    """Adds problem (the first rule broken, else null) and usable to each decision row.

    A row without result and notes is no decision: neither usable nor a problem; notes without a result are a problem. A repeated key is a problem even where its first row
    was one. tasks: key and current, the result that stands. markers_first turns the order of the last two rules.
    """
    known = tasks.select(F.col(key), F.col("current").alias("_current"), F.lit(True).alias("_known"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = decisions.withColumn("_turn", turn).join(known, key, "left")
    result, notes = _text("result"), _text("notes")
    standing = ~F.lit(overwrite) & (F.trim(F.coalesce("_current", F.lit(""))) != "")
    marked = has_marker(F.concat_ws(" ", result, notes), markers) if markers else F.lit(False)
    last = [("forbidden marker", marked), ("already decided", standing)]
    rules = [
        ("blank id", F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""),
        ("duplicate id", F.col("_turn") > 1),
        ("unknown id", F.col("_known").isNull()),
        ("result missing", (result == "") & (notes != "")),
        (None, result == ""),
        ("invalid result", ~result.isin(*results)),
        ("notes missing", result.isin(*need_notes) & (notes == "") if need_notes else F.lit(False)),
        *(last if markers_first else last[::-1]),
    ]
    problem = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        problem = F.when(broken, F.lit(name).cast("string")).otherwise(problem)
    judged = rows.withColumn("problem", problem).withColumn("usable", F.col("problem").isNull() & (result != ""))
    return judged.drop("_turn", "_current", "_known")


def apply_decisions(tasks: DataFrame, judged: DataFrame, key: str, dry_run: bool = True) -> DataFrame:
    """tasks with the usable results in place, or as they were if any row has a problem or this is a dry run; adds updated."""
    clean = judged.agg(F.coalesce(F.bool_and(F.col("problem").isNull()), F.lit(True)).alias("_clean"))
    usable = judged.where("usable").select(key, F.col("result").alias("_new"))
    joined = tasks.join(usable, key, "left").crossJoin(F.broadcast(clean))  # one row
    take = F.lit(not dry_run) & F.col("_clean") & F.col("_new").isNotNull()
    return joined.withColumn("current", F.when(take, F.col("_new")).otherwise(F.col("current"))).withColumn("updated", take).drop("_new", "_clean")


def resolve_task(tasks: DataFrame, wanted: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """wanted.ref -> key: the exact id, else without regard to case, else an alias like P0-001, the n-th of its group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    names = tasks.select(key, F.concat(F.col(group), numbered("-", n, 3)).alias("_alias"))
    ways = names.select(F.col(key).alias("_ref"), key, F.lit(0).alias("_rank")).unionByName(names.select(F.lower(F.col(key)).alias("_ref"), key, F.lit(1).alias("_rank"))).unionByName(names.select(F.col("_alias").alias("_ref"), key, F.lit(2).alias("_rank")))
    asked = wanted.select("ref", F.explode(F.array(F.col("ref"), F.lower("ref"))).alias("_ref")).distinct()
    return asked.join(ways, "_ref").groupBy("ref").agg(F.min_by(key, "_rank").alias(key))


def decision_records(judged: DataFrame, columns: list[str]) -> DataFrame:
    """The usable decisions as a table of their own: the columns without outer white space, empty for null, and the time of the
    import. The task table stays as it is."""
    return judged.where("usable").select(*[_text(c).alias(c) for c in columns], F.current_timestamp().alias("imported_at"))


# decisions that are written: a version of the task table, or nothing

#: What an import and an update must be confirmed with, word for word, before the project or the task.
IMPORT_PHRASE, UPDATE_PHRASE, UNCONFIRMED = "IMPORT MANUAL REVIEW DECISIONS INTO ", "UPDATE MANUAL REVIEW TASK ", "missing_exact_import_confirmation"


def decided(tasks: DataFrame, usable: DataFrame, key: str, result: str = "manual_result") -> DataFrame:
    """tasks with the result, notes, reviewer and time of the usable decisions (key, result, notes, reviewer, reviewed_at; a key once).

    Columns for reviewer and time are added where there are none; what stays undecided keeps its values, null ones as empty texts.
    A decision without a time takes the time of the import.
    """
    columns = [result, "notes", "reviewer", "reviewed_at"]
    given = {"result": result, "notes": "notes", "reviewer": "reviewer", "reviewed_at": "reviewed_at"}
    text = lambda c: _text(c) if c in usable.columns else F.lit("")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    new = usable.select(key, *[text(c).alias(f"_new_{n}") for c, n in given.items()], F.lit(True).alias("_hit")).withColumn("_new_reviewed_at", F.when(F.col("_new_reviewed_at") == "", now).otherwise(F.col("_new_reviewed_at")))
    for c in columns:
        if c not in tasks.columns:
            tasks = tasks.withColumn(c, F.lit(""))
    joined = tasks.join(new, key, "left")
    kept = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in columns else F.col(c) for c in tasks.columns]
    return joined.select(*kept)


def import_decisions(store: VersionedTable, judged: DataFrame, key: str, project: str, apply: bool = False, confirm: str = "") -> dict:
    """Writes the usable decisions as the table's next version, if that is asked for, confirmed word for word, and no row has a problem.

    judged: what judged_decisions made of the file, with notes, reviewer and reviewed_at. Returns version (the newest after the call),
    rows, usable, would_update, invalid, blockers (the problems by name, in order) and applied. Without apply it is a dry run.
    """
    version = store.version()
    counts = judged.agg(F.count(F.lit(1)).alias("rows"), F.count_if("usable").alias("usable"), F.count_if(F.col("problem").isNotNull()).alias("invalid"), F.array_sort(F.collect_set("problem")).alias("blockers")).first()  # as many names as there are rules
    blockers = list(counts["blockers"])
    would = 0 if blockers else counts["usable"]
    if apply and confirm != IMPORT_PHRASE + project:
        blockers.append(UNCONFIRMED)
    applied = apply and not blockers
    if applied:
        version = store.write(decided(store.read(version), judged.where("usable"), key), after=version)
    return {"version": version, "rows": counts["rows"], "usable": counts["usable"], "would_update": would, "invalid": counts["invalid"], "blockers": blockers, "applied": applied}


def update_result(
    store: VersionedTable, ref: str, result: str, key: str, group: str, order: str, results: tuple[str, ...], need_notes: tuple[str, ...] = (), markers: tuple[str, ...] = (), notes: str = "", reviewer: str = "", apply: bool = False, confirm: str = ""
) -> dict:
    """One task's result as the table's next version: the task by its id, or as resolve_task finds it. Returns version, task and applied.

    A result that is not among ``results``, lacks notes it needs, or has notes with a marker is refused; so are an unknown task and,
    where the update is to be applied, another phrase than UPDATE_PHRASE and the task's id.
    """
    if result not in results:
        raise ValueError(f"invalid result {result!r}: one of {sorted(results)}")
    if result in need_notes and not notes.strip():
        raise ValueError(f"{result} requires notes")
    if held := [m for m in markers if m.lower() in notes.lower()]:
        raise ValueError(f"notes hold forbidden markers: {held}")
    version = store.version()
    tasks = store.read(version)
    found = resolve_task(tasks, tasks.sparkSession.createDataFrame([(ref,)], "ref string"), key, group, order).first()
    if found is None:
        raise ValueError(f"no task {ref!r}")
    task = found[key]
    if apply:
        if confirm != f"{UPDATE_PHRASE}{task}":
            raise ValueError(f"missing exact confirmation: {UPDATE_PHRASE}{task}")
        one = tasks.sparkSession.createDataFrame([(task, result, notes, reviewer)], f"{key} {dict(tasks.dtypes)[key]}, result string, notes string, reviewer string")
        version = store.write(decided(tasks, one, key), after=version)
    return {"version": version, "task": task, "applied": apply}
