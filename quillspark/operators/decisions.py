"""Decisions on reading blocks: eleven rules in order, the first broken one names the row's problem; what a file of them comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import has_marker, or_empty, strip
from quillspark.operators.release import SOURCE_MARKERS

# Results, strategies, the results that need notes, the fields a file must have.
RESULTS = ("keep", "replace", "shorten", "expand", "move_to_extra", "move_to_core", "needs_context", "rewrite_note", "remove", "defer")
STRATEGIES = ("use_adjacent_paragraph", "use_more_specific_scene", "use_route_movement", "use_place_description", "use_reflection", "manual_pick", "not_needed")
NEED_NOTES = ("replace", "shorten", "expand", "needs_context", "rewrite_note", "remove", "defer")
FIELDS = ("block_task_id", "replacement_strategy", "review_notes", "review_result")


def missing_fields(decisions: DataFrame) -> list[str]:
    """Fields that the file must have and has not; with any of them no row is judged."""
    return [c for c in FIELDS if c not in decisions.columns]


def judged_block_decisions(decisions: DataFrame, tasks: DataFrame, order: str, overwrite: bool = False) -> DataFrame:
    """decisions with problem (the first rule broken, else null), blank (says nothing, and breaks nothing) and usable.

    decisions: FIELDS, reviewer, and a unique order; white space around values does not count, null is empty. A row repeats an id
    if another with it stands before, whatever that one was. tasks: block_task_id (unique) and review_result, the one that stands.
    Rows of one id shrink to the first one's place before they meet, so an id that is repeated without end does no harm.
    """
    named = decisions.withColumn("_id", strip(or_empty("block_task_id")))
    first = named.where("_id <> ''").groupBy("_id").agg(F.min(order).alias("_first"))
    known = tasks.select(F.col("block_task_id").alias("_id"), strip(or_empty("review_result")).alias("_standing"))
    j = named.join(first.join(known, "_id", "left"), "_id", "left")
    result, strategy, notes, reviewer = (strip(or_empty(c)) for c in ("review_result", "replacement_strategy", "review_notes", "reviewer"))
    idle = strategy.isin("", "not_needed")
    rules = [
        ("blank_block_task_id", F.col("_id") == ""),
        ("duplicate_block_task_id", F.col(order) > F.col("_first")),
        ("unknown_block_task_id", F.col("_standing").isNull()),
        (None, F.concat(result, strategy, notes) == ""),
        ("missing_review_result", result == ""),
        ("invalid_review_result", ~result.isin(*RESULTS)),
        ("invalid_replacement_strategy", ~strategy.isin("", *STRATEGIES)),
        ("review_notes_required", result.isin(*NEED_NOTES) & (notes == "")),
        ("replacement_strategy_required", (result == "replace") & idle),
        ("keep_strategy_must_be_blank_or_not_needed", (result == "keep") & ~idle),
        ("overwrite_blocked", (F.col("_standing") != "") & F.lit(not overwrite)),
        ("forbidden_marker", has_marker(F.concat_ws("\n", notes, reviewer, strategy), SOURCE_MARKERS)),
    ]
    problem = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        problem = F.when(broken, F.lit(name).cast("string")).otherwise(problem)
    silent = F.concat(result, strategy, notes) == ""
    judged = j.withColumn("problem", problem)
    clean = F.col("problem").isNull()
    return judged.select(*[F.col(f"`{c}`") for c in decisions.columns], "problem", (clean & silent).alias("blank"), (clean & ~silent).alias("usable"))


def blockers(judged: DataFrame, order: str) -> DataFrame:
    """place (the first row's order) and blocker: each problem with its id, once."""
    name: Column = F.when(F.col("problem") == "blank_block_task_id", F.col("problem")).otherwise(F.concat_ws(":", "problem", strip(or_empty("block_task_id"))))
    return judged.where("problem IS NOT NULL").select(name.alias("blocker"), F.col(order).alias("_o")).groupBy("blocker").agg(F.min("_o").alias("place"))


def import_summary(judged: DataFrame) -> DataFrame:
    """One row: rows, blank, usable, invalid, and would_update: what is usable where nothing is invalid, else nothing."""
    n = F.count_if
    s = judged.agg(F.count(F.lit(1)).alias("rows"), n("blank").alias("blank"), n("usable").alias("usable"), n(F.col("problem").isNotNull()).alias("invalid"))
    return s.withColumn("would_update", F.when(F.col("invalid") == 0, F.col("usable")).otherwise(0))
