"""Decisions on reading blocks: orders are decisions, some of them on tasks that are not there, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import decisions as D
from quillspark.plans.registry import query, table

_RESULTS, _STRATEGIES, _NOTES = ("", *D.RESULTS, "odd"), ("", *D.STRATEGIES, "weird"), ("", "n", " ", "see PRIVATE/x", "fine")


def _pick_sql(values, k: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{k} % {len(values)} + 1]"


_FILE = f"""d AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'b-' || (o_orderkey - 1) ELSE 'b-' || o_orderkey END AS id, {_pick_sql(_RESULTS, 'o_orderkey')} AS r, {_pick_sql(_STRATEGIES, '(o_orderkey // 2)')} AS s, trim({_pick_sql(_NOTES, '(o_orderkey // 3)')}) AS t FROM orders),
  k AS (SELECT 'b-' || o_orderkey AS id, CASE WHEN o_totalprice > 400000 THEN 'keep' ELSE '' END AS standing FROM orders WHERE o_orderstatus <> 'P'),
  j AS (SELECT d.*, CASE WHEN d.id = '' THEN 'blank_block_task_id' WHEN row_number() OVER (PARTITION BY d.id ORDER BY ord) > 1 THEN 'duplicate_block_task_id' WHEN k.id IS NULL THEN 'unknown_block_task_id' WHEN r || s || t = '' THEN NULL WHEN r = '' THEN 'missing_review_result' WHEN r = 'odd' THEN 'invalid_review_result'
    WHEN s = 'weird' THEN 'invalid_replacement_strategy' WHEN t = '' AND r NOT IN ('keep', 'move_to_extra', 'move_to_core') THEN 'review_notes_required' WHEN r = 'replace' AND s IN ('', 'not_needed') THEN 'replacement_strategy_required' WHEN r = 'keep' AND s NOT IN ('', 'not_needed') THEN 'keep_strategy_must_be_blank_or_not_needed'
    WHEN standing <> '' THEN 'overwrite_blocked' WHEN contains(lower(t), 'private/') THEN 'forbidden_marker' END AS problem FROM d LEFT JOIN k ON d.id = k.id)"""


def _judged(spark, d):
    k = F.col("o_orderkey")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.floor(k / by) % len(values)).cast("int"))
    name = lambda n: F.concat(F.lit("b-"), n.cast("string"))
    orders = table(spark, d, "orders")
    file = orders.select(k.alias("ord"), F.when(k % 11 == 0, F.lit(" ")).when(k % 13 == 0, name(k - 1)).otherwise(F.concat(name(k), F.lit(" "))).alias("block_task_id"), pick(_RESULTS, 1).alias("review_result"), pick(_STRATEGIES, 2).alias("replacement_strategy"), pick(_NOTES, 3).alias("review_notes"), F.lit(None).cast("string").alias("reviewer"))
    tasks = orders.where("o_orderstatus <> 'P'").select(name(k).alias("block_task_id"), F.when(F.col("o_totalprice") > 400000, "keep").alias("review_result"))
    return D.judged_block_decisions(file, tasks, "ord")


@query("g10_block_decisions", f"WITH {_FILE} SELECT ord, problem, problem IS NULL AND r || s || t = '' AS blank, problem IS NULL AND r || s || t <> '' AS usable FROM j")
def g10_blocks(spark, d):
    return _judged(spark, d).select("ord", "problem", "blank", "usable")


@query("g10_blockers", f"WITH {_FILE} SELECT CASE WHEN id = '' THEN problem ELSE problem || ':' || id END AS blocker, min(ord) AS place FROM j WHERE problem IS NOT NULL GROUP BY 1")
def g10_blockers(spark, d):
    return D.blockers(_judged(spark, d), "ord").select("blocker", "place")


@query("g10_import_summary", f"WITH {_FILE} SELECT count(*) AS \"rows\", count(*) FILTER (problem IS NULL AND r || s || t = '') AS blank, count(*) FILTER (problem IS NULL AND r || s || t <> '') AS usable, count(problem) AS invalid, CASE WHEN count(problem) = 0 THEN count(*) FILTER (r || s || t <> '') ELSE 0 END AS would_update FROM j")
def g10_summary(spark, d):
    return D.import_summary(_judged(spark, d))
