"""Evidence resolution and fields taken over from other structs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import resolution as R
from quillspark.operators import structs as S
from quillspark.plans.registry import query, table

FIELDS = ("resupply", "terrain", "lodging")


def resolution_inputs(spark, d):
    """(segments, rules, cleanups, pages): a conversation is a segment, its turns are rules, passages of the benchmark are pages.
    References quote a piece of their page, or of the one after it, where it cannot stand."""
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("page"), "text")
    quotes = items.select((F.col("page") % 40).alias("_k"), F.col("page").cast("string").alias("_page"), F.substring("text", 12, 30).alias("_quote")).where("page < 40")
    near = quotes.select(F.col("_k").alias("_k"), F.struct(F.col("_page").alias("page"), F.col("_quote").alias("quote")).alias("good"))
    far = quotes.select(((F.col("_k") + 1) % 40).alias("_k"), F.struct(((F.col("_k") + 1) % 40).cast("string").alias("page"), F.col("_quote").alias("quote")).alias("bad"))
    known = near.join(far, "_k", "left")
    noted = lambda r, note: F.struct(r["page"].alias("page"), r["quote"].alias("quote"), F.lit(note).alias("note")).cast(R.REF)
    good, bad = F.col("good"), F.col("bad")
    ids = F.col("conv_id").cast("string")
    value = lambda i: F.max_by(F.when(F.col("turn") == i, F.col("text")), F.when(F.col("turn") == i, F.lit(1)))
    segments = turns.groupBy("conv_id").agg(*[value(i).alias(f) for i, f in enumerate(FIELDS)]).withColumn("_k", F.col("conv_id") % 40).join(known, "_k")
    k = F.col("conv_id")
    title = F.when(k % 3 == 0, good["quote"]).otherwise(F.lit(""))
    refs = F.when(k % 5 == 0, F.array(noted(good, "章节"))).when(k % 5 != 1, F.array(noted(good, "n"), noted(bad, "n")))
    none = F.lit(None)
    s = segments.select(
        ids.alias("id"), title.alias("title"), F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*FIELDS)).alias("fields"), refs.alias("book_refs"), none.cast(f"array<{R.REF}>").alias("chapter_refs"),
        none.cast("array<string>").alias("review_notes"), F.when(k % 2 == 0, F.array(F.lit("seen"))).alias("evidence_notes"), F.when(k % 7 == 0, "pass").alias("evidence_status"),
    )
    t = F.col("turn")
    action = F.when((k + t) % 4 == 0, R.SUPPORTED).when((k + t) % 4 == 1, R.REWRITTEN).when((k + t) % 4 == 2, R.CLEARED)
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (t % 3 + 1).cast("int"))
    rules = turns.withColumn("_k", k % 40).join(known, "_k").select(ids.alias("id"), t.alias("ord"), field.alias("field"), F.substring("text", 1, 20).alias("claim"), action.alias("action"), F.substring("text", 1, 60).alias("new_value"), F.when(t % 2 == 0, "why").alias("note"), F.when(t % 3 == 0, F.array(noted(good, "r"))).when(t % 3 == 1, F.array(noted(bad, "r"), noted(good, "r"))).alias("refs"))
    updates = F.when(k % 4 == 0, F.array(F.struct(good["page"].alias("page"), F.upper(good["quote"]).alias("old_quote"), F.lit("fresh").alias("new_quote"))))
    cleanups = segments.where(k % 2 == 0).select(ids.alias("id"), F.when(k % 6 == 0, F.map_from_arrays(F.array(F.lit("terrain")), F.array(F.lit("flat")))).alias("fields"), F.when(k % 8 == 0, F.array(noted(good, "c"))).alias("refs"), updates.alias("updates"), F.when(k % 10 == 0, "look").alias("review_note"))
    return s, rules, cleanups, items


@query("g24_resolution")
def g24(spark, d):
    """Every segment after its rules and cleanup; tests hold it against a plain loop over the same inputs."""
    return R.resolved(*resolution_inputs(spark, d))


@query("n12_change_log")
def n12_log(spark, d):
    """A row for each rule that was applied, with the value before and after, in order."""
    return R.change_log(R.resolved(*resolution_inputs(spark, d)))


@query("n5_struct_sync", """SELECT o_orderkey, o_orderstatus AS status, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS fax, CASE WHEN o_orderkey % 5 <> 0 THEN o_comment_len END AS kept, CAST(c_nationkey AS VARCHAR) AS phone
  FROM (SELECT *, length(o_orderpriority) AS o_comment_len FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey""")
def n5(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey"), F.when(k % 5 != 0, F.struct(F.struct(F.lit("old").alias("name"), F.length("o_orderpriority").cast("long").alias("kept")).alias("who"), F.lit("old").alias("segment"))).alias("o"))
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", F.struct(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").cast("string").alias("phone")).alias("reach")).alias("who"), F.col("c_mktsegment").alias("segment")).alias("c"))
    done = S.synced(orders.join(known, "c_custkey", "left"), "o", "c", ["who.name", "segment", "who.reach.phone", "who.fax"])
    return done.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o.who.name").alias("name"), F.col("o.segment").alias("segment"), F.col("o.who.fax").alias("fax"), F.col("o.who.kept").alias("kept"), F.col("o.who.reach.phone").alias("phone"))


@query("n5_list_sync", """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 AS n, l_partkey FROM lineitem), s AS (SELECT n_nationkey AS n, n_name FROM nation)
  SELECT l_orderkey, string_agg(CASE WHEN n_name IS NULL THEN 'old' ELSE n_name END || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, n) AS items, count(*) AS n, count(*) FILTER (n_name IS NULL) AS unknown FROM l LEFT JOIN s USING (n) GROUP BY l_orderkey""")
def n5_list(spark, d):
    item = F.struct("l_linenumber", "l_partkey", (F.col("l_suppkey") % 50).cast("int").alias("n"), F.lit("old").alias("n_name"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    known = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n"), "n_name")
    done = S.synced_items(rows, "l_orderkey", "items", "n", known, ["n_name", "today"])
    said = F.array_join(F.transform("items", lambda x: F.concat(x["n_name"], F.lit(":"), x["l_partkey"].cast("string"))), ",")
    return done.select("l_orderkey", said.alias("items"), F.size("items").cast("long").alias("n"), F.size(F.filter("items", lambda x: x["n_name"] == "old")).cast("long").alias("unknown"))
