"""A Merkle manifest of a data set: a tree a group of rows, and a tree over the groups' roots.

Leaves are digests of rows, made in Spark expressions; texts are read once and never shuffled. Leaves are range-partitioned
by (group, order) and counted, which gives each its place in its group. Every task then builds a mountain range over the
run of places it holds: leaves are pushed on a stack, and as in counting to the base FANOUT, FANOUT neighbours whose
places begin at a multiple of it carry over into one node a level up. What no carry can reach goes out as a peak: the
ragged ends of a run, whose neighbours are in other tasks, and the short runs at a group's end. Of the inner nodes only
those at every LEVELS-th level go out, as records that proofs are made from.

Peaks are merged LEVELS levels at a time by (group, place): at most FANOUT ** LEVELS nodes meet in one place, however large
the group is. A run that is short at the end of its group is hashed as it is, without padding. Proofs go the other way:
the path above a block of FANOUT ** LEVELS nodes is made once and handed to the blocks below it.

Defined cases: a null value is its own mark, so a null text differs from an empty one; rows of equal order stand by their
digests, so equal rows change places freely; a null order comes first; a null group is a group of its own and comes first;
a null doc_id is never tampered with; a lone leaf is its group's root, a lone group's root the root of all; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, docs_table, partitions, written

FANOUT = 3
#: Levels that one merging takes at a time.
LEVELS = 4
BLOCK = FANOUT**LEVELS
#: monotonically_increasing_id() counts within a partition below this bit.
_COUNTER = (1 << 33) - 1
#: Rows of an outgoing batch.
BATCH = 2000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def row_digest(*columns: Column) -> Column:
    """The digest of a row's values: each as its byte count and itself, a mark where there is none."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def group_key(column: Column) -> Column:
    """A group's name such that null and empty differ, null first, in bytewise order."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= BATCH:
            yield _emit(held, schema)
            held = []
    if held:
        yield _emit(held, schema)


class Mountains:
    """The stack of one run of places: per level the nodes that still wait for a neighbour to their right."""

    def __init__(self, start: int):
        self.levels: list[tuple[int, list[str]]] = [(start, [])]

    def push(self, digests: list[str]) -> Iterator[tuple[int, int, str, bool]]:
        """Adds leaves and carries. Yields (level, place, digest, open): nodes that cannot carry in this run, and records."""
        new, level = digests, 0
        while new:
            first, nodes = self.levels[level]
            nodes = nodes + new
            ragged = min(-first % FANOUT, len(nodes))  # their left neighbours are not in this run
            for k in range(ragged):
                yield level, first + k, nodes[k], True
            first, nodes = first + ragged, nodes[ragged:]
            full = len(nodes) - len(nodes) % FANOUT
            if level and level % LEVELS == 0:
                for k in range(full):
                    yield level, first + k, nodes[k], False
            new = [digest("".join(nodes[k : k + FANOUT])) for k in range(0, full, FANOUT)]
            if new and level + 1 == len(self.levels):
                self.levels.append((first // FANOUT, []))
            self.levels[level] = (first + full, nodes[full:])
            level += 1

    def peaks(self) -> Iterator[tuple[int, int, str, bool]]:
        for level, (first, nodes) in enumerate(self.levels):
            for k, node in enumerate(nodes):
                yield level, first + k, node, True


_NODES = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("open", pa.bool_())])
_NODES_DDL = "tree string, level int, place long, digest string, open boolean"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, place, digest) in order: a mountain range for each unbroken run of places."""

    def nodes() -> Iterator[tuple]:
        tree, follows, stack = None, -1, None
        for b in batches:
            trees, places, digests = (b.column(c).to_pylist() for c in ("tree", "place", "digest"))
            at = 0
            for k in range(len(trees) + 1):
                broken = k < len(trees) and (trees[k] != tree or places[k] != follows)
                if broken or k == len(trees):
                    if stack and k > at:
                        yield from ((tree, *n) for n in stack.push(digests[at:k]))
                    at = k
                if broken:
                    if stack:
                        yield from ((tree, *n) for n in stack.peaks())
                    tree, stack = trees[k], Mountains(places[k])
                if k < len(trees):
                    follows = places[k] + 1
        if stack:
            yield from ((tree, *n) for n in stack.peaks())

    return _batched(nodes(), _NODES)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (tree, block), which come one after the other."""
    key, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["tree"], r["block"]) != key:
                if held:
                    yield held
                key, held = (r["tree"], r["block"]), []
            held.append(r)
    if held:
        yield held


def _up(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[k : k + FANOUT])) for k in range(0, len(nodes), FANOUT)]


def _merge(step: int) -> Callable:
    """Merges peaks of levels below the top of the step, block by block."""
    low, top = step * LEVELS, (step + 1) * LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator[tuple]:
            for rows in _groups(batches):
                end = height(rows[0]["n"])
                # peaks and what is made of those below them, level by level
                at = {}
                for r in rows:
                    at.setdefault(r["level"], {})[r["place"]] = r["digest"]
                for level in range(low, min(top, end)):
                    families: dict[int, list[str]] = {}
                    for place in sorted(at.get(level, {})):
                        families.setdefault(place // FANOUT, []).append(at[level][place])
                    at.setdefault(level + 1, {}).update((k, digest("".join(f))) for k, f in families.items())
                level = min(top, max(end, low))
                ((place, node),) = at[level].items()
                yield rows[0]["tree"], level, place, node, rows[0]["n"], level == end

        return _batched(merged(), _MERGED)

    return run


_MERGED = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("done", pa.bool_())])
_MERGED_DDL = "tree string, level int, place long, digest string, n long, done boolean"


@dataclass
class Forest:
    """Trees over leaves. placed: the leaves with tree, n and place; records: from the second step on, the nodes that it starts from; roots: tree, n, root."""

    placed: DataFrame
    steps: int
    records: list[DataFrame]
    roots: DataFrame
    tables: list[DataFrame]


def forest(leaves: DataFrame, *order: str) -> Forest:
    """leaves: tree (not null), digest, and what they carry; places within a tree ascend by the order columns, then digest."""
    spark = leaves.sparkSession
    raw = written(leaves.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    keys = ["tree", *order, "digest", "uid"]  # uid parts equal rows, so that no number of them need share a task
    sorted_ = raw.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("uid")
    ranked = written(sorted_.withColumn("part", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id().bitwiseAND(F.lit(_COUNTER))), "merkle-ranked")
    discard(raw)
    # rows: one for each tree, and one more for each partition at most
    runs = ranked.groupBy("tree", "part").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(runs.select("tree", "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(Window.partitionBy("tree")).alias("n")), "merkle-runs")
    placed = ranked.join(shifts, ["tree", "part"]).withColumn("place", F.col("number") + F.col("shift")).drop("part", "number", "shift")
    sizes = shifts.groupBy("tree").agg(F.max("n").alias("n"))
    stack = written(placed.select("tree", "place", "digest").sortWithinPartitions("tree", "place").mapInArrow(_ranges, _NODES_DDL), "merkle-nodes")
    steps = height(shifts.agg(F.max("n")).first()[0] or 1) // LEVELS + 1
    tables, records, roots, tops = [ranked, shifts, stack], [], [], None
    for step in range(steps):
        low, top = step * LEVELS, (step + 1) * LEVELS
        peaks = stack.where(F.col("open") & F.col("level").between(low, top - 1)).join(sizes, "tree").select("tree", "level", "place", "digest", "n")
        if tops is not None:
            peaks = peaks.unionByName(tops.select("tree", "level", "place", "digest", "n"))
        block = F.expr(f"place div cast(pow({FANOUT}, {top} - level) as bigint)")
        dealt = peaks.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "level", "place")
        merged = written(dealt.mapInArrow(_merge(step), _MERGED_DDL), "merkle-merged")
        tables.append(merged)
        roots.append(merged.where("done").select("tree", "n", F.col("digest").alias("root")))
        tops = merged.where("NOT done")
        records.append(stack.where(F.col("level") == top).select("tree", "place", "digest").unionByName(tops.select("tree", "place", "digest")))
    all_roots = roots[0]
    for r in roots[1:]:
        all_roots = all_roots.unionByName(r)
    return Forest(placed, steps, [placed, *records[:-1]], all_roots, tables)


def _paths(step: int, carried: tuple[str, ...], finish: Callable[[str, dict], tuple], schema: pa.Schema) -> Callable:
    """Goes down a step: of each block, its path (the first row) and its nodes, to a path for each node.

    A path is a line for each level from the bottom: the digests left of the node, a bar, those right of it.
    """
    low, top = step * LEVELS, (step + 1) * LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def down() -> Iterator[tuple]:
            for rows in _groups(batches):
                head, *nodes = rows
                if head["kind"] or not nodes:  # a root at the bottom of this step: it got its path above
                    continue
                levels = [[r["digest"] for r in nodes]]
                for _ in range(low, min(top, height(head["n"]))):
                    levels.append(_up(levels[-1]))
                paths = [head["path"]]
                for level in reversed(levels[:-1]):
                    over, paths = paths, []
                    for k in range(len(level)):
                        family = k - k % FANOUT
                        line = "".join(level[family:k]) + "|" + "".join(level[k + 1 : family + FANOUT])
                        above = over[k // FANOUT]
                        paths.append(f"{line}\n{above}" if above else line)
                for r, path in zip(nodes, paths):
                    yield (*(r[c] for c in carried), *finish(path, head | {"digest": r["digest"], "shown": r.get("shown")}))

        return _batched(down(), schema)

    return run


_PATH = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("root", pa.string()), ("path", pa.string())])
_PATH_DDL = "tree string, block long, n long, root string, path string"


def descend(f: Forest, above: DataFrame, carried: dict[str, str], finish: Callable[[str, dict], tuple], made: dict[str, str]) -> DataFrame:
    """A row for each leaf: its carried columns and what finish makes of its path and its block.

    above: tree and the path from its root on ("" where the root is the end).
    """
    starts = f.roots.join(above, "tree").withColumn("step", sum(((F.col("n") > F.lit(FANOUT ** (k * LEVELS))).cast("int") for k in range(1, f.steps)), F.lit(0)))
    starts = written(starts, "merkle-starts")
    f.tables.append(starts)
    arrow = {"string": pa.string(), "long": pa.int64()}
    deeper = None
    for step in reversed(range(f.steps)):
        heads = starts.where(F.col("step") == step).select("tree", F.lit(0).cast("long").alias("block"), "n", "root", "path")
        if deeper is not None:
            heads = heads.unionByName(deeper)
        last = step == 0
        columns = [*carried, "shown"] if last and "shown" in f.placed.columns else [*carried] if last else []
        nodes = f.records[step].select("tree", F.expr(f"place div {BLOCK}").alias("block"), "place", "digest", F.lit(1).alias("kind"), *columns)
        both = heads.withColumn("kind", F.lit(0)).unionByName(nodes, allowMissingColumns=True)
        dealt = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "place")
        if last:
            out = carried | made
            return dealt.mapInArrow(_paths(0, tuple(carried), finish, pa.schema([(c, arrow[t]) for c, t in out.items()])), ", ".join(f"`{c}` {t}" for c, t in out.items()))
        deeper = written(dealt.mapInArrow(_paths(step, ("tree", "place"), lambda path, head: (head["n"], head["root"], path), _PATH), _PATH_DDL), "merkle-paths")
        f.tables.append(deeper)
    raise AssertionError("a forest has a step")


def fold(node: str, path: str) -> str:
    """The root that a node and its siblings make."""
    for line in path.split("\n") if path else []:
        left, right = line.split("|")
        node = digest(left + node + right)
    return node


def proof_digest(path: str) -> str:
    """The digest of all siblings in a path, from the bottom up and from left to right."""
    return digest(path.replace("|", "").replace("\n", ""))


def _proof(path: str, row: dict) -> tuple:
    shown = row["shown"] or row["digest"]
    return row["digest"], row["root"], proof_digest(path), fold(shown, path)


def proofs(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves: doc_id, tree, digest, shown (the digest that is offered in its place, or null), and the order columns.

    doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each: whether what is shown folds to the root.
    """
    trees = forest(leaves, *order)
    over = forest(trees.roots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("name")), "name")
    root = over.roots.first()
    nothing = over.roots.select("tree", F.lit("").alias("path"))
    above = written(descend(over, nothing, {"name": "string"}, lambda path, _: (path,), {"path": "string"}).withColumnRenamed("name", "tree"), "merkle-above")
    for t in over.tables:
        discard(t)
    out = descend(trees, above, {"doc_id": "long"}, _proof, {"leaf": "string", "subroot": "string", "proof_sha256": "string", "folded_root": "string"})
    whole = F.lit(root["root"] if root else None).cast("string")
    return out.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of a documents table, a tree a source. Where ``tampered``, the text is shown without its line breaks."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    shown = F.when(tampered & F.col("text").contains("\n"), row_digest(*fields, F.translate("text", "\n", "")))
    return plain.select("doc_id", group_key(F.col("source")).alias("tree"), row_digest(*fields, F.col("text")).alias("digest"), shown.alias("shown"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return proofs(document_leaves(docs_table(spark, sf_dir), tampered), "doc_id")


_FIELDS = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"

OP11_SQL = f"""
WITH RECURSIVE
bits AS (SELECT doc_id, source, {_FIELDS} || {_TEXT.format("text")} AS whole, {_FIELDS} || {_TEXT.format("replace(text, chr(10), '')")} AS cut,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::BIGINT)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc
  FROM documents),
leaves AS (SELECT doc_id, source, sha256(whole) AS leaf, CASE WHEN crc % 2 = 1 THEN sha256(cut) ELSE sha256(whole) END AS shown FROM bits),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
nodes AS (
  SELECT 0 AS level, source, place, leaf AS node, count(*) OVER (PARTITION BY source) AS wide FROM placed
  UNION ALL
  SELECT level + 1, source, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(wide) + 2) // 3
  FROM nodes WHERE wide > 1 GROUP BY level, source, place // 3),
subroots AS (SELECT source, node AS subroot, level AS tall FROM nodes WHERE wide = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS rank FROM subroots),
tops AS (
  SELECT 0 AS level, rank AS place, subroot AS node, count(*) OVER () AS wide FROM ranked
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(wide) + 2) // 3
  FROM tops WHERE wide > 1 GROUP BY level, place // 3),
sides AS (
  SELECT 0 AS part, n.level, n.source, n.place, coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < n.place), '') AS l, coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > n.place), '') AS r
  FROM nodes n JOIN nodes s ON s.level = n.level AND s.source IS NOT DISTINCT FROM n.source AND s.place // 3 = n.place // 3 WHERE n.wide > 1 GROUP BY ALL
  UNION ALL
  SELECT 1, n.level, NULL, n.place, coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < n.place), ''), coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > n.place), '')
  FROM tops n JOIN tops s ON s.level = n.level AND s.place // 3 = n.place // 3 WHERE n.wide > 1 GROUP BY ALL),
folds AS (
  SELECT p.doc_id, p.source, p.place AS id, 0 AS part, 0 AS level, p.place, r.tall, r.rank, p.shown AS node, '' AS siblings
  FROM placed p JOIN ranked r ON r.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT f.doc_id, f.source, f.id, CASE WHEN f.part = 0 AND f.level = f.tall THEN 1 ELSE f.part END, CASE WHEN f.part = 0 AND f.level = f.tall THEN 0 ELSE f.level + 1 END,
         CASE WHEN f.part = 0 AND f.level = f.tall THEN f.rank ELSE f.place // 3 END, f.tall, f.rank,
         CASE WHEN f.part = 0 AND f.level = f.tall THEN f.node ELSE sha256(s.l || f.node || s.r) END, f.siblings || coalesce(s.l, '') || coalesce(s.r, '')
  FROM folds f LEFT JOIN sides s ON s.part = f.part AND s.level = f.level AND s.place = f.place AND (f.part = 1 OR s.source IS NOT DISTINCT FROM f.source)
  WHERE (f.part = 0 AND f.level = f.tall) OR s.level IS NOT NULL),
ends AS (SELECT * FROM folds WHERE part = 1 AND level = (SELECT max(level) FROM tops))
SELECT p.doc_id, p.leaf, s.subroot, t.node AS root, sha256(e.siblings) AS proof_sha256, e.node AS folded_root, e.node = t.node AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN ends e ON e.id = p.place AND e.source IS NOT DISTINCT FROM p.source
JOIN tops t ON t.wide = 1
"""
