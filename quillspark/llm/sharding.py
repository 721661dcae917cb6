"""Sharding by size-tiered compaction, with DataFrame operations and exclusive creation of small files.

Arrivals are appended as small immutable shards, one write task to a shard. A manifest, itself a Parquet table, lists the
live shards of a version. Compaction groups shards of similar size (one tier: sizes within a factor of FAN) until a group
reaches the target size, rewrites each group as one file, and commits the next version. The version's file, which names
the manifest and the schema, is written whole under another name and then published where none exists, in one step that
only one writer can win: a hard link on a local file system, a rename without overwriting on HDFS, an exclusive creation
on stores that show a file only once it is complete. So a writer that dies leaves nothing that counts or is in the way;
a version file without content is no version, and is replaced. Shards of older versions stay readable until ``vacuum`` is
told how many versions to keep; it takes their manifests too, and what failed attempts left long enough ago.

Defined cases: null and empty texts and null ids are rows like any other; rows that repeat are all kept; columns are
stored as they are, whatever their names, but names that differ by case alone are one column, by its first spelling, and
an arrival that has two of them is refused; arrivals may bring new columns, which older rows have as null, but not another
type for a known one; an empty arrival adds no rows; an empty store has version 0, without shards or columns.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm.common import docs_table, filesystem, shared_dir

#: Size of a finished shard, and of one row group of arrivals.
TARGET_BYTES = 16 << 20
ARRIVAL_ROWS = 2_000
FAN = 4
#: Shards that are numbered together when groups are planned, and groups that one round merges; the rest is for the next.
PLAN_SHARDS, ROUND_GROUPS = 50_000, 10_000
#: Shards that one round merges, as their names go through the driver (one group at least).
ROUND_SHARDS = 50_000
#: What no version names is taken for left over once it is that old, in hours.
GRACE_HOURS = 24.0

_MANIFEST = "shard string, bytes long, rows long, tier int"


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


def free_name(name: str, schema: StructType) -> str:
    """name, with underscores until no column of the schema is called so."""
    taken = {c.lower() for c in schema.names}
    while name.lower() in taken:
        name += "_"
    return name


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes

    # versions

    def _path(self, version: int) -> str:
        return f"{self.root}/versions/v{version:08d}"

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        fs, p = filesystem(self.spark, f"{self.root}/versions")
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("v") and f.getLen() > 0)

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def _entry(self, version: int) -> dict:
        """What the version's file says: its manifest and schema."""
        fs, p = filesystem(self.spark, self._path(version))
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def state(self, version: int | None = None) -> tuple[int, StructType, DataFrame]:
        """(version, schema, manifest) of one version: read at once, so that a commit in between mixes nothing."""
        version = self.version() if version is None else version
        if not version:
            return 0, StructType([]), self.spark.createDataFrame([], _MANIFEST)
        entry = self._entry(version)
        return version, StructType.fromJson(entry["schema"]), self.spark.read.schema(_MANIFEST).parquet(entry["manifest"])

    def schema(self, version: int | None = None) -> StructType:
        return self.state(version)[1]

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.state(version)[2]

    def _publish(self, content: bytes, target: str) -> bool:
        """Makes content the file at target, whole, if there is none yet; False if there is one."""
        jvm = self.spark.sparkContext._jvm
        fs, p = filesystem(self.spark, target)
        scheme = fs.getUri().getScheme()
        if scheme in ("file", "hdfs", "viewfs") and fs.exists(p) and fs.getFileStatus(p).getLen() == 0:
            fs.delete(p, False)  # left by a writer that died; here a live one never shows an empty file
        own = scheme in ("file", "hdfs", "viewfs")
        _, draft = filesystem(self.spark, f"{target.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}") if own else (fs, p)
        try:
            stream = fs.create(draft, False)
            stream.write(content)
            stream.close()
            if scheme == "file":
                at = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(at(p), at(draft))
            elif own:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, p, none)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        finally:
            if own and fs.exists(draft):
                fs.delete(draft, False)
        return True

    def commit(self, manifest: DataFrame, version: int, schema: StructType | None = None) -> None:
        """Writes the manifest, then publishes the version's file; that fails where the version exists."""
        folder = f"{self.root}/manifests/{uuid.uuid4().hex}"
        manifest.select("shard", "bytes", "rows", "tier").write.parquet(folder)
        entry = {"manifest": folder, "schema": (self.schema() if schema is None else schema).jsonValue()}
        if not self._publish(json.dumps(entry).encode(), self._path(version)):
            raise CommitConflict(self._path(version))

    def vacuum(self, keep: int = 2, grace_hours: float = GRACE_HOURS) -> int:
        """Deletes what only versions before the last ``keep`` name: those versions, their shards and manifests; and folders
        and drafts that no version names, once they are older than the grace. Returns how many shards of old versions went.

        A folder without a shard in use goes at once; of others, shards go one by one.
        """
        versions = self.versions()
        old, live = versions[:-keep], versions[-keep:]
        entries = {v: self._entry(v)["manifest"] for v in versions}
        named = lambda some: self.spark.read.schema(_MANIFEST).parquet(*[entries[v] for v in some]).select("shard").distinct()
        folder = F.regexp_extract("shard", "([^/]+)/[^/]+$", 1)
        used = {r[0] for r in named(live).select(folder).distinct().toLocalIterator()} if live else set()  # one an append or compaction
        gone = 0
        if old:
            dead = named(old).join(named(live), "shard", "left_anti").select("shard", folder.alias("folder"))
            apart = [r["shard"] for r in dead.where(F.col("folder").isin(*used)).select("shard").toLocalIterator()]
            whole = [(r["folder"], r["n"]) for r in dead.where(~F.col("folder").isin(*used)).groupBy("folder").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
            gone = len(apart) + sum(n for _, n in whole)
            for v in old:  # a version goes before its shards, so that none is read in part
                self._delete(self._path(v))
            for path in [*apart, *[f"{self.root}/data/{f}" for f, _ in whole], *[entries[v] for v in old]]:
                self._delete(path)
        kept = {entries[v].rsplit("/", 1)[-1] for v in live} | used
        before = time.time() * 1000 - grace_hours * 3_600_000
        for place in ("data", "manifests", "versions"):
            fs, p = filesystem(self.spark, f"{self.root}/{place}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                name = f.getPath().getName()
                if f.getModificationTime() < before and (name.startswith("_draft-") if place == "versions" else name not in kept):
                    fs.delete(f.getPath(), True)
        return gone

    def _delete(self, path: str) -> None:
        fs, p = filesystem(self.spark, path)
        fs.delete(p, True)

    # shards

    def _listed(self, folder: str) -> DataFrame:
        """The files that Spark wrote to folder, with their sizes and rows; only footers are read."""
        data = self.spark.read.schema("_none int").parquet(folder)
        meta = data.metadataColumn("_metadata")
        files = data.select(meta.getField("file_path").alias("shard"), meta.getField("file_size").alias("bytes"))
        return self._tiered(files.groupBy("shard", "bytes").agg(F.count(F.lit(1)).alias("rows")))

    def _tiered(self, shards: DataFrame) -> DataFrame:
        tier = F.floor(F.log(F.greatest(F.col("bytes") / F.lit(self.target / FAN**4), F.lit(1.0))) / F.log(F.lit(float(FAN))))
        return shards.select("shard", F.col("bytes").cast("long"), F.col("rows").cast("long"), tier.cast("int").alias("tier"))

    def append(self, arrivals: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Adds arrivals as small shards, without a shuffle; returns the version that lists them."""
        version, schema, manifest = self.state()
        known = {f.name.lower(): f for f in schema}
        if len({n.lower() for n in arrivals.columns}) < len(arrivals.columns):
            raise ValueError(f"columns that differ by case alone: {arrivals.columns}")
        arrivals = arrivals.toDF(*[known[n.lower()].name if n.lower() in known else n for n in arrivals.columns])
        if other := [f.name for f in arrivals.schema if f.name.lower() in known and known[f.name.lower()].dataType != f.dataType]:
            raise ValueError(f"columns with another type than in the store: {other}")
        schema = StructType(list(schema) + [f for f in arrivals.schema if f.name.lower() not in known])
        folder = f"{self.root}/data/a{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        arrivals.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(folder)
        self.commit(manifest.unionByName(self._listed(folder)), version + 1, schema)
        return version + 1

    def plan(self, manifest: DataFrame) -> DataFrame:
        """shard, rows, group: shards of one tier in order of name, cut where the running size passes the target. Groups of one
        stay as they are. Shards are numbered in parts of about PLAN_SHARDS; only the parts' totals meet in one task."""
        parts = math.ceil(max(manifest.count(), 1) / PLAN_SHARDS)
        open_ = manifest.where(F.col("bytes") < self.target / 2).withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts)))
        run = Window.partitionBy("tier", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        cut = open_.withColumn("slot", F.floor(F.coalesce(F.sum("bytes").over(run), F.lit(0)) / F.lit(self.target)))
        sized = cut.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tier", "part", "slot"))).where("n > 1")
        place = F.dense_rank().over(Window.partitionBy("tier", "part").orderBy("slot"))
        placed = sized.select("shard", "rows", "tier", "part", place.alias("place"))
        before = Window.orderBy("tier", "part").rowsBetween(Window.unboundedPreceding, -1)
        totals = placed.groupBy("tier", "part").agg(F.max("place").alias("last")).select("tier", "part", F.coalesce(F.sum("last").over(before), F.lit(0)).alias("first"))
        return placed.join(totals, ["tier", "part"]).select("shard", "rows", (F.col("first") + F.col("place") - 1).cast("int").alias("group"))

    def compact(self) -> bool:
        """One round: merges the groups, at most ROUND_GROUPS of ROUND_SHARDS together, and commits. False where there was nothing to merge."""
        version, schema, manifest = self.state()
        plan = self.plan(manifest).where(F.col("group") < ROUND_GROUPS)
        sized = plan.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.sum("n").over(Window.orderBy("group")))  # ROUND_GROUPS rows at most
        last = sized.agg(F.max(F.when((F.col("run") <= ROUND_SHARDS) | (F.col("group") == 0), F.col("group")))).first()[0]
        plan = plan.where(F.col("group") <= F.lit(last))
        total = plan.agg(F.max("group").alias("last"), F.sum("rows").alias("rows")).first()
        if total["last"] is None:
            return False
        old = [r["shard"] for r in plan.select("shard").collect()]  # names of files, of ROUND_GROUPS groups at most
        folder = f"{self.root}/data/c{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        shard, group = free_name("_shard", schema), free_name("_group", schema)
        data = self.spark.read.schema(schema).parquet(*old)
        keyed = data.select("*", data.metadataColumn("_metadata").getField("file_path").alias(shard)).join(plan.select(F.col("shard").alias(shard), F.col("group").alias(group)), shard)
        keyed.repartitionById(total["last"] + 1, F.col(group)).drop(group, shard).write.option("compression", "zstd").parquet(folder)
        merged = self._listed(folder)
        if (n := merged.agg(F.sum("rows")).first()[0] or 0) != total["rows"]:
            raise RuntimeError(f"merged shards have {n} rows, their sources {total['rows']}")
        kept = manifest.join(plan.select("shard"), "shard", "left_anti")
        self.commit(kept.select("shard", "bytes", "rows", "tier").unionByName(merged), version + 1, schema)
        return True

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; shard names a column to add, with the shard that each row stands in."""
        version, schema, manifest = self.state(version)
        names = [r["shard"] for r in manifest.select("shard").collect()]  # as many as Spark lists for any table of as many files
        if shard is not None and free_name(shard, schema) != shard:
            raise ValueError(f"the store has a column {shard}")
        if not names:
            rows = self.spark.createDataFrame([], schema)
            return rows if shard is None else rows.withColumn(shard, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*names)
        return rows if shard is None else rows.select("*", rows.metadataColumn("_metadata").getField("file_path").alias(shard))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the shard of the compacted store it stands in."""
    store = ShardStore(spark, f"{shared_dir(spark)}/quill-shards-{uuid.uuid4().hex[:12]}")
    store.append(docs_table(spark, sf_dir))
    while store.compact():
        store.vacuum()
    shard = free_name("_shard", store.schema())
    rows = store.read(shard=shard).select("doc_id", F.col(shard).alias("_shard")).join(store.manifest().withColumnRenamed("shard", "_shard"), "_shard")
    name = F.element_at(F.split("_shard", "/"), -1)
    return rows.select("doc_id", name.alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.lit(store.version()).cast("long").alias("version"))
