"""A table in versions: each is written whole beside the others, and counts once its small file is published.

The file of a version names its data and schema. It is written under another name and published in one step that only one
writer can win: a hard link on a local file system, a rename without overwriting on HDFS, an exclusive creation elsewhere.
So readers see a version whole or not at all, a writer that dies leaves the last version as it was, and of two writers that
started from one version, one is told so.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionConflict(RuntimeError):
    """Another writer published this version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _name(self, version: int) -> str:
        return f"{self.root}/versions/v{version:08d}"

    def versions(self) -> list[int]:
        fs, p = self._file(f"{self.root}/versions")
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted(int(f.getPath().getName()[1:]) for f in found if f.getPath().getName().startswith("v") and f.getLen() > 0)

    def version(self) -> int:
        """The newest version; 0 where there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            raise ValueError(f"{self.root} has no version yet")
        fs, p = self._file(self._name(version))
        stream = fs.open(p)
        try:
            entry = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["data"])

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """df as the version after the one it was made from (the newest, if none is named); returns its number."""
        version = (self.version() if after is None else after) + 1
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(data)
        if not self._published(json.dumps({"data": data, "schema": df.schema.jsonValue()}).encode(), self._name(version)):
            raise VersionConflict(self._name(version))
        return version

    def _published(self, content: bytes, target: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        fs, p = self._file(target)
        scheme = fs.getUri().getScheme()
        renames = scheme in ("file", "hdfs", "viewfs")
        draft = self._file(f"{self.root}/versions/_draft-{uuid.uuid4().hex}")[1] if renames else p
        if renames and fs.exists(p) and fs.getFileStatus(p).getLen() == 0:
            fs.delete(p, False)  # no writer shows an empty file here: it was left by something else
        try:
            stream = fs.create(draft, False)
            stream.write(content)
            stream.close()
            if scheme == "file":
                at = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(at(p), at(draft))
            elif renames:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, p, none)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        finally:
            if renames and fs.exists(draft):
                fs.delete(draft, False)
        return True
