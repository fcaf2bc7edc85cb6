"""A store of records by key: put, forget, erase, export; snapshots that a reader keeps while others write.

A store is a folder of Parquet segments and numbered manifests. A manifest lists the segments of one version,
oldest first, and is created, never changed: the highest number is the current version, and two writers
that want the same number can't both have it: the later one raises Conflict (where the file system's rename refuses a
taken name, as HDFS does, in every case; a local folder is asked first). A reader holds the version it
began with; its segments stay until `vacuum`.

- `put` adds records; of a key the last version counts. Repeated keys within one put: the greatest row counts.
- `forget` adds tombstones; the records stay in older segments until `compact`.
- `compact` writes the records of a version as one segment, without tombstones and what they hide.
- `erase` compacts without the given keys and then vacuums all older versions, so that nothing of them is left.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string


class Conflict(RuntimeError):
    """Another writer has made this version."""


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = _parse_datatype_string(schema)
        if key not in self.schema.names or {"_version", "_gone"} & set(self.schema.names):
            raise ValueError("the schema needs the key and has no columns _version and _gone")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ versions

    def _names(self, pattern: str) -> list[str]:
        folder = self._path(self.path)
        if not self._fs.exists(folder):
            return []
        return sorted(n for s in self._fs.listStatus(folder) if re.fullmatch(pattern, n := s.getPath().getName()))

    def versions(self) -> list[int]:
        return [int(n[9:-5]) for n in self._names(r"manifest-\d{12}\.json")]

    def _manifest(self, version: int):
        return self._path(f"{self.path}/manifest-{version:012d}.json")

    def _segments(self, version: int) -> list[str]:
        if version == 0:
            return []
        stream = self._fs.open(self._manifest(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        """The current version; 0 before the first write."""
        return max(self.versions(), default=0)

    def _commit(self, base: int, segments: list[str]) -> int:
        """Make base + 1, or raise Conflict if it exists. The manifest appears whole: it is written beside and renamed, which fails where the name is taken."""
        target, beside = self._manifest(base + 1), self._path(f"{self.path}/_{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        stream.write(json.dumps(segments).encode())
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(beside, target):
            self._fs.delete(beside, False)
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def _write(self, rows: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    # ------------------------------------------------------------ writing

    def _append(self, rows: DataFrame, gone: bool) -> int:
        base = self.version()
        segment = self._write(rows.withColumn("_version", F.lit(base + 1).cast("long")).withColumn("_gone", F.lit(gone)))
        return self._commit(base, [*self._segments(base), segment])

    def put(self, records: DataFrame) -> int:
        """Add or replace records (null keys are refused); the new version."""
        rows = records.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        checked = rows.withColumn(self.key, F.when(F.col(self.key).isNotNull(), F.col(self.key)).otherwise(F.raise_error(F.lit("a record without a key"))))
        return self._append(checked, False)

    def forget(self, keys: DataFrame) -> int:
        """Hide the records of these keys from the new version on."""
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
        return self._append(keys.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self.schema[self.key].dataType), *rest).select(*self.schema.names), True)

    def compact(self) -> int:
        """The same records as one segment."""
        base = self.version()
        if base == 0:
            return 0
        return self._commit(base, [self._write(self._latest(base).where("not _gone"))])

    def erase(self, keys: DataFrame) -> int:
        """Remove the records of these keys from all that is stored; older versions go with them."""
        base = self.version()
        gone = keys.select(F.col(self.key).cast(self.schema[self.key].dataType)).where(F.col(self.key).isNotNull()).distinct()
        version = self._commit(base, [self._write(self._latest(base).where("not _gone").join(gone, self.key, "left_anti").select(*self.schema.names, "_version", "_gone"))])
        self.vacuum(1)
        return version

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last `keep` versions, and segments that no kept one has (a reader of an older version fails)."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {s for v in kept for s in self._segments(v)}
        for v in versions[:-keep]:
            self._fs.delete(self._manifest(v), False)
        for name in self._names(r"segment-.*"):
            if name not in used:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)

    # ------------------------------------------------------------ reading

    def _latest(self, version: int) -> DataFrame:
        """The last row of every key, tombstones included: a grouped maximum, combined before it is shuffled."""
        schema = _parse_datatype_string(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema) + ", _version long, _gone boolean")
        segments = self._segments(version)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{s}" for s in segments]) if segments else self.spark.createDataFrame([], schema)
        rest = [n for n in self.schema.names if n != self.key]
        last = rows.groupBy(self.key).agg(F.max(F.struct("_version", "_gone", *rest)).alias("m"))
        return last.select(*[F.col(self.key) if n == self.key else F.col(f"m.{n}").alias(n) for n in self.schema.names], "m._version", "m._gone")

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a version (the current one): a fixed snapshot, whatever is written meanwhile."""
        return self._latest(self.version() if version is None else version).where("not _gone").select(*self.schema.names)

    def export(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The records of these keys, in key order."""
        return self.read(version).join(keys.select(self.key).distinct(), self.key, "left_semi").orderBy(self.key)
