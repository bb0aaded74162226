"""Named tables in versions: checkpoints of runs, caches of answers, fitted weights.

A version is a Parquet folder that nothing else writes to, and a line of the manifest that is written after it. Readers go by the manifest alone, so
a version that was cut off while it was written is never seen, and one that was replaced can be read on. Versions of a name are numbered from 1; the
number, not a file's time, says which is newer. One process at a time writes to a name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "name string, version long, folder string, since long, facts map<string, string>, fields string"


class Store:
    """Versions of tables below one folder, which may lie in any store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list:
        """The manifest's lines of a name, oldest first; a line per version."""
        try:
            lines = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").where(F.col("name") == name).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(lines, key=lambda r: (r.version, r.folder))

    def put(self, rows: DataFrame, name: str, since: int | None = None, **facts: str) -> DataFrame:
        """Write the next version and read it back. ``since``: the first version whose rows it replaces in ``every`` (none: it adds to them)."""
        version = 1 + max((r.version for r in self._versions(name)), default=0)
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        line = (name, version, folder, version if since is None else since, facts, rows.schema.json())
        self.spark.createDataFrame([line], _MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return self._read(folder, rows.schema)

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def get(self, name: str, version: int | None = None) -> DataFrame | None:
        """The newest complete version, or a certain one; None if there is none."""
        lines = [r for r in self._versions(name) if version in (None, r.version)]
        return self._read(lines[-1].folder, T.StructType.fromJson(json.loads(lines[-1].fields))) if lines else None

    def facts(self, name: str) -> dict[str, str] | None:
        """What ``put`` was told about the newest version."""
        lines = self._versions(name)
        return dict(lines[-1].facts or {}) if lines else None

    def all_facts(self, name: str) -> list[dict[str, str]]:
        """The facts of all versions, oldest first."""
        return [dict(r.facts or {}) for r in self._versions(name)]

    def versions(self, name: str) -> list[int]:
        return [r.version for r in self._versions(name)]

    def every(self, name: str) -> DataFrame | None:
        """The rows of all versions that no later one replaces, with their ``_version``."""
        lines = self._versions(name)
        if not lines:
            return None
        valid = [r for k, r in enumerate(lines) if not any(x.since <= r.version for x in lines[k + 1 :])]
        parts = [self._read(r.folder, T.StructType.fromJson(json.loads(r.fields))).withColumn("_version", F.lit(r.version)) for r in valid]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def newest(self, name: str, *key: str) -> DataFrame | None:
        """Of every key the row of the newest version that has it; of several rows there, the greatest."""
        rows = self.every(name)
        if rows is None:
            return None
        rest = [c for c in rows.columns if c not in (*key, "_version")]
        last = rows.groupBy(*key).agg(F.max(F.struct("_version", *rest)).alias("_last"))
        return last.select(*key, *(F.col("_last")[c].alias(c) for c in rest))

    def compact(self, name: str, *key: str) -> DataFrame | None:
        """One version in place of all: each key's newest row. Readers see the old versions until it is complete."""
        lines, rows = self._versions(name), self.newest(name, *key)
        return None if rows is None else self.put(rows, name, since=lines[0].version)
