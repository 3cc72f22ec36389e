"""A versioned table: data folders by batch, and a manifest per version that names what is live.

A batch is staged in a folder of its own, which a repeated batch writes anew; nothing reads it until a commit. A commit
writes the next manifest beside its name and renames it, so a reader sees the old version or the new one, and a commit
that is killed leaves the old one. Each commit adds batches and deletes keys: a row is live unless a later commit deletes
its key, or the same one does and the row is older. Deletes are small tables of keys joined on reading; ``compact`` writes the live rows as one batch.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionedTable:
    """A table at ``path`` (a folder that all executors share) with rows of ``schema``, whose rows are replaced and deleted by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifests(self) -> list[int]:
        folder = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The newest version; 0 for a table without commits."""
        return max(self._manifests(), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """The commits up to a version, in order: ``added`` folders, ``deleted`` folder of keys or None, and ``batches``."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version}").first()[0]
        return json.loads(text)

    def stage(self, batch: int, rows: DataFrame) -> None:
        """Write a batch that no version names yet; the same batch replaces what it wrote before."""
        rows.write.mode("overwrite").parquet(f"{self.path}/staged/{batch}")

    def staged(self) -> list[int]:
        """Staged batches that no commit has named."""
        folder = self._path("staged")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        done = {b for commit in self.manifest() for b in commit["batches"]}
        return sorted(int(n) for n in names if n.isdigit() and int(n) not in done)

    def commit(self, batches: list[int], replace: bool = False, delete: DataFrame | None = None) -> int:
        """A new version with the staged ``batches``; ``replace`` deletes older rows of their keys, ``delete`` (with the key's column) those of its keys.

        Batches that are committed already are left out, and a commit of nothing makes no version.
        """
        commits = self.manifest()
        done = {b for commit in commits for b in commit["batches"]}
        batches = [b for b in batches if b not in done]
        if not batches and delete is None:
            return self.version()
        added = [f"staged/{b}" for b in batches]
        gone = [delete.select(self.key)] if delete is not None else []
        if replace and added:
            gone.append(self._read(added).select(self.key))
        deleted = None
        if gone:
            deleted = f"deleted/{uuid.uuid4().hex}"
            reduce(DataFrame.unionByName, gone).distinct().write.parquet(f"{self.path}/{deleted}")
        return self._publish([*commits, {"added": added, "deleted": deleted, "batches": batches}])

    def _publish(self, commits: list[dict]) -> int:
        version = self.version() + 1
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"manifests/{version}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(commits).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.path} was written by another job")
        return version

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows of a version, the newest if none is named."""
        commits = self.manifest(version)
        parts = [self._read(c["added"]).withColumn("_at", F.lit(i)) for i, c in enumerate(commits) if c["added"]]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, parts)
        gone = [self.spark.read.parquet(f"{self.path}/{c['deleted']}").select(self.key, F.lit(i).alias("_gone")) for i, c in enumerate(commits) if c["deleted"]]
        if gone:
            last = reduce(DataFrame.unionByName, gone).groupBy(F.col(self.key).alias("_key")).agg(F.max("_gone").alias("_gone"))
            rows = rows.join(last, F.col(self.key).eqNullSafe(F.col("_key")), "left").filter("_gone IS NULL OR _at >= _gone").select(*rows.columns)
        return rows.drop("_at")

    def compact(self) -> int:
        """A version whose live rows lie in one folder; older versions stay readable."""
        done = [b for commit in self.manifest() for b in commit["batches"]]
        folder = f"compacted/{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.path}/{folder}")
        return self._publish([{"added": [folder], "deleted": None, "batches": done}])
