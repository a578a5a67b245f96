"""Keyed state of a stream: Parquet tables dealt into hash buckets, with versions and a manifest.

A batch rewrites only the buckets that its keys fall into. Each version writes those buckets into a
folder of its own and then a manifest, which names for every table and bucket the version that holds
it; a version exists once its manifest is complete, for all tables at once. A batch that is replayed
starts from the manifest before it and writes the same version again. Buckets that the newest
``keep`` manifests no longer name are deleted, as are the manifests before them.

The number of buckets fixes how much a batch reads and writes: it is chosen once, so that a bucket
fits a task. Manifests have one row for each table and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The version of what is there before the first batch.
SEED = -1


class KeyedState:
    """Tables under ``path``; ``keys`` names the columns whose hash deals each table."""

    def __init__(self, path: str, keys: dict[str, tuple[str, ...]], schemas: dict[str, StructType],
                 buckets: int = 64, keep: int = 3):
        self.path, self.keys, self.schemas, self.buckets, self.keep = path, keys, schemas, buckets, max(1, keep)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int")

    def _fs(self, spark: SparkSession):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self, spark: SparkSession) -> list[int]:
        """Complete versions in rising order."""
        fs, at = self._fs(spark)
        root = at(f"{self.path}/manifest")
        if not fs.exists(root):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root)
                      if fs.exists(at(s.getPath(), "_SUCCESS")))

    def newest(self, spark: SparkSession, below: int | None = None) -> int | None:
        return max((v for v in self.versions(spark) if below is None or v < below), default=None)

    def manifest(self, spark: SparkSession, version: int | None) -> dict[tuple[str, int], int]:
        """(table, bucket) -> the version that holds it."""
        if version is None:
            return {}
        rows = spark.read.schema("name string, bucket int, holder bigint").parquet(
            f"{self.path}/manifest/version={version}").collect()
        return {(r["name"], r["bucket"]): r["holder"] for r in rows}

    def read(self, spark: SparkSession, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets, as of ``version`` (the newest)."""
        version = self.newest(spark) if version is None else version
        wanted = None if buckets is None else set(buckets)
        folders = [f"{self.path}/{name}/version={holder}/bucket={b}"
                   for (table, b), holder in sorted(self.manifest(spark, version).items())
                   if table == name and (wanted is None or b in wanted)]
        reader = spark.read.schema(self.schemas[name])
        return reader.parquet(*folders) if folders else spark.createDataFrame([], self.schemas[name])

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall into; at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())

    def commit(self, spark: SparkSession, version: int, before: int | None,
               changed: dict[str, tuple[DataFrame, list[int]]]) -> None:
        """``changed`` gives for some tables the full next rows of the named buckets."""
        held = self.manifest(spark, before)
        for name, (rows, touched) in changed.items():
            folder = f"{self.path}/{name}/version={version}"
            columns = self.schemas[name].names
            rows.select(*columns, self.bucket(name).alias("bucket")).repartition("bucket").write.mode(
                "overwrite").partitionBy("bucket").parquet(folder)
            fs, at = self._fs(spark)
            there = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at(folder)) if s.isDirectory()}
            held = {k: v for k, v in held.items() if k[0] != name or k[1] not in touched}
            held |= {(name, b): version for b in touched if b in there}
        rows = [(name, b, holder) for (name, b), holder in sorted(held.items())]
        spark.createDataFrame(rows, "name string, bucket int, holder bigint").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/manifest/version={version}")
        self.prune(spark)

    def prune(self, spark: SparkSession) -> None:
        """Delete what the newest ``keep`` versions do not need. The previous version always stays, as a replay needs it."""
        kept = self.versions(spark)[-max(2, self.keep):]
        if not kept:
            return
        needed = {(name, holder, b) for v in kept for (name, b), holder in self.manifest(spark, v).items()}
        fs, at = self._fs(spark)
        for name in self.keys:
            root = at(f"{self.path}/{name}")
            for folder in fs.listStatus(root) if fs.exists(root) else []:
                version = int(folder.getPath().getName().split("=")[1])
                if version > kept[-1]:
                    continue
                inside = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.isDirectory()]
                stale = [p for p in inside if (name, version, int(p.getName().split("=")[1])) not in needed]
                if len(stale) == len(inside):
                    fs.delete(folder.getPath(), True)
                else:
                    for p in stale:
                        fs.delete(p, True)
        for version in self.versions(spark):
            if version < kept[0]:
                fs.delete(at(f"{self.path}/manifest/version={version}"), True)
