"""Gold tables: versioned trends and members, appended snapshots, a commit marker last.

A rebuild writes its own folders and becomes current only when its marker is complete, so
a lost executor or driver leaves the previous version readable, and repeating a run
rewrites only its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_gold(
    trends: DataFrame, members: DataFrame, snapshots: DataFrame, path: str, run: int
) -> None:
    """Trends and members of ``run`` replace the previous ones; snapshots accumulate."""
    trends.write.mode("overwrite").parquet(f"{path}/trends/run={run}")
    members.write.mode("overwrite").parquet(f"{path}/members/run={run}")
    snapshots.write.mode("overwrite").parquet(f"{path}/snapshots/run={run}")
    marker = trends.sparkSession.range(1).select(F.lit(run).cast("bigint").alias("committed"))
    marker.write.mode("overwrite").parquet(f"{path}/commits/marker={run}")


def current_run(spark: SparkSession, path: str) -> int | None:
    """The newest run whose marker is complete."""
    if not _exists(spark, f"{path}/commits"):
        return None
    return spark.read.schema("committed bigint").parquet(f"{path}/commits/*").agg(
        F.max("committed")).first()[0]


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(trends, members, all committed snapshots) of the current run."""
    run = current_run(spark, path)
    if run is None:
        return None
    done = spark.read.schema("committed bigint").parquet(f"{path}/commits/*").withColumnRenamed(
        "committed", "run")
    snapshots = spark.read.parquet(f"{path}/snapshots").join(
        F.broadcast(done), "run", "left_semi")  # one row per rebuild
    return (
        spark.read.parquet(f"{path}/trends/run={run}"),
        spark.read.parquet(f"{path}/members/run={run}"),
        snapshots.drop("run"),
    )
