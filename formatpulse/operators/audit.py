"""Counts of a run's stages, observed while its rows pass, kept as an audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

AUDIT = "run bigint, stage string, metric string, value string"


class Audit:
    """Watches frames of one run. Metrics are gathered by the action that reads a frame first, without a pass of their own."""

    def __init__(self, run: int):
        self.run, self.watched, self.said = run, [], []

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``df``, observed: its rows and the named aggregates."""
        seen = Observation()
        self.watched.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in metrics.items()])

    def say(self, stage: str, **values) -> None:
        """Facts that are known without rows."""
        self.said += [(self.run, stage, k, None if v is None else str(v)) for k, v in values.items()]

    def rows(self, spark: SparkSession) -> DataFrame:
        """(run, stage, metric, value), once every watched frame has been read by an action."""
        seen = [(self.run, stage, k, None if v is None else str(v)) for stage, o in self.watched for k, v in o.get.items()]
        return spark.createDataFrame(seen + self.said, AUDIT)

    def append(self, spark: SparkSession, path: str) -> DataFrame:
        """Write this run's rows beside those of other runs; a repeated run replaces its own."""
        self.rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={self.run}")
        return read_audit(spark, path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).option("recursiveFileLookup", "true").parquet(path)
