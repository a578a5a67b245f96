"""Session defaults and the one rule for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Rows that a task of a dealt table holds, about.
TASK_ROWS = 100_000


def build_session(app: str = "formatpulse", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Every operator reasons in UTC; landed timestamps carry no zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. A scratch one stands in on a local master only, as
    executors elsewhere would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a shared folder for master {master}")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Iterative operators call this once per round, so a lost executor replays one round
    and the plan never grows with the number of rounds.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str = "stored") -> DataFrame:
    """The same for wide rows that several passes read: a columnar table on the shared
    storage, so each pass reads only its columns and the planner knows the real size."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Scan output over all cores when the input has fewer splits than the cluster has
    cores; an input with enough splits is returned as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal(df: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by ``key`` over as many partitions as keep a task near ``task_rows`` rows, at least one a core: joins and
    windows on the key then sort as much per task on any input. ``key`` is to be nearly unique; the rows are counted first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // task_rows)), key)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder on the shared checkpoint storage for streams and side tables."""
    return f"{checkpoint_dir(spark)}/work/{name}-{uuid.uuid4().hex}"
