"""Streams over landed files: dedupe, upsert, velocity state, adoption windows, assignment.

Streaming state and sinks live under folders the caller names (the cluster's shared
storage). Sinks are idempotent by batch id, so a replayed batch changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from formatpulse.operators import upserts as U
from formatpulse.operators.aggregates import truncated
from formatpulse.operators.similarity import index_centroids
from formatpulse.session import store
from formatpulse.streaming.state import SEED, KeyedState

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(
    spark: SparkSession, path: str, schema, fmt: str = "parquet",
    files_per_batch: int | None = None, names: str | None = None,
) -> DataFrame:
    """New files of a landing folder (matching ``names``) as an unbounded frame."""
    reader = spark.readStream.schema(schema).format(fmt)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start(
    df: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str,
    mode: str = "append", every: str | None = None,
) -> StreamingQuery:
    """Start a stream into a batch function or a Parquet folder; drains once unless ``every``."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if callable(sink):
        return writer.foreachBatch(sink).start()
    return writer.format("parquet").start(sink)


def drain(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    start(df, sink, checkpoint, mode).awaitTermination()


def dedupe_stream(
    df: DataFrame, keys: list[str], at: str = "captured_at", delay: str = "3 hours"
) -> DataFrame:
    """One row per key; state is dropped once the watermark has passed."""
    return (
        df.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, delay)
        .dropDuplicatesWithinWatermark(keys)
    )


NEWEST = 30
AT_LEAST = 3


def _state(path: str, items: DataFrame, creators: DataFrame | None, buckets: int, keep: int) -> KeyedState:
    keys = {"items": ("platform", "external_id")}
    schemas = {"items": items.schema}
    if creators is not None:
        keys |= {"creators": ("platform", "handle"), "recent": ("platform", "handle")}
        schemas |= {"creators": creators.schema, "recent": items.sparkSession.createDataFrame(
            [], f"platform {_kind(creators, 'platform')}, handle {_kind(creators, 'handle')}, "
            f"external_id {_kind(items, 'external_id')}, published_at timestamp, views bigint").schema}
    return KeyedState(path, keys, schemas, buckets, keep)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def recent_items(rows: DataFrame, newest: int = NEWEST) -> DataFrame:
    """The newest items of each creator: all that a baseline can rest on, as items keep their date."""
    order = Window.partitionBy("platform", "handle").orderBy(F.desc_nulls_last("published_at"), "external_id")
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= newest).drop("__r")


def with_baselines(creators: DataFrame, recent: DataFrame, touched: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """``creators`` with the median of their recent views where they are ``touched``, have no baseline, and ``at_least``
    items are known."""
    missing = creators.where(F.coalesce("baseline_median_views", F.lit(0)) == 0).join(
        touched, ["platform", "handle"], "left_semi").select("platform", "handle")
    found = recent.join(missing, ["platform", "handle"], "left_semi").groupBy("platform", "handle").agg(
        F.count("*").alias("__n"), F.expr("percentile(views, 0.5D)").alias("__m")).where(F.col("__n") >= at_least)
    kind = creators.schema["baseline_median_views"].dataType
    return creators.join(found, ["platform", "handle"], "left").withColumn("baseline_median_views", F.when(
        F.col("__m").isNotNull(), truncated(F.col("__m")).cast(kind)).otherwise(F.col("baseline_median_views"))).select(*creators.columns)


def upsert_sink(
    path: str, initial: DataFrame, now: Column, creators: DataFrame | None = None, buckets: int = 64, keep: int = 3,
) -> Callable[[DataFrame, int], None]:
    """Batch function that upserts items, and with ``creators`` their creators, into keyed state under ``path``.

    Only the buckets that a batch touches are read and written (:class:`KeyedState`). Batch n starts from
    the newest version below n, so a replay writes the same version from the same rows. Metric snapshots and the counts of
    ingested and updated rows go to one folder per batch. ``creators`` are the stored ones (platform, handle, …, baseline_median_views): rows of a batch
    then name their creator by ``handle`` and have ``published_at``. The newest items of each creator are kept
    beside them, so that the baselines of touched creators are found without the other items. A batch that is a table already
    (``stored``) is not written again.
    """
    state = _state(path, initial, creators, buckets, keep)
    creator_keys = ["platform", "handle"]

    def seed(spark: SparkSession) -> None:
        tables = {"items": initial} | ({"creators": creators} if creators is not None else {})
        if creators is not None and "handle" in initial.columns:
            tables["recent"] = recent_items(initial.select(*state.schemas["recent"].names))
        state.commit(spark, SEED, None, {k: (v, list(range(buckets))) for k, v in tables.items()})

    def apply(batch: DataFrame, batch_id: int, stored: bool = False) -> None:
        spark = batch.sparkSession
        done = state.newest(spark)
        if done is not None and done > batch_id:
            return
        if not state.versions(spark):
            seed(spark)
        before = state.newest(spark, batch_id)
        if not stored:
            batch = store(batch, "batch")  # read several times; a source may give its rows only once
        touched = state.touched("items", batch)
        merged = store(U.upsert_items(state.read(spark, "items", before, touched), batch, now), "merged")
        changed = {"items": (merged.drop("change", "batch_rows"), touched)}
        if creators is not None:
            near = state.touched("creators", batch)
            people = U.upsert_creators(state.read(spark, "creators", before, near), batch)
            # an item belongs to the creator of its first row
            fresh = merged.where("batch_rows > 0").select(*state.schemas["recent"].names)
            known = state.read(spark, "recent", before, near).join(fresh, ["platform", "external_id"], "left_anti")
            mine = state.touched("recent", fresh)
            also = sorted(set(mine) - set(near))  # of items whose later rows name another creator
            if also:
                known = known.unionByName(state.read(spark, "recent", before, also).join(
                    fresh, ["platform", "external_id"], "left_anti"))
            recent = store(recent_items(known.unionByName(fresh)), "recent")
            changed["recent"] = (recent, sorted({*near, *mine}))
            changed["creators"] = (with_baselines(people, recent, batch.select(*creator_keys).distinct()), near)
        state.commit(spark, batch_id, before, changed)
        U.upsert_counts(merged).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        keyed = batch.withColumn("item_id", F.concat_ws("/", "platform", "external_id"))
        U.append_metrics(keyed, now).write.mode("overwrite").parquet(
            f"{path}/metrics/batch={batch_id}")

    apply.state = state
    apply.counts = lambda spark, batch_id: spark.read.parquet(f"{path}/counts/batch={batch_id}")
    return apply


class LastThree(StatefulProcessor):
    """Keeps the newest three snapshots of an item and emits its current rates. An event-time timer, set anew
    with each newer snapshot, drops the state of an item that stays idle. Times are microseconds; the state is one value, which
    also says what timer is set, so an item costs a read, a write and its timer."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.points = handle.getValueState("newest", "at array<bigint>, views array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.points.get()
        kept = list(zip(*held)) if held else []
        before = kept[-1][0] if kept else None
        kept = sorted([*kept, *((r["at"], math.nan if r["views"] is None else r["views"]) for r in rows if r["at"] is not None)])[-3:]
        if not kept:
            return
        at, views = zip(*kept)
        self.points.update((list(at), list(views)))
        if at[-1] != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.idle_ms)
            self.handle.registerTimer(at[-1] // 1000 + self.idle_ms)

        def rate(older, newer):
            span = (newer[0] - older[0]) / 3.6e9
            return max(0.0, (newer[1] - older[1]) / span) if span > 0 else None

        yield Row(item_id=key[0], at=at[-1], points=len(kept), velocity=rate(kept[-2], kept[-1]) if len(kept) >= 2 else None,
                  prior_velocity=rate(kept[-3], kept[-2]) if len(kept) >= 3 else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.points.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_rows(pdf: pd.DataFrame, n: int = 3) -> pd.DataFrame:
    """The rows that can be among the newest ``n`` of their item."""
    ordered = pdf.sort_values(["captured_at", "views"], kind="stable")
    return ordered.groupby("item_id", sort=False).tail(n)


def stream_velocity(metrics: DataFrame, delay: str = "30 days", idle: timedelta = timedelta(days=60)) -> DataFrame:
    """Updated velocities per item and batch from (item_id, captured_at, views).

    Each map task cuts its rows to three an item before the shuffle. Snapshots later than ``delay`` behind the newest
    are left out; the state of an item goes when the watermark passes its newest snapshot by ``idle``.
    """
    metrics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = metrics.schema["item_id"].dataType.simpleString()
    rows = metrics.select("item_id", F.col("captured_at").cast("timestamp").alias("captured_at"),
                          F.col("views").cast("double").alias("views"))
    cut = rows.mapInPandas(lambda batches: map(newest_rows, batches), rows.schema)
    timed = cut.withWatermark("captured_at", delay).withColumn("at", F.unix_micros("captured_at"))
    return timed.groupBy("item_id").transformWithState(
        statefulProcessor=LastThree(int(idle.total_seconds() * 1000)),
        outputStructType=f"item_id {kind}, at bigint, points bigint, velocity double, prior_velocity double",
        outputMode="Update", timeMode="EventTime",
    ).select("item_id", F.timestamp_micros("at").alias("as_of"), "points", "velocity", "prior_velocity")


def stream_adoption(
    items: DataFrame, at: str = "published_at", delay: str = "1 day",
    width: str = "1 day", slide: str | None = None, key: str = "trend_id",
) -> DataFrame:
    """Items per trend and tumbling (or, with ``slide``, sliding) event-time window."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return (
        items.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, delay)
        .groupBy(key, window.alias("w"))
        .agg(F.count(F.lit(1)).alias("videos"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "videos")
    )


def window_sink(
    path: str, schema: StructType, keys: tuple[str, ...] = ("trend_id", "start"), buckets: int = 16, keep: int = 3,
) -> Callable[[DataFrame, int], None]:
    """Batch function for update-mode windows: rows replace those of equal keys in keyed state under ``path``.

    Windows that the watermark has closed leave the stream's state and stay here. A replayed batch starts
    from the version before it and changes nothing.
    """
    state = KeyedState(path, {"windows": keys}, {"windows": schema}, buckets, keep)

    def apply(batch: DataFrame, batch_id: int, stored: bool = False) -> None:
        spark = batch.sparkSession
        done = state.newest(spark)
        if done is not None and done > batch_id:
            return
        before = state.newest(spark, batch_id)
        batch = store(batch, "windows")
        touched = state.touched("windows", batch)
        stored = state.read(spark, "windows", before, touched) if before is not None else batch.limit(0)
        rows = stored.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)
        state.commit(spark, batch_id, before, {"windows": (rows, touched)})

    apply.state = state
    return apply


def assign_sink(
    path: str, centroids: DataFrame | Callable[[SparkSession], DataFrame], threshold: float,
    version: Callable[[SparkSession], int | None] | None = None, key: str = "trend_id", centroid: str = "centroid", **names,
) -> Callable[[DataFrame, int], None]:
    """Batch function: new vectors join existing trends between rebuilds.

    Centroids are made ready once, not in every batch. With ``version`` (as
    :func:`formatpulse.sources.gold.current_run`), they are read anew by ``centroids`` when it changes, so a
    rebuild shows in the next batch.
    """
    held: dict = {}

    def apply(batch: DataFrame, batch_id: int, stored: bool = False) -> None:
        now = version(batch.sparkSession) if version else None
        if "index" not in held or held["version"] != now:
            rows = centroids(batch.sparkSession) if callable(centroids) else centroids
            held.update(version=now, index=index_centroids(rows, key, centroid))
        held["index"].assign(batch, threshold, key=key, **names).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}")

    apply.held = held
    return apply


MANIFEST = "batch bigint, high timestamp, rows bigint, on_time bigint, late bigint, repeats bigint"


def split_sink(path: str, at: str, delay: str, keys: tuple[str, ...] = (), buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """Batch function: rows on time to ``on_time``, rows behind the watermark of earlier batches to ``late``, one
    folder a batch each. With ``keys``, only the first row of each key seen within the watermark is on time; the others
    are counted as repeats (the earliest event time first, within a batch).

    What a batch saw is written last, as one manifest row with its highest event time and its counts. So the
    watermark and the keys survive a restart, a replay starts from the batches before it, and readers
    (:func:`settled`) take only batches whose manifest is there.
    """
    seen: KeyedState | None = None

    def apply(batch: DataFrame, batch_id: int, stored: bool = False) -> None:
        nonlocal seen
        spark = batch.sparkSession
        moment = F.col(at).cast("timestamp")
        high = read_manifest(spark, path).filter(F.col("batch") < batch_id).agg(F.max("high")).first()[0]
        border = None if high is None else F.lit(high) - F.expr(f"interval {delay}")
        batch = store(batch, "batch")  # read several times
        late = F.lit(False) if border is None else F.coalesce(moment < border, F.lit(False))
        on_time, n_repeats = batch.where(~late), 0
        if keys:
            named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)]
            known = [f"k{i}" for i in range(len(keys))]
            if seen is None:
                schema = on_time.select(*named, moment.alias("seen_at")).schema
                seen = KeyedState(f"{path}/seen", {"keys": tuple(known)}, {"keys": schema}, buckets)
            before = seen.newest(spark, batch_id)
            rows = on_time.select("*", *named)
            # one row a key: reduced by the map tasks before the shuffle
            names = [c for c in batch.columns]
            first = rows.groupBy(*known).agg(F.min_by(F.struct(*names), F.struct(moment.alias("m"), F.xxhash64(*names))).alias("r"))
            touched = seen.touched("keys", first)
            old = seen.read(spark, "keys", before, touched) if before is not None else spark.createDataFrame([], seen.schemas["keys"])
            fresh = store(first.join(old.select(*known), known, "left_anti"), "fresh")
            now_high = batch.agg(F.max(moment)).first()[0]
            limit = max((h for h in (high, now_high) if h is not None), default=None)
            alive = F.lit(True) if limit is None else ~F.coalesce(F.col("seen_at") < F.lit(limit) - F.expr(f"interval {delay}"), F.lit(False))
            here = fresh.select(*known, "r.*").select(*known, moment.alias("seen_at"))
            seen.commit(spark, batch_id, before, {"keys": (old.unionByName(here).where(alive), touched)})
            on_time = fresh.select("r.*")
        on_time.write.mode("overwrite").parquet(f"{path}/on_time/batch={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        total = batch.agg(F.max(moment).alias("high"), F.count("*").alias("n"), F.count_if(late).alias("late")).first()
        written = spark.read.schema(batch.schema).parquet(f"{path}/on_time/batch={batch_id}").count()
        n_repeats = total["n"] - total["late"] - written
        spark.createDataFrame([(batch_id, total["high"], total["n"], written, total["late"], n_repeats)], MANIFEST).coalesce(
            1).write.mode("overwrite").parquet(f"{path}/manifest/batch_id={batch_id}")

    return apply


def late_split_sink(path: str, at: str, delay: str) -> Callable[[DataFrame, int], None]:
    """:func:`split_sink` without keys."""
    return split_sink(path, at, delay)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batch whose outputs are complete."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(s.getPath()) for s in fs.listStatus(root)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []
    return spark.read.schema(MANIFEST).parquet(*done) if done else spark.createDataFrame([], MANIFEST)


def settled(spark: SparkSession, path: str, side: str, schema: StructType) -> DataFrame:
    """The rows of ``side`` (on_time or late) of all complete batches."""
    folders = [f"{path}/{side}/batch={r['batch']}" for r in read_manifest(spark, path).select("batch").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def drain_pending(
    items: DataFrame, features: DataFrame, enrich: Callable[[DataFrame], DataFrame],
    batch: int = 40,
) -> DataFrame:
    """One queue visit: the newest ``batch`` items without features, enriched."""
    return enrich(U.pending(items, features, batch))
