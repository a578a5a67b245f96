"""Ingest as one job: requested sources, normalised rows, quality gate, upserts, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.operators.audit import Audit
from formatpulse.operators.filters import quality_gate
from formatpulse.session import store
from formatpulse.sources.registry import multi_source_union

#: Fields of an item that the sink keeps, beside its keys and counters.
FIXED = ("url", "thumbnail_url", "caption", "hashtags", "published_at", "duration_sec", "country", "language", "niche",
         "content_type", "sound_name")
COUNTS = ("views", "likes", "comments", "shares", "saves")
OF_CREATOR = ("display_name", "avatar_url", "followers", "baseline_median_views")


def empty_items(spark: SparkSession) -> DataFrame:
    """The stored items of a first run."""
    from formatpulse import schemas

    raw = spark.createDataFrame([], schemas.RAW_ITEMS)
    return raw.select("platform", "external_id", F.col("creator.handle").alias("handle"), *FIXED, *COUNTS,
                      F.lit(None).cast("timestamp").alias("collected_at"))


def empty_creators(spark: SparkSession) -> DataFrame:
    from formatpulse import schemas

    return spark.createDataFrame([], schemas.RAW_ITEMS).select("platform", *[F.col(f"creator.{c}").alias(c) for c in ("handle", *OF_CREATOR)])


def as_batch(raw: DataFrame) -> DataFrame:
    """Flat rows for the sink, in the order in which they were read, which says what came last."""
    rows = raw.select("platform", "external_id", F.col("creator.handle").alias("handle"),
                      *[F.col(f"creator.{c}").alias(c) for c in OF_CREATOR], *FIXED, *COUNTS, "view_history")
    return rows.withColumn("seq", F.monotonically_increasing_id())


def ingest(
    spark: SparkSession, platforms: list[str], niches: list[str | None], sink: Callable[..., None],
    now, run: int, audit_path: str, **gate,
) -> DataFrame:
    """Collect all requests into ``sink`` (:func:`formatpulse.streaming.jobs.upsert_sink` with creators) as batch ``run``.

    Sources that are not configured are skipped and named in the audit, the others are one union. The rows
    that pass the gate are stored once, so that what the sink reads again is the same. Returns the audit table.
    """
    audit = Audit(run)
    raw, requests = multi_source_union(spark, platforms, niches)
    for r in requests.where("skipped IS NOT NULL").collect():  # a row a request
        audit.say(f"skipped {r['platform']}", niche=r["niche"] or "", reason=r["skipped"])
    raw = audit.watch(raw, "normalised", views=F.sum("views"))
    kept = audit.watch(quality_gate(raw, C.as_instant(now), **gate), "kept", views=F.sum("views"))
    sink(store(as_batch(kept), "ingest"), run, stored=True)
    counts = sink.counts(spark, run).first()
    audit.say("upserted", ingested=counts["ingested"], updated=counts["updated"])
    people = sink.state.read(spark, "creators")
    known = people.agg(F.count("*").alias("n"), F.count_if(F.coalesce("baseline_median_views", F.lit(0)) > 0).alias("b")).first()
    audit.say("creators", rows=known["n"], with_baseline=known["b"])
    return audit.append(spark, audit_path)
