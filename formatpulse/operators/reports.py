"""Corpus analytics. Counts over trends and items; fixed domains are zero-filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.schemas import STATUSES

# Score buckets, upper bound exclusive.
SCORE_BUCKETS = ((0, 20), (20, 40), (40, 60), (60, 80), (80, 101))


def totals(
    items: DataFrame, features: DataFrame, creators: DataFrame, trends: DataFrame
) -> DataFrame:
    """One row of corpus totals, put together from four independent one-row counts."""
    parts = [
        trends.select(
            F.lit(1).alias("trends"), F.lit(0).alias("videos"), F.lit(0).alias("analyzed_videos"),
            F.lit(0).alias("creators"),
            (F.col("avg_views") * F.col("video_count")).alias("reach"),
            F.col("trend_score").alias("score"), F.col("opportunity_score").alias("chance"),
        )
    ]
    for df, name in ((items, "videos"), (features, "analyzed_videos"), (creators, "creators")):
        flags = [F.lit(int(name == c)).alias(c)
                 for c in ("trends", "videos", "analyzed_videos", "creators")]
        parts.append(
            df.select(*flags, F.lit(0).cast("bigint").alias("reach"),
                      F.lit(None).cast("double").alias("score"),
                      F.lit(None).cast("double").alias("chance"))
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("trends", "videos", "analyzed_videos", "creators")],
        F.coalesce(F.sum("reach"), F.lit(0)).alias("total_reach"),
        C.round_to(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("avg_trend_score"),
        C.round_to(F.coalesce(F.avg("chance"), F.lit(0.0)), 1).alias("avg_opportunity"),
    )


def by_platform(trends: DataFrame) -> DataFrame:
    return (
        trends.select(F.explode("platforms").alias("platform"), "video_count")
        .groupBy("platform")
        .agg(F.count(F.lit(1)).alias("trends"), F.sum("video_count").alias("videos"))
        .orderBy(F.col("trends").desc(), "platform")
    )


def _domain(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame(list(enumerate(values)), f"pos int, {name} string")


def by_status(trends: DataFrame) -> DataFrame:
    """All four statuses in life-cycle order, zeros included."""
    counts = trends.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return (
        F.broadcast(_domain(trends, "status", list(STATUSES)))
        .join(counts, "status", "left")
        .orderBy("pos")
        .select("status", F.coalesce("n", F.lit(0)).alias("count"))
    )


def by_niche(trends: DataFrame, k: int = 12) -> DataFrame:
    return (
        trends.select(F.explode("niches").alias("niche"), "video_count", "opportunity_score")
        .groupBy("niche")
        .agg(
            F.count(F.lit(1)).alias("trends"),
            F.sum("video_count").alias("videos"),
            C.round_to(F.avg("opportunity_score"), 1).alias("avg_opportunity"),
        )
        .orderBy(F.col("trends").desc(), "niche")
        .limit(k)
    )


def score_distribution(trends: DataFrame) -> DataFrame:
    labels = [f"{lo}-{min(hi, 100)}" for lo, hi in SCORE_BUCKETS]
    bucket = None
    for (lo, hi), label in zip(SCORE_BUCKETS, labels):
        hit = (F.col("opportunity_score") >= lo) & (F.col("opportunity_score") < hi)
        bucket = F.when(hit, label) if bucket is None else bucket.when(hit, label)
    counts = trends.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return (
        F.broadcast(_domain(trends, "bucket", labels))
        .join(counts, "bucket", "left")
        .orderBy("pos")
        .select("bucket", F.coalesce("n", F.lit(0)).alias("count"))
    )


def adoption_timeline(
    snapshots: DataFrame, now, days: int = 30, latest_per_day: bool = False
) -> DataFrame:
    """Daily sums over trend snapshots of the last ``days``.

    Two rebuilds on one day count twice, as stored; ``latest_per_day`` keeps the newest
    snapshot of each trend and day instead.
    """
    rows = snapshots.filter(
        F.col("captured_at") >= C.as_instant(now) - F.make_dt_interval(F.lit(days))
    ).withColumn("date", F.to_date(F.date_trunc("day", "captured_at")))
    if latest_per_day:
        rows = rows.groupBy("trend_id", "date").agg(
            F.max_by("video_count", "captured_at").alias("video_count"),
            F.max_by("creator_count", "captured_at").alias("creator_count"),
        )
    return (
        rows.groupBy("date")
        .agg(F.sum("video_count").alias("videos"), F.sum("creator_count").alias("creators"))
        .orderBy("date")
    )


def items_by_platform(items: DataFrame) -> DataFrame:
    return items.groupBy("platform").agg(
        F.count(F.lit(1)).alias("videos"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
    )


# Facet names and the column each one lists.
LIST_FACETS = ("platforms", "niches", "countries", "languages", "content_types")
SCALAR_FACETS = {
    "statuses": "status",
    "competition_levels": "competition_level",
    "difficulties": "production_difficulty",
}


def facet_values(trends: DataFrame) -> DataFrame:
    """(facet, value, n) for every list and scalar facet in one pass over trends."""

    def tagged(name: str) -> Column:
        return F.transform(
            F.col(name), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value"))
        )

    entries = [tagged(c) for c in LIST_FACETS]
    entries.append(
        F.array(*[F.struct(F.lit(n).alias("facet"), F.col(c).alias("value"))
                  for n, c in SCALAR_FACETS.items()])
    )
    return (
        trends.select(F.explode(F.concat(*entries)).alias("e"))
        .groupBy("e.facet", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("value").isNotNull())
    )


def facets(trends: DataFrame) -> DataFrame:
    """One array per facet: lists by frequency (then name), scalars by name."""
    by_count = F.col("facet").isin(*LIST_FACETS)
    entry = F.struct(F.when(by_count, -F.col("n")).otherwise(F.lit(0)).alias("o"), "value")
    return facet_values(trends).groupBy("facet").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["value"]).alias("values")
    )


def dashboard_stats(trends: DataFrame) -> DataFrame:
    return trends.agg(
        F.count(F.lit(1)).alias("tracked_trends"),
        F.coalesce(F.sum("video_count"), F.lit(0)).alias("videos_analyzed"),
        F.coalesce(F.sum("creator_count"), F.lit(0)).alias("creators_tracked"),
        F.count_if(F.col("status").isin("emerging", "growing")).alias("rising_count"),
        F.count_if(F.col("status") == "viral").alias("viral_count"),
        C.round_to(F.coalesce(F.avg("opportunity_score"), F.lit(0.0)), 1).alias("avg_opportunity"),
    )


def fallback_count(features: DataFrame) -> DataFrame:
    return features.agg(F.count_if(F.col("is_fallback")).alias("fallbacks"))


def stage_report(spark, counts: dict[str, int | str]) -> DataFrame:
    """Audit rows of one run: stage counts as the driver already knows them."""
    return spark.createDataFrame(
        [(k, str(v)) for k, v in counts.items()], "stage string, value string"
    )
