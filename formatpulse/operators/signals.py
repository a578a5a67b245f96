"""From items, creators and snapshot history to one scoring row per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.functions import curves as C


def corpus(
    items: DataFrame, features: DataFrame, creators: DataFrame, cutoff: Column | None = None
) -> DataFrame:
    """Items that have features and a creator, inside the window.

    The cutoff is applied on the item scan so that publish-date partitions prune; the
    creator side is broadcast or shuffled as its measured size allows. An empty niche,
    country or language falls back to the creator's.
    """
    if cutoff is not None:
        items = items.filter(F.col("published_at") >= cutoff)
    dims = creators.select(
        "creator_id", "followers", "baseline_median_views",
        F.col("niche").alias("__niche"), F.col("country").alias("__country"),
        F.col("language").alias("__language"),
    )
    joined = items.join(features, "item_id").join(dims, "creator_id")
    for name in ("niche", "country", "language"):
        joined = joined.withColumn(
            name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"__{name}"))
        ).drop(f"__{name}")
    return joined


def history_for(items: DataFrame, metrics: DataFrame, key: str = "item_id") -> DataFrame:
    """Snapshots of the selected items only: a semi-join, never an id list."""
    return metrics.join(items.select(key), key, "left_semi")


def recent_points(
    metrics: DataFrame, key: str = "item_id", at: str = "captured_at", value: str = "views"
) -> DataFrame:
    """The newest three snapshots of each item as ``t0/v0`` (oldest) to ``t2/v2`` (newest).

    The rank filter becomes a per-task group limit ahead of the shuffle, so an item with
    a huge history sends at most three rows per map task.
    """
    newest = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(value).desc())
    ranked = metrics.select(
        key, F.col(at).alias("t"), F.col(value).alias("v"), F.row_number().over(newest).alias("r")
    ).filter(F.col("r") <= 3)
    picks = []
    for slot, rank in ((2, 1), (1, 2), (0, 3)):
        picks += [
            F.max(F.when(F.col("r") == rank, F.col("t"))).alias(f"t{slot}"),
            F.max(F.when(F.col("r") == rank, F.col("v"))).alias(f"v{slot}"),
        ]
    return ranked.groupBy(key).agg(*picks)


def points_of(history: Column) -> dict[str, Column]:
    """The same points from an array of (time, views) that holds an item's whole, short history."""
    newest = F.sort_array(F.array_compact(history), asc=False)
    return {f"{name}{slot}": F.get(newest, F.lit(2 - slot))[field]
            for slot in (0, 1, 2) for name, field in (("t", "captured_at"), ("v", "views"))}


def _span(older: str, newer: str) -> Column:
    return C.hours_between(F.col(older), F.col(newer))


def _rate(older: int, newer: int) -> Column:
    return F.greatest(
        F.lit(0.0),
        (F.col(f"v{newer}") - F.col(f"v{older}")) / _span(f"t{older}", f"t{newer}"),
    )


def recent_velocity() -> Column:
    """Views per hour between the last two points; null without a positive span."""
    return F.when(_span("t1", "t2") > 0, _rate(1, 2))


def prior_velocity() -> Column:
    """The same over the window before; null when fewer than three points."""
    return F.when(_span("t0", "t1") > 0, _rate(0, 1))


def lifetime_velocity(views: Column, published_at: Column, now) -> Column:
    return views / F.greatest(F.lit(1.0), C.age_hours(published_at, now))


def velocity(items: DataFrame, metrics: DataFrame, now) -> DataFrame:
    """Per item: current velocity (lifetime average where history is too short)."""
    points = recent_points(metrics)
    return items.join(points, "item_id", "left").select(
        "item_id",
        F.coalesce(
            recent_velocity(), lifetime_velocity(F.col("views"), F.col("published_at"), now)
        ).alias("velocity"),
        prior_velocity().alias("prior_velocity"),
    )


def signals(members: DataFrame, metrics: DataFrame, now) -> DataFrame:
    """One row per (trend, item) with every measure that scoring aggregates.

    ``members`` carries item and creator columns; ``metrics`` any number of snapshots.
    ``prior_rate``/``recent_rate`` are set only where both spans are positive, which is
    the momentum rule.
    """
    # as many points as items: merged, never broadcast
    return measured(members.join(recent_points(metrics).hint("merge"), "item_id", "left"), now)


def measured(joined: DataFrame, now) -> DataFrame:
    """The measures of items that stand beside their newest points."""
    views = F.col("views")
    both = (_span("t0", "t1") > 0) & (_span("t1", "t2") > 0)
    return joined.select(
        "trend_id", "item_id", "creator_id", "platform", "niche", "country", "language",
        "content_type", "published_at", "duration_sec", "followers", "similarity", "views",
        F.coalesce(recent_velocity(), lifetime_velocity(views, F.col("published_at"), now)).alias(
            "velocity"
        ),
        F.when(both, _rate(0, 1)).alias("prior_rate"),
        F.when(both, _rate(1, 2)).alias("recent_rate"),
        C.engagement_rate(
            views, F.col("likes"), F.col("comments"), F.col("shares"), F.col("saves")
        ).alias("engagement"),
        C.conversation_rate(views, F.col("comments"), F.col("shares"), F.col("saves")).alias(
            "conversation"
        ),
        C.creator_lift(views, F.col("baseline_median_views"), F.col("followers")).alias("lift"),
        C.age_hours(F.col("published_at"), now).alias("age_hours"),
        "production_difficulty",
    )
