"""Top-k per group and numbering inside groups, both safe for a dominant group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.functions.curves import engagement_rate, round_to
from formatpulse.session import cut

#: Rows of a group up to which one window numbers it.
WINDOW_ROWS = 2_000_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The filter on the rank is pushed into each map task as a
    group limit, so at most ``k`` rows per key and task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key, as one map-side combined aggregate."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")


def number_within(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rank",
    hot_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """1, 2, 3… inside each group in ascending ``order`` (which must be unique in a group).

    Ordinary groups use one window. If a group exceeds ``hot_rows``, the rows are range
    partitioned on (keys, order), numbered per slice, and shifted by the sizes of the
    earlier slices, so a dominant group is spread over many tasks. The slice numbers are
    fixed by a checkpoint before they are used twice.
    """
    sizes = df.groupBy(*keys).count().filter(F.col("count") > hot_rows)
    if sizes.isEmpty():
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    sliced = cut(
        df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn(
            "__slice", F.spark_partition_id()
        )
    )
    per_slice = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = per_slice.select(
        *keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    return (
        sliced.withColumn("__r", F.row_number().over(inside))
        .join(shifts, [*keys, "__slice"])
        .withColumn(name, (F.col("__r") + F.col("__shift")).cast("bigint"))
        .drop("__r", "__shift", "__slice")
    )


def member_rank(
    members: DataFrame, exemplars: int = 4, key: str = "trend_id", hot_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Similarity-descending rank inside the trend; the first four are exemplars."""
    ordered = members.withColumn("__down", -F.col("similarity"))
    return (
        number_within(ordered, [key], ["__down", "item_id"], "rank", hot_rows)
        .drop("__down")
        .withColumn("is_exemplar", F.col("rank") <= exemplars)
    )


def members_detail(
    trends: DataFrame, members: DataFrame, items: DataFrame, k: int = 24,
    key: str = "trend_id",
) -> DataFrame:
    """The best ``k`` members of every trend with their item columns.

    The cut to ``k`` runs on the narrow bridge table before the item join, so wide item
    rows are fetched only for rows that are returned.
    """
    best = top_k(
        members.join(trends.select(key), key, "left_semi"),
        [key], [F.col("similarity").desc(), F.col("item_id")], k,
    )
    return best.join(items, "item_id")


def with_context(items: DataFrame, creators: DataFrame, features: DataFrame) -> DataFrame:
    """Item rows with their engagement rate and nested ``creator`` and ``analysis`` structs;
    a side that is missing leaves a null struct."""
    def nested(df: DataFrame, key: str, name: str) -> DataFrame:
        fields = [c for c in df.columns if c not in (key, "embedding")]
        return df.select(key, F.struct(*fields).alias(name))

    rate = engagement_rate(*[F.col(c) for c in ("views", "likes", "comments", "shares", "saves")])
    return (
        items.withColumn("engagement_rate", round_to(rate, 5))
        .join(nested(creators, "creator_id", "creator"), "creator_id", "left")
        .join(nested(features, "item_id", "analysis"), "item_id", "left")
    )


def trend_details(
    trends: DataFrame, members: DataFrame, items: DataFrame, creators: DataFrame,
    features: DataFrame, k: int = 24, exemplars: int = 4, key: str = "trend_id",
) -> DataFrame:
    """Each trend with its best ``k`` members as an array of full structs, the first few of
    them also as exemplars. Item, creator and feature rows are joined after the cut."""
    top = members_detail(trends, members, items, k, key)
    full = with_context(top, creators, features)
    entry = F.struct("rank", *[c for c in full.columns if c not in ("rank", key)])
    videos = full.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("videos"))
    return trends.join(videos, key, "left").withColumn(
        "exemplars", F.slice("videos", 1, exemplars))


def narration_input(
    trends: DataFrame, members: DataFrame, features: DataFrame, min_videos: int, limit: int,
    k: int = 12,
) -> DataFrame:
    """The ``k`` most typical feature rows of the ``limit`` best trends of a minimum size."""
    chosen = (
        trends.filter(F.col("video_count") >= min_videos)
        .orderBy(F.col("opportunity_score").desc(), F.col("trend_id"))
        .limit(limit)
        .select("trend_id", "opportunity_score")
    )
    return members_detail(chosen, members, features, k).join(chosen, "trend_id")


def example_hooks(
    trends: DataFrame, members: DataFrame, features: DataFrame, pool: int = 8, k: int = 5
) -> DataFrame:
    """First ``k`` non-empty hooks among the ``pool`` most typical members."""
    detail = members_detail(trends, members, features.select("item_id", "hook"), pool)
    ordered = F.sort_array(
        F.collect_list(F.when(F.coalesce(F.col("hook"), F.lit("")) != "", F.struct("rank", "hook")))
    )
    return detail.groupBy("trend_id").agg(
        F.slice(F.transform(ordered, lambda e: e["hook"]), 1, k).alias("example_hooks")
    )


def sparkline(
    snapshots: DataFrame, points: int = 14, key: str = "trend_id", value: str = "video_count"
) -> DataFrame:
    """Last ``points`` snapshots, oldest first, over their maximum, as an array."""
    recent = top_k(snapshots, [key], [F.col("captured_at").desc(), F.col(value).desc()], points, "r")
    series = recent.groupBy(key).agg(
        F.max(value).alias("hi"),
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("o"), F.col(value).alias("v")))),
            lambda e: e["v"],
        ).alias("vs"),
    )
    top = F.when(F.col("hi") == 0, F.lit(1.0)).otherwise(F.col("hi").cast("double"))
    return series.withColumn("hi", top).select(
        key, F.transform("vs", lambda v: round_to(v / F.col("hi"), 3)).alias("sparkline")
    )


def snapshot_series(snapshots: DataFrame, key: str = "trend_id") -> DataFrame:
    """A trend's history in time order as an array of structs."""
    entry = F.struct(
        "captured_at", *[c for c in snapshots.columns if c not in (key, "captured_at")]
    )
    return snapshots.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("snapshots"))
