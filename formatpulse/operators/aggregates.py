"""Per-trend aggregates. Every step pre-aggregates in the map tasks before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.functions.quantiles import group_medians, join_keys
from formatpulse.session import store

MEDIAN_COLUMNS = {
    "views": "median_views",
    "velocity": "median_velocity",
    "lift": "median_creator_lift",
    "conversation": "median_conversation",
    "duration_sec": "median_duration_sec",
    "age_hours": "median_age_hours",
    "followers": "median_followers",
}
# The five attributes kept as ranked lists.
LIST_COLUMNS = {
    "platform": "platforms",
    "niche": "niches",
    "country": "countries",
    "language": "languages",
    "content_type": "content_types",
}


def truncated(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def growth_of(recent: Column, prior: Column) -> Column:
    """(recent - prior) / prior; a burst from nothing is capped at 2, 1 or 0."""
    return F.when(
        prior == 0,
        F.when(recent >= 3, F.lit(2.0)).when(recent >= 1, F.lit(1.0)).otherwise(F.lit(0.0)),
    ).otherwise((recent - prior) / prior)


def window_counts(published_at: Column, now, window_days: int = 7) -> tuple[Column, Column]:
    """Aggregates counting items of the newest window and of the one before it."""
    age = F.unix_micros(C.as_instant(now)) - F.unix_micros(published_at.cast("timestamp"))
    width = window_days * 24 * C.HOUR_MICROS
    recent = F.count_if(age <= width)
    prior = F.count_if((age > width) & (age <= 2 * width))
    return recent, prior


def adoption_growth(
    items: DataFrame, now, window_days: int = 7, key: str = "trend_id",
    at: str = "published_at",
) -> DataFrame:
    """New items per trend in two adjacent windows and their relative change."""
    recent, prior = window_counts(F.col(at), now, window_days)
    return (
        items.groupBy(key)
        .agg(recent.alias("recent"), prior.alias("prior"))
        .withColumn("growth", growth_of(F.col("recent"), F.col("prior")))
    )


def momentum_of(recent_total: Column, prior_total: Column) -> Column:
    """Relative change of summed rates, inside [-0.95, 3]."""
    recent, prior = F.coalesce(recent_total, F.lit(0.0)), F.coalesce(prior_total, F.lit(0.0))
    return F.when(
        prior <= 0, F.when(recent > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise(F.greatest(F.lit(-0.95), F.least(F.lit(3.0), (recent - prior) / prior)))


def consistency_of(count: Column, mean: Column, spread: Column) -> Column:
    return F.when(count < 3, F.lit(0.5)).otherwise(
        C.clamp(F.lit(1.0) - spread / F.greatest(F.lit(0.1), mean) / F.lit(2.0))
    )


def ranked_distinct(
    rows: DataFrame, columns: dict[str, str], key: str = "trend_id",
    order: tuple[str, ...] = ("similarity", "item_id"),
) -> DataFrame:
    """Per trend and attribute: distinct non-empty values, most frequent first.

    Equal counts are settled by first appearance in member order (similarity descending,
    then id). Rows collapse to (trend, attribute, value) in the map tasks, so what moves
    is the number of distinct values; the arrays hold one small struct per value.
    """
    sim, ident = order
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("attr"), F.col(col).alias("value"))
            for col, name in columns.items()
        ]
    )
    counted = (
        rows.select(key, sim, ident, F.explode(pairs).alias("p"))
        .filter(F.coalesce(F.col("p.value"), F.lit("")) != "")
        .groupBy(key, F.col("p.attr").alias("attr"), F.col("p.value").alias("value"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct((-F.col(sim)).alias("s"), F.col(ident).alias("i"))).alias("first"),
        )
    )
    lists = []
    for name in columns.values():
        entry = F.when(
            F.col("attr") == name, F.struct((-F.col("n")).alias("n"), "first", "value")
        )
        lists.append(
            F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["value"]).alias(name)
        )
    return counted.groupBy(key).agg(*lists)


def adoption_curve(items: DataFrame, key: str = "trend_id", at: str = "published_at") -> DataFrame:
    """Items per publish day as one date-ordered array of structs."""
    daily = items.groupBy(key, F.to_date(at).alias("date")).agg(
        F.count(F.lit(1)).alias("videos")
    )
    return daily.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("date", "videos"))).alias("adoption_curve")
    )


def mode_of(
    rows: DataFrame, key: str, value: str, first: Column, default: str | None = None
) -> DataFrame:
    """Most common non-empty value per key; ties go to the smallest ``first``."""
    counted = (
        rows.filter(F.coalesce(F.col(value), F.lit("")) != "")
        .groupBy(key, value)
        .agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    )
    best = counted.groupBy(key).agg(
        F.min_by(value, F.struct((-F.col("n")).alias("n"), "first", value)).alias(value)
    )
    if default is None:
        return best
    return (
        rows.select(key).distinct().join(best, key, "left")
        .withColumn(value, F.coalesce(F.col(value), F.lit(default)))
    )


def difficulty_mode(rows: DataFrame, key: str = "trend_id") -> DataFrame:
    """Most common production difficulty; equal counts go to the easier level."""
    level = F.col("production_difficulty")
    order = F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2).otherwise(3)
    return mode_of(rows, key, "production_difficulty", order)


def settle_difficulty(label: Column, median_duration: Column) -> Column:
    """Medium when nothing was observed, and when a "low" format runs over 75 s."""
    return F.when(
        label.isNull() | ((label == "low") & (median_duration > 75)), F.lit("medium")
    ).otherwise(label)


def consensus_difficulty(rows: DataFrame, key: str = "trend_id") -> DataFrame:
    medians = group_medians(rows, [key], ["duration_sec"])
    return medians.join(difficulty_mode(rows, key), key, "left").select(
        key,
        settle_difficulty(F.col("production_difficulty"), F.col("duration_sec")).alias(
            "production_difficulty"
        ),
    )


def name_medians(wide: DataFrame) -> DataFrame:
    """Median columns under their trend names, with their defaults and truncation."""
    named = wide.withColumnsRenamed(MEDIAN_COLUMNS)
    return (
        named.fillna(1.0, ["median_creator_lift"])
        .fillna(0.0, [n for n in MEDIAN_COLUMNS.values() if n != "median_creator_lift"])
        .withColumn("median_views", truncated(F.col("median_views")))
        .withColumn("median_followers", truncated(F.col("median_followers")))
    )


def medians(signals: DataFrame, key: str = "trend_id") -> DataFrame:
    return name_medians(group_medians(signals, [key], list(MEDIAN_COLUMNS)))


def attribute_summary(signals: DataFrame) -> DataFrame:
    """The categorical attributes of a trend, counted.

    Gives the five ranked lists, the number of distinct creators and the consensus
    difficulty label. Rows collapse to the combinations of a trend's attributes in the map tasks, and
    only those are dealt out by attribute; creators, of which there are many, are counted beside them.
    """
    attrs = {**LIST_COLUMNS, "production_difficulty": "difficulty"}
    combined = signals.groupBy("trend_id", *attrs).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("item_id").alias("i"))).alias("first"),
    )
    pairs = [
        F.struct(F.lit(name).alias("attr"), F.col(col).alias("value"))
        for col, name in attrs.items()
    ]
    counted = (
        combined.select("trend_id", "n", "first", F.explode(F.array(*pairs)).alias("p"))
        .groupBy("trend_id", F.col("p.attr").alias("attr"), F.col("p.value").alias("value"))
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        # a trend without any value stays, with empty lists
        .withColumn("attr", F.when(F.coalesce("value", F.lit("")) != "", F.col("attr")))
    )
    creators = signals.select("trend_id", "creator_id").distinct().groupBy("trend_id").agg(
        F.count("creator_id").alias("creator_count"))
    lists = []
    for name in LIST_COLUMNS.values():
        entry = F.when(
            F.col("attr") == name, F.struct((-F.col("n")).alias("n"), "first", "value")
        )
        lists.append(
            F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["value"]).alias(name)
        )
    level = F.col("value")
    easier = F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2).otherwise(3)
    found = counted.groupBy("trend_id").agg(
        *lists,
        F.min_by(
            "value",
            F.when(F.col("attr") == "difficulty",
                   F.struct((-F.col("n")).alias("n"), easier.alias("e"), "value")),
        ).alias("production_difficulty"),
    )
    return join_keys(found, creators, ["trend_id"])


def build_aggregates(
    signals: DataFrame, now, with_curve: bool = True
) -> DataFrame:
    """The descriptive row of every trend.

    Sums and counts take one pass, the exact medians, the categorical attributes and the day
    curve one each; the parts are joined on the trend key. The signals are stored once for all.
    """
    signals = store(signals, "signals")
    recent, prior = window_counts(F.col("published_at"), now, 7)
    sums = [
        F.count(F.lit(1)).alias("video_count"),
        F.sum("views").alias("total_views"),
        F.avg("engagement").alias("avg_engagement_rate"),
        recent.alias("recent"),
        prior.alias("prior"),
        F.sum("recent_rate").alias("recent_rate"),
        F.sum("prior_rate").alias("prior_rate"),
        F.avg("lift").alias("mean_lift"),
        F.stddev_pop("lift").alias("lift_spread"),
        F.min("published_at").alias("first_published_at"),
    ]
    out = name_medians(
        group_medians(signals, ["trend_id"], list(MEDIAN_COLUMNS), sums)
    ).join(attribute_summary(signals), "trend_id", "left")
    if with_curve:
        out = out.join(adoption_curve(signals), "trend_id", "left")
    nothing = F.array().cast("array<string>")
    return out.select(
        "trend_id", "video_count", "creator_count", "total_views",
        F.expr("total_views div video_count").alias("avg_views"),
        "avg_engagement_rate",
        *[n for n in MEDIAN_COLUMNS.values()],
        growth_of(F.col("recent"), F.col("prior")).alias("growth_7d"),
        momentum_of(F.col("recent_rate"), F.col("prior_rate")).alias("growth_24h"),
        consistency_of(F.col("video_count"), F.col("mean_lift"), F.col("lift_spread")).alias(
            "lift_consistency"
        ),
        *[F.coalesce(F.col(n), nothing).alias(n) for n in LIST_COLUMNS.values()],
        settle_difficulty(F.col("production_difficulty"), F.col("median_duration_sec")).alias(
            "production_difficulty"
        ),
        "first_published_at",
        *(["adoption_curve"] if with_curve else []),
    )


def creator_baseline(
    items: DataFrame, creators: DataFrame | None = None, newest: int = 30, at_least: int = 3
) -> DataFrame:
    """Median of each creator's newest ``newest`` views, where it rests on ``at_least`` items.

    With ``creators`` given, only creators without a platform-supplied baseline are
    recomputed. The newest-30 rank is a group limit ahead of the shuffle, so a prolific
    creator costs at most 30 rows per map task.
    """
    if creators is not None:
        wanting = creators.filter(F.coalesce(F.col("baseline_median_views"), F.lit(0)) == 0)
        items = items.join(wanting.select("creator_id"), "creator_id", "left_semi")
    newest_first = Window.partitionBy("creator_id").orderBy(
        F.col("published_at").desc(), F.col("item_id")
    )
    return (
        items.select(
            "creator_id", "views", F.row_number().over(newest_first).alias("r")
        )
        .filter(F.col("r") <= newest)
        .groupBy("creator_id")
        .agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(views, 0.5D)").alias("m"))
        .filter(F.col("n") >= at_least)
        .select("creator_id", truncated(F.col("m")).alias("baseline_median_views"))
    )


def snapshot_backfill(
    members: DataFrame, now, days: int = 14, key: str = "trend_id"
) -> DataFrame:
    """Rebuilt daily history: for each of the last ``days`` days, what was already published.

    Each item lands in the one day on which it first counts; days are then accumulated
    per trend, so no item is repeated and there is no range join. A creator counts from
    the first day any of their items does.
    """
    age = F.unix_micros(C.as_instant(now)) - F.unix_micros(F.col("published_at").cast("timestamp"))
    first_offset = F.least(F.lit(days), F.floor(age / F.lit(24 * C.HOUR_MICROS))).cast("int")
    placed = members.withColumn("offset", first_offset).filter(F.col("offset") >= 1)
    per_day = placed.groupBy(key, "offset").agg(
        F.count(F.lit(1)).alias("videos"),
        F.sum("views").alias("views"),
        F.sum("engagement").alias("engagement"),
    )
    newcomers = (
        placed.groupBy(key, "creator_id").agg(F.max("offset").alias("offset"))
        .groupBy(key, "offset").agg(F.count(F.lit(1)).alias("creators"))
    )
    calendar = per_day.select(key).distinct().select(
        key, F.explode(F.sequence(F.lit(1), F.lit(days))).alias("offset")
    )
    so_far = Window.partitionBy(key).orderBy(F.col("offset").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    filled = calendar.join(per_day, [key, "offset"], "left").join(
        newcomers, [key, "offset"], "left"
    )
    running = filled.select(
        key, "offset",
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(so_far).alias(c)
          for c in ("videos", "creators", "views", "engagement")],
    ).filter(F.col("videos") > 0)
    discount = F.lit(1.0) - F.col("offset") / F.lit(days * 1.6)
    return running.select(
        key,
        (C.as_instant(now) - F.make_dt_interval(F.col("offset"))).alias("captured_at"),
        F.col("offset").cast("bigint").alias("days_ago"),
        F.col("videos").alias("video_count"),
        F.col("creators").alias("creator_count"),
        truncated(F.col("views") * discount).alias("total_views"),
        (F.col("engagement") / F.col("videos")).alias("avg_engagement_rate"),
        F.lit(0.0).alias("trend_score"),
    )
