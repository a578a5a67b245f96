"""Scores, classes and their explanations: column arithmetic over one row per trend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.functions import curves as C

# Engagement baselines, weights, labels and levels.
ENGAGEMENT_BASELINE = {"tiktok": 0.115, "instagram": 0.030, "youtube": 0.019}
OTHER_ENGAGEMENT_BASELINE = 0.03
TREND_WEIGHTS = {
    "view_velocity": 0.16,
    "growth_rate": 0.20,
    "engagement_rate": 0.13,
    "conversation": 0.09,
    "creator_normalized": 0.15,
    "creator_adoption": 0.11,
    "cross_platform": 0.06,
    "recency": 0.06,
    "consistency": 0.04,
}
OPPORTUNITY_WEIGHTS = {
    "growth": 0.26,
    "engagement": 0.16,
    "low_competition": 0.18,
    "recency": 0.10,
    "cross_platform": 0.08,
    "adaptability": 0.12,
    "ease_of_production": 0.10,
}
TREND_LABELS = {
    "view_velocity": "View velocity",
    "growth_rate": "Growth rate",
    "engagement_rate": "Engagement rate",
    "conversation": "Share & comment activity",
    "creator_normalized": "Creator-normalised lift",
    "creator_adoption": "Creator adoption",
    "cross_platform": "Cross-platform presence",
    "recency": "Recency",
    "consistency": "Historical consistency",
}
OPPORTUNITY_LABELS = {k: k.replace("_", " ").capitalize() for k in OPPORTUNITY_WEIGHTS}
EASE = {"low": 1.0, "medium": 0.6, "high": 0.25}
ADAPTABILITY_SCORE = {"high": 1.0, "medium": 0.6, "low": 0.25}
HALF_LIFE_HOURS = 96.0
# Sentences of the explanation, with the number each one takes.
REASONS = {
    "up": ("Adoption is up ", "% week over week — creators are still entering the format, not leaving it."),
    "down": ("Adoption moved ", "% this week, so the window is closing rather than opening."),
    "open": ("Only ", " creators have adopted it, so the format is not yet crowded."),
    "crowded": "Competition is high — large accounts already own this format, "
               "so differentiation matters more than speed.",
    "lift": ("Videos in this format do ", "x their creator's normal views, which means the format "
             "is carrying the performance, not the audience size."),
    "travels": "It already works across several unrelated niches, so it should travel well.",
    "easy": "Production difficulty is low — a phone and a screen recorder are enough.",
}


def pick(value: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for key, number in table.items():
        out = F.when(value == key, F.lit(number)) if out is None else out.when(
            value == key, F.lit(number)
        )
    return out.otherwise(F.lit(default))


def saturation(creators: Column, followers: Column, videos: Column) -> Column:
    return C.clamp(
        0.55 * C.log_scale(creators, 20)
        + 0.20 * C.log_ratio(followers, 500_000)
        + 0.25 * C.log_scale(videos, 60)
    )


def competition_level(sat: Column) -> Column:
    return F.when(sat < 0.38, "low").when(sat < 0.56, "medium").otherwise("high")


def adaptability(niche_count: Column, consistency: Column) -> Column:
    return (
        F.when((niche_count >= 4) & (consistency > 0.4), "high")
        .when(niche_count >= 2, "medium")
        .otherwise("low")
    )


def status(
    growth_7d: Column, growth_24h: Column, median_views: Column, creators: Column,
    videos: Column, raw_score: Column,
) -> Column:
    """Lifecycle class; the order of the tests is part of the rule."""
    reach = C.log_scale(median_views, 400_000)
    broad = (creators >= 20) & (videos >= 20)
    return (
        F.when((growth_7d < -0.15) | ((growth_24h < -0.45) & (growth_7d < 0.05)), "declining")
        .when((reach >= 0.50) & broad, "viral")
        .when((creators < 15) & (growth_7d > 0), "emerging")
        .when((growth_7d >= 0.15) | ((growth_7d > 0.05) & (raw_score >= 55)), "growing")
        .when(broad & (reach >= 0.35), "viral")
        .when(broad, "declining")
        .otherwise("emerging")
    )


def weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    return F.lit(100.0) * reduce(
        lambda a, b: a + b, [F.lit(w) * signals[k] for k, w in weights.items()]
    )


def score_components(
    signals: dict[str, Column], weights: dict[str, float], labels: dict[str, str]
) -> Column:
    """Components as an array of structs, largest contribution first, ties in given order."""
    entries = [
        F.struct(
            (F.lit(-w) * signals[k]).alias("sort"),
            F.lit(pos).alias("pos"),
            F.struct(
                F.lit(k).alias("key"),
                F.lit(labels[k]).alias("label"),
                C.round_to(signals[k], 3).alias("value"),
                F.lit(w).alias("weight"),
                C.round_to(F.lit(100.0 * w) * signals[k], 1).alias("contribution"),
            ).alias("c"),
        )
        for pos, (k, w) in enumerate(weights.items())
    ]
    return F.transform(F.sort_array(F.array(*entries)), lambda e: e["c"])


def _columns(df: DataFrame, **new: Column) -> DataFrame:
    return df.withColumns(new)


def score_trends(aggregates: DataFrame, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    """Add signals, both scores, classes and the nested breakdown to each trend row."""
    platforms = F.col("platforms")
    primary = F.when(F.size(platforms) > 0, F.element_at(platforms, 1)).otherwise("tiktok")
    df = _columns(
        aggregates,
        __base=pick(primary, ENGAGEMENT_BASELINE, OTHER_ENGAGEMENT_BASELINE),
        __sat=saturation(F.col("creator_count"), F.col("median_followers"), F.col("video_count")),
        adaptability=adaptability(F.size("niches"), F.col("lift_consistency")),
    )
    df = _columns(
        df,
        __view_velocity=C.log_scale(F.col("median_velocity"), 2_500),
        __growth_rate=C.logistic(F.col("growth_7d"), 0.25, 2.6),
        __engagement_rate=C.clamp(F.col("avg_engagement_rate") / (F.col("__base") * 2)),
        __conversation=C.clamp(F.col("median_conversation") / 0.06),
        __creator_normalized=C.logistic(F.col("median_creator_lift"), 1.8, 1.1),
        __creator_adoption=C.log_scale(F.col("creator_count"), 30),
        __cross_platform=C.clamp(F.size("platforms") / 3.0),
        __recency=C.decay(F.col("median_age_hours"), half_life),
        __consistency=F.col("lift_consistency"),
    )
    trend_signals = {k: F.col(f"__{k}") for k in TREND_WEIGHTS}
    chance_signals = {
        "growth": F.col("__growth_rate"),
        "engagement": F.col("__engagement_rate"),
        "low_competition": F.lit(1.0) - F.col("__sat"),
        "recency": F.col("__recency"),
        "cross_platform": F.col("__cross_platform"),
        "adaptability": pick(F.col("adaptability"), ADAPTABILITY_SCORE, 0.25),
        "ease_of_production": pick(F.col("production_difficulty"), EASE, 0.6),
    }
    df = _columns(
        df,
        __score=weighted(trend_signals, TREND_WEIGHTS),
        __chance=weighted(chance_signals, OPPORTUNITY_WEIGHTS),
    )
    df = _columns(
        df,
        status=status(
            F.col("growth_7d"), F.col("growth_24h"), F.col("median_views"),
            F.col("creator_count"), F.col("video_count"), F.col("__score"),
        ),
        competition_level=competition_level(F.col("__sat")),
    )
    df = _columns(
        df,
        __chance=F.when(F.col("status") == "declining", F.col("__chance") * 0.65).otherwise(
            F.col("__chance")
        ),
    )
    breakdown = F.struct(
        F.struct(
            C.round_to(F.col("__score"), 1).alias("total"),
            score_components(trend_signals, TREND_WEIGHTS, TREND_LABELS).alias("components"),
        ).alias("trend_score"),
        F.struct(
            C.round_to(F.col("__chance"), 1).alias("total"),
            score_components(chance_signals, OPPORTUNITY_WEIGHTS, OPPORTUNITY_LABELS).alias(
                "components"
            ),
        ).alias("opportunity_score"),
        F.struct(
            C.round_to(F.col("growth_7d") * 100, 1).alias("growth_7d_pct"),
            C.round_to(F.col("growth_24h") * 100, 1).alias("growth_24h_pct"),
            C.round_to(F.col("median_velocity"), 1).alias("median_velocity_per_hour"),
            C.round_to(F.col("median_creator_lift"), 2).alias("median_creator_lift"),
            "creator_count",
            "video_count",
            C.round_to(F.col("avg_engagement_rate"), 4).alias("avg_engagement_rate"),
            F.col("__base").alias("engagement_baseline"),
            C.round_to(F.col("__sat"), 3).alias("saturation"),
            C.round_to(F.col("median_age_hours"), 1).alias("median_age_hours"),
        ).alias("inputs"),
    )
    return df.select(
        *aggregates.columns,
        C.round_to(F.col("__score"), 1).alias("trend_score"),
        C.round_to(F.least(F.lit(100.0), F.col("__chance")), 1).alias("opportunity_score"),
        "status", "competition_level", "adaptability",
        breakdown.alias("score_breakdown"),
    )


def breakdown_long(trends: DataFrame) -> DataFrame:
    """One row per trend, score and component, in contribution order."""
    parts = []
    for score in ("trend_score", "opportunity_score"):
        parts.append(
            trends.select(
                "trend_id", F.lit(score).alias("score"),
                F.posexplode(f"score_breakdown.{score}.components").alias("pos", "c"),
            ).select("trend_id", "score", F.col("pos").cast("bigint").alias("pos"), "c.*")
        )
    return parts[0].unionByName(parts[1])


def component_lookup(breakdown: Column, key: str, default: float = 0.5) -> Column:
    """One opportunity component by key; ``default`` where it is absent."""
    hit = F.filter(breakdown["opportunity_score"]["components"], lambda c: c["key"] == key)
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"], F.lit(default))


def explain_opportunity(trends: DataFrame) -> DataFrame:
    """Why the opportunity score landed where it did, as an array of sentences."""
    inputs = F.col("score_breakdown.inputs")
    growth, lift = inputs["growth_7d_pct"], inputs["median_creator_lift"]
    level = F.col("competition_level")

    def around(key: str, number: Column) -> Column:
        before, after = REASONS[key]
        return F.concat(F.lit(before), number.cast("string"), F.lit(after))

    percent = F.rint(growth).cast("bigint")
    reasons = F.array(
        F.when(growth >= 50, around("up", percent)).when(growth <= 0, around("down", percent)),
        F.when(level == "low", around("open", inputs["creator_count"])).when(
            level == "high", REASONS["crowded"]),
        F.when(lift >= 1.5, around("lift", F.transform(
            F.array(lift), lambda v: C.round_to(v, 1))[0])),
        F.when(F.col("adaptability") == "high", REASONS["travels"]),
        F.when(F.col("production_difficulty") == "low", REASONS["easy"]),
    )
    return trends.withColumn("reasons", F.array_compact(reasons))
