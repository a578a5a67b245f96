"""Optional filters, sorts, pages and presets over trends, items and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.functions.arrays import array_contains_ci

# Sort keys of the trend list, all descending.
SORT_KEYS = {
    "opportunity": "opportunity_score",
    "trend_score": "trend_score",
    "growth_7d": "growth_7d",
    "growth_24h": "growth_24h",
    "engagement": "avg_engagement_rate",
    "recency": "first_seen_at",
    "videos": "video_count",
}


def search_text(df: DataFrame, q: str, columns: list[str]) -> DataFrame:
    """Substring match in any column, ignoring case; ``%`` and ``_`` act as wildcards."""
    hits = [F.col(c).ilike(f"%{q}%") for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def filter_trends(
    trends: DataFrame, *, platform: str | None = None, niche: str | None = None,
    country: str | None = None, language: str | None = None, content_type: str | None = None,
    status: str | None = None, competition: str | None = None, difficulty: str | None = None,
    min_growth: float | None = None, min_engagement: float | None = None,
    min_duration: float | None = None, max_duration: float | None = None,
    since_days: int | None = None, q: str | None = None, now=None,
) -> DataFrame:
    """Only supplied predicates join the plan; scalar ones reach the Parquet scan."""
    tests: list[Column] = []
    lists = {"status": status, "competition_level": competition,
             "production_difficulty": difficulty}
    tests += [F.col(c).isin(*v.split(",")) for c, v in lists.items() if v]
    floors = {"growth_7d": min_growth, "avg_engagement_rate": min_engagement,
              "median_duration_sec": min_duration}
    tests += [F.col(c) >= v for c, v in floors.items() if v is not None]
    if max_duration is not None:
        tests.append(F.col("median_duration_sec") <= max_duration)
    if since_days is not None:
        moment = C.as_instant(now) if now is not None else F.current_timestamp()
        tests.append(F.col("first_seen_at") >= moment - F.make_dt_interval(F.lit(since_days)))
    members = {"platforms": platform, "niches": niche, "countries": country,
               "languages": language, "content_types": content_type}
    tests += [array_contains_ci(F.col(c), v) for c, v in members.items() if v]
    kept = reduce(lambda df, t: df.filter(t), tests, trends)
    return search_text(kept, q, ["name", "format_pattern", "summary"]) if q else kept


def sort_trends(trends: DataFrame, key: str = "opportunity", ident: str = "trend_id") -> DataFrame:
    return trends.orderBy(F.col(SORT_KEYS[key]).desc(), F.col(ident))


def paginate(df: DataFrame, limit: int = 48, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page of an ordered frame, one-row frame with the unpaged total)."""
    return df.offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def trending_preset(trends: DataFrame, limit: int = 48) -> DataFrame:
    return sort_trends(filter_trends(trends, status="viral,growing"), "trend_score").limit(limit)


def rising_preset(trends: DataFrame, limit: int = 48) -> DataFrame:
    kept = filter_trends(trends, status="emerging,growing", min_growth=0.0)
    return sort_trends(kept, "growth_7d").limit(limit)


def top_by(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k; Spark keeps k rows per task and merges them."""
    return df.orderBy(*order).limit(k)


def top_movers(trends: DataFrame, k: int = 8) -> DataFrame:
    return top_by(trends, [F.col("growth_7d").desc(), F.col("trend_id")], k)


def rising(trends: DataFrame, k: int = 6) -> DataFrame:
    return top_movers(trends.filter(F.col("status").isin("emerging", "growing")), k)


def best(trends: DataFrame, k: int = 6) -> DataFrame:
    return top_by(trends, [F.col("opportunity_score").desc(), F.col("trend_id")], k)


def cross_platform(trends: DataFrame, k: int = 6) -> DataFrame:
    return top_by(
        trends.filter(F.size("platforms") >= 2),
        [F.size("platforms").desc(), F.col("opportunity_score").desc(), F.col("trend_id")], k,
    )


def clusters_by_size(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.col("size").desc(), F.col("trend_id"))


def filter_items(
    items: DataFrame, platform: str | None = None, niche: str | None = None,
    limit: int = 40, offset: int = 0,
) -> DataFrame:
    if platform:
        items = items.filter(F.col("platform") == platform)
    if niche:
        items = items.filter(F.col("niche") == niche)
    ordered = items.orderBy(F.col("published_at").desc(), F.col("item_id"))
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def lookup(df: DataFrame, ref, columns: tuple[str, ...] = ("trend_id", "slug")) -> DataFrame:
    """Rows whose id or slug equals ``ref``."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) == F.lit(ref) for c in columns]))


def plans_with_trend(plans: DataFrame, trends: DataFrame) -> DataFrame:
    names = trends.select("trend_id", F.col("name").alias("trend_name"))
    return plans.join(names, "trend_id", "left")


def filter_plans(
    plans: DataFrame, trends: DataFrame, user_id, kind: str | None = None,
    trend_id: str | None = None, limit: int = 50, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(page of a user's plans with trend names, one-row total)."""
    kept = plans.filter(F.col("user_id") == F.lit(user_id))
    if kind:
        kept = kept.filter(F.col("kind") == kind)
    if trend_id:
        kept = kept.filter(F.col("trend_id") == trend_id)
    page, total = paginate(
        kept.orderBy(F.col("created_at").desc(), F.col("plan_id")), limit, offset
    )
    return plans_with_trend(page, trends), total


def quality_gate(
    items: DataFrame, now, since: str | None = None, min_duration: float = 8.0,
    max_duration: float = 90.0, min_views: int = 100_000, min_views_per_hour: float = 500.0,
    lookback_days: int = 21, duration_cap: float | None = None,
) -> DataFrame:
    """Duration band, recency, and either real reach or a fast climb for its age."""
    top = max_duration if duration_cap is None else min(max_duration, duration_cap)
    floor_time = (
        C.as_instant(since) if since is not None
        else C.as_instant(now) - F.make_dt_interval(F.lit(lookback_days))
    )
    hours = F.greatest(F.lit(1.0), C.age_hours(F.col("published_at"), now))
    return items.filter(
        F.col("duration_sec").between(min_duration, top)
        & (F.col("published_at") >= floor_time)
        & ((F.col("views") >= min_views) | (F.col("views") / hours >= min_views_per_hour))
    )
