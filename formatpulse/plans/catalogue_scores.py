"""Queries over event-based formats: signals, aggregates, scores, reports and listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.functions.arrays import ordered_distinct
from formatpulse.operators import aggregates as A
from formatpulse.operators import filters as P
from formatpulse.operators import ranking as R
from formatpulse.operators import reports as Q
from formatpulse.operators import scoring as SC
from formatpulse.operators import signals as G
from formatpulse.operators import upserts as U
from formatpulse.plans import bindings as B
from formatpulse.plans.oracle import E_NOW, hours, rnd, sql

NOW = B.EVENTS_NOW


def r6(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


AGG_COUNTS = ("video_count", "creator_count", "total_views", "avg_views", "median_views",
              "median_followers")
AGG_REALS = ("avg_engagement_rate", "median_velocity", "median_creator_lift",
             "median_conversation", "median_duration_sec", "median_age_hours", "growth_7d",
             "growth_24h", "lift_consistency")
SCORED = ("trend_score", "opportunity_score", "status", "competition_level", "adaptability",
          "production_difficulty")


def adoption_growth_7d(spark, sf):
    return A.adoption_growth(B.event_members(spark, sf), NOW, 7).select(
        "trend_id", "recent", "prior", r6("growth"))


def format_aggregates(spark, sf):
    return B.event_aggregates(spark, sf).select(
        "trend_id", *AGG_COUNTS, *[r6(c) for c in AGG_REALS],
        *[F.array_join(c, ",").alias(c) for c in A.LIST_COLUMNS.values()],
        "production_difficulty")


def adoption_curve(spark, sf):
    return A.adoption_curve(B.event_members(spark, sf)).select(
        "trend_id", F.explode("adoption_curve").alias("c")).select(
        "trend_id", F.date_format("c.date", "yyyy-MM-dd").alias("date"), "c.videos")


def medians_by_format(spark, sf):
    return A.medians(B.event_signals(spark, sf)).select(
        "trend_id", "median_views", "median_followers",
        *[r6(c) for c in AGG_REALS if c.startswith("median")])


def trend_scores(spark, sf):
    return B.event_trends(spark, sf).select("trend_id", *SCORED)


def score_breakdown_long(spark, sf):
    return SC.breakdown_long(B.event_trends(spark, sf)).select(
        "trend_id", "score", "key", "label", "value", "weight", "contribution")


def score_inputs(spark, sf):
    return B.event_trends(spark, sf).select("trend_id", "score_breakdown.inputs.*")


def opportunity_reasons(spark, sf):
    return SC.explain_opportunity(B.event_trends(spark, sf)).select(
        "trend_id", F.posexplode("reasons").alias("pos", "reason")).select(
        "trend_id", F.col("pos").cast("bigint").alias("pos"), "reason")


def latest_velocity(spark, sf):
    return G.velocity(B.user_items(spark, sf), B.user_metrics(spark, sf), NOW).select(
        "item_id", r6("velocity"))


def prior_velocity(spark, sf):
    return G.velocity(B.user_items(spark, sf), B.user_metrics(spark, sf), NOW).select(
        "item_id", r6("prior_velocity"))


def velocity_growth_24h(spark, sf):
    rates = B.event_signals(spark, sf).groupBy("trend_id").agg(
        A.momentum_of(F.sum("recent_rate"), F.sum("prior_rate")).alias("growth_24h"))
    return rates.select("trend_id", r6("growth_24h"))


def snapshot_series(spark, sf):
    return R.snapshot_series(B.event_snapshots(spark, sf)).select(
        "trend_id", F.posexplode("snapshots").alias("pos", "s")).select(
        "trend_id", F.col("pos").cast("bigint").alias("pos"), day("s.captured_at").alias("at"),
        "s.video_count", "s.creator_count", "s.total_views")


def sparkline_14(spark, sf):
    return R.sparkline(B.event_snapshots(spark, sf)).select(
        "trend_id", F.posexplode("sparkline").alias("pos", "value")).select(
        "trend_id", F.col("pos").cast("bigint").alias("pos"), "value")


def snapshot_backfill_14d(spark, sf):
    members = B.event_members(spark, sf).withColumn("engagement", C.engagement_rate(
        *[F.col(c) for c in ("views", "likes", "comments", "shares", "saves")]))
    return A.snapshot_backfill(members, NOW, 14).select(
        "trend_id", "days_ago", day("captured_at").alias("captured_at"), "video_count",
        "creator_count", "total_views", r6("avg_engagement_rate"), "trend_score")


def consensus_difficulty(spark, sf):
    return A.consensus_difficulty(B.event_members(spark, sf))


def filter_trends_combo(spark, sf):
    kept = P.filter_trends(
        B.event_trends(spark, sf), niche="Technology", status="growing,emerging,viral",
        difficulty="low,medium", min_growth=-0.1, min_engagement=0.01, min_duration=20,
        max_duration=110, since_days=60, q="click", now=NOW)
    return kept.select("trend_id", "name", "status", "opportunity_score")


def trending_preset(spark, sf):
    return P.trending_preset(B.event_trends(spark, sf)).select("trend_id", "status", "trend_score")


def rising_preset(spark, sf):
    return P.rising_preset(B.event_trends(spark, sf)).select("trend_id", "status", r6("growth_7d"))


def paginate_trends(spark, sf):
    page, total = P.paginate(P.sort_trends(B.event_trends(spark, sf), "videos"), 12, 10)
    return page.select("trend_id", "video_count").withColumn("total", total.scalar())


def lookup_trend(spark, sf):
    return P.lookup(B.event_trends(spark, sf), "click-format-3").select("trend_id", "slug", "name")


def by_platform(spark, sf):
    return Q.by_platform(B.event_trends(spark, sf))


def by_status(spark, sf):
    return Q.by_status(B.event_trends(spark, sf))


def by_niche(spark, sf):
    return Q.by_niche(B.event_trends(spark, sf))


def score_distribution(spark, sf):
    return Q.score_distribution(B.event_trends(spark, sf))


def adoption_timeline(spark, sf):
    return Q.adoption_timeline(B.event_snapshots(spark, sf), NOW, 30).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "videos", "creators")


def totals(spark, sf):
    return Q.totals(
        B.table(spark, sf, "events"), B.table(spark, sf, "lineitem"),
        B.table(spark, sf, "customer"), B.event_trends(spark, sf))


def facets(spark, sf):
    return Q.facets(B.event_trends(spark, sf)).select(
        "facet", F.posexplode("values").alias("pos", "value")).select(
        "facet", F.col("pos").cast("bigint").alias("pos"), "value")


def dashboard_stats(spark, sf):
    return Q.dashboard_stats(B.event_trends(spark, sf))


def top_movers(spark, sf):
    return P.top_movers(B.event_trends(spark, sf)).select("trend_id", r6("growth_7d"))


def rising(spark, sf):
    return P.rising(B.event_trends(spark, sf)).select("trend_id", "status", r6("growth_7d"))


def best(spark, sf):
    return P.best(B.event_trends(spark, sf)).select("trend_id", "opportunity_score")


def cross_platform(spark, sf):
    return P.cross_platform(B.event_trends(spark, sf)).select(
        "trend_id", F.size("platforms").cast("bigint").alias("n_platforms"), "opportunity_score")


def stale_trends(spark, sf):
    """Formats seen in the first half of the window that have no item in the last day."""
    members = B.event_members(spark, sf)
    late = members.filter(F.col("published_at") >= F.lit(NOW).cast("timestamp") - F.expr("interval 1 day"))
    existing = members.select("trend_id", "niche").distinct()
    kept = late.select("trend_id", "niche").distinct()
    key = F.concat_ws("/", "trend_id", "niche").alias("slug")
    return U.stale_trends(existing.select(key), kept.select(key))


def niches_in_order(spark, sf):
    """Ordered distinct: each format's niches in member order, first occurrence kept."""
    firsts = B.event_members(spark, sf).groupBy("trend_id", "niche").agg(
        F.min("item_id").alias("first"))
    arr = F.transform(F.sort_array(F.collect_list(F.struct("first", "niche"))), lambda e: e["niche"])
    doubled = F.concat(F.col("a"), F.reverse("a"))
    return firsts.groupBy("trend_id").agg(arr.alias("a")).select(
        "trend_id", F.array_join(ordered_distinct(doubled), ",").alias("niches"))


def members_ranked(spark, sf):
    return R.member_rank(B.event_members(spark, sf).select("trend_id", "item_id", "similarity")).select(
        "trend_id", "item_id", "rank", "is_exemplar")


def narration_input(spark, sf):
    members = B.event_members(spark, sf)
    return R.narration_input(
        B.event_trends(spark, sf), members.select("trend_id", "item_id", "similarity"),
        members.select("item_id", "duration_sec", "niche"), 10, 8).select(
        "trend_id", "opportunity_score", "item_id", "rank", "duration_sec", "niche")


def trend_details(spark, sf):
    members = B.event_members(spark, sf)
    creators = members.groupBy("creator_id").agg(F.max("followers").alias("followers"))
    detail = R.trend_details(
        members.select("trend_id").distinct(), members.select("trend_id", "item_id", "similarity"),
        members.select("item_id", "creator_id", "views", "likes", "comments", "shares", "saves"),
        creators, members.select("item_id", "production_difficulty"))
    return detail.select("trend_id", F.explode("videos").alias("v")).select(
        "trend_id", "v.rank", "v.item_id", "v.similarity", "v.engagement_rate", "v.creator.followers",
        F.col("v.analysis.production_difficulty").alias("difficulty"))


_ORDER = "ORDER BY opportunity_score DESC, trend_id"
_LISTS = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in A.LIST_COLUMNS.values())
_REALS = ", ".join(f"round({c}, 6) AS {c}" for c in AGG_REALS)
_MED = ", ".join(f"round({c}, 6) AS {c}" for c in AGG_REALS if c.startswith("median"))


def _long() -> str:
    rows = []
    for score, weights, labels, prefix in (
        ("trend_score", SC.TREND_WEIGHTS, SC.TREND_LABELS, "s"),
        ("opportunity_score", SC.OPPORTUNITY_WEIGHTS, SC.OPPORTUNITY_LABELS, "o"),
    ):
        for key, weight in weights.items():
            rows.append(
                f"""SELECT trend_id, '{score}' AS score, '{key}' AS key, '{labels[key]}' AS label,
                {rnd(f"{prefix}_{key}", 3)} AS value, {weight!r}::DOUBLE AS weight,
                {rnd(f"{100.0 * weight!r}::DOUBLE * {prefix}_{key}", 1)} AS contribution FROM trends""")
    return " UNION ALL ".join(rows)


_REASONS = f"""SELECT trend_id, row_number() OVER (PARTITION BY trend_id ORDER BY o) - 1 AS pos, reason FROM (
 SELECT trend_id, 1 AS o, CASE WHEN g >= 50 THEN 'Adoption is up ' || CAST(CAST({rnd('g', 0)} AS BIGINT) AS VARCHAR) || '% week over week — creators are still entering the format, not leaving it.'
   WHEN g <= 0 THEN 'Adoption moved ' || CAST(CAST({rnd('g', 0)} AS BIGINT) AS VARCHAR) || '% this week, so the window is closing rather than opening.' END AS reason FROM (SELECT trend_id, {rnd('growth_7d * 100', 1)} AS g FROM trends)
 UNION ALL SELECT trend_id, 2, CASE competition_level WHEN 'low' THEN 'Only ' || CAST(creator_count AS VARCHAR) || ' creators have adopted it, so the format is not yet crowded.'
   WHEN 'high' THEN 'Competition is high — large accounts already own this format, so differentiation matters more than speed.' END FROM trends
 UNION ALL SELECT trend_id, 3, CASE WHEN l >= 1.5 THEN 'Videos in this format do ' || CAST({rnd('l', 1)} AS VARCHAR) || 'x their creator''s normal views, which means the format is carrying the performance, not the audience size.' END FROM (SELECT trend_id, {rnd('median_creator_lift', 2)} AS l FROM trends)
 UNION ALL SELECT trend_id, 4, CASE WHEN adaptability = 'high' THEN 'It already works across several unrelated niches, so it should travel well.' END FROM trends
 UNION ALL SELECT trend_id, 5, CASE WHEN production_difficulty = 'low' THEN 'Production difficulty is low — a phone and a screen recorder are enough.' END FROM trends
) WHERE reason IS NOT NULL"""

_FACET = " UNION ALL ".join(
    [f"""SELECT '{c}' AS facet, row_number() OVER (ORDER BY n DESC, v) - 1 AS pos, v AS value FROM (
      SELECT v, count(*) AS n FROM (SELECT unnest({c}) AS v FROM trends) GROUP BY v)"""
     for c in Q.LIST_FACETS]
    + [f"""SELECT '{n}', row_number() OVER (ORDER BY v) - 1, v FROM (SELECT DISTINCT {c} AS v FROM trends)"""
       for n, c in Q.SCALAR_FACETS.items()])

_BACKFILL = f"""SELECT trend_id, d AS days_ago,
  strftime({E_NOW} - to_days(CAST(d AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS captured_at,
  count(*) AS video_count, count(DISTINCT creator_id) AS creator_count,
  CAST(floor(sum(views) * (1.0::DOUBLE - d / 22.400000000000002::DOUBLE)) AS BIGINT) AS total_views,
  round(avg(engagement), 6) AS avg_engagement_rate, 0.0::DOUBLE AS trend_score
  FROM signals JOIN (SELECT unnest(range(1, 15)) AS d) ON published_at <= {E_NOW} - to_days(CAST(d AS INTEGER))
  GROUP BY trend_id, d"""

_SPARK = f"""SELECT trend_id, row_number() OVER (PARTITION BY trend_id ORDER BY captured_at) - 1 AS pos,
  {rnd('video_count / hi::DOUBLE', 3)} AS value FROM (SELECT *, max(video_count) OVER (PARTITION BY trend_id) AS hi FROM (
  SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY captured_at DESC) AS r FROM snapshots)
  WHERE r <= 14)"""

_VELOCITY = f"""SELECT u.item_id, round(CASE WHEN t2 > t1 THEN greatest(0.0, (v2 - v1) / {hours('t1', 't2')})
  ELSE views / greatest(1.0, {hours('published_at', E_NOW)}) END, 6) AS velocity
  FROM (SELECT user_id AS item_id, min(ts) AS published_at, max(value) AS views FROM events GROUP BY 1) u
  LEFT JOIN upoints p USING (item_id)"""

_MEMBERS = """SELECT trend_id, item_id, row_number() OVER (PARTITION BY trend_id
  ORDER BY similarity DESC, item_id) AS rank FROM members"""

QUERIES = {
    "adoption_growth_7d": (adoption_growth_7d, sql(
        """SELECT trend_id, recent, prior, round(growth_7d, 6) AS growth FROM aggs""", "aggs")),
    "format_aggregates": (format_aggregates, sql(
        f"SELECT trend_id, {', '.join(AGG_COUNTS)}, {_REALS}, {_LISTS}, production_difficulty FROM aggs", "aggs")),
    "adoption_curve": (adoption_curve, sql(
        """SELECT trend_id, strftime(published_at, '%Y-%m-%d') AS date, count(*) AS videos
        FROM members GROUP BY 1, 2""", "members")),
    "medians_by_format": (medians_by_format, sql(
        f"SELECT trend_id, median_views, median_followers, {_MED} FROM base", "base")),
    "trend_scores": (trend_scores, sql(f"SELECT trend_id, {', '.join(SCORED)} FROM trends", "trends")),
    "score_breakdown_long": (score_breakdown_long, sql(_long(), "trends")),
    "score_inputs": (score_inputs, sql(
        f"""SELECT trend_id, {rnd('growth_7d * 100', 1)} AS growth_7d_pct, {rnd('growth_24h * 100', 1)} AS growth_24h_pct,
        {rnd('median_velocity', 1)} AS median_velocity_per_hour, {rnd('median_creator_lift', 2)} AS median_creator_lift,
        creator_count, video_count, {rnd('avg_engagement_rate', 4)} AS avg_engagement_rate, base AS engagement_baseline,
        {rnd('sat', 3)} AS saturation, {rnd('median_age_hours', 1)} AS median_age_hours FROM trends""", "trends")),
    "opportunity_reasons": (opportunity_reasons, sql(_REASONS, "trends")),
    "latest_velocity": (latest_velocity, sql(_VELOCITY, "upoints")),
    "prior_velocity": (prior_velocity, sql(
        f"""SELECT item_id, round(CASE WHEN t1 > t0 THEN greatest(0.0, (v1 - v0) / {hours('t0', 't1')}) END, 6)
        AS prior_velocity FROM upoints""", "upoints")),
    "velocity_growth_24h": (velocity_growth_24h, sql(
        "SELECT trend_id, round(growth_24h, 6) AS growth_24h FROM aggs", "aggs")),
    "snapshot_series": (snapshot_series, sql(
        """SELECT trend_id, row_number() OVER (PARTITION BY trend_id ORDER BY captured_at) - 1 AS pos,
        strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS at, video_count, creator_count, total_views
        FROM snapshots""", "snapshots")),
    "sparkline_14": (sparkline_14, sql(_SPARK, "snapshots")),
    "snapshot_backfill_14d": (snapshot_backfill_14d, sql(_BACKFILL, "signals")),
    "consensus_difficulty": (consensus_difficulty, sql(
        "SELECT trend_id, production_difficulty FROM aggs", "aggs")),
    "filter_trends_combo": (filter_trends_combo, sql(
        f"""SELECT trend_id, name, status, opportunity_score FROM trends
        WHERE list_contains(niches, 'technology') AND status IN ('growing', 'emerging', 'viral')
        AND production_difficulty IN ('low', 'medium') AND growth_7d >= -0.1 AND avg_engagement_rate >= 0.01
        AND median_duration_sec BETWEEN 20 AND 110 AND first_seen_at >= {E_NOW} - INTERVAL 60 DAY
        AND (name ILIKE '%click%' OR format_pattern ILIKE '%click%' OR summary ILIKE '%click%')""", "trends")),
    "trending_preset": (trending_preset, sql(
        """SELECT trend_id, status, trend_score FROM trends WHERE status IN ('viral', 'growing')
        ORDER BY trend_score DESC, trend_id LIMIT 48""", "trends")),
    "rising_preset": (rising_preset, sql(
        """SELECT trend_id, status, round(growth_7d, 6) AS growth_7d FROM trends
        WHERE status IN ('emerging', 'growing') AND growth_7d >= 0 ORDER BY trends.growth_7d DESC, trend_id LIMIT 48""", "trends")),
    "paginate_trends": (paginate_trends, sql(
        """SELECT trend_id, video_count, (SELECT count(*) FROM trends) AS total FROM trends
        ORDER BY video_count DESC, trend_id LIMIT 12 OFFSET 10""", "trends")),
    "lookup": (lookup_trend, sql(
        """SELECT trend_id, slug, name FROM trends WHERE trend_id = 'click-format-3' OR slug = 'click-format-3'""", "trends")),
    "by_platform": (by_platform, sql(
        """SELECT platform, count(*) AS trends, CAST(sum(video_count) AS BIGINT) AS videos FROM (
        SELECT unnest(platforms) AS platform, video_count FROM trends) GROUP BY platform""", "trends")),
    "by_status": (by_status, sql(
        """SELECT s.status, count(t.trend_id) AS count FROM (SELECT unnest(['emerging', 'growing', 'viral', 'declining']) AS status) s
        LEFT JOIN trends t ON t.status = s.status GROUP BY s.status""", "trends")),
    "by_niche": (by_niche, sql(
        f"""SELECT niche, count(*) AS trends, CAST(sum(video_count) AS BIGINT) AS videos,
        {rnd('avg(opportunity_score)', 1)} AS avg_opportunity FROM (
        SELECT unnest(niches) AS niche, video_count, opportunity_score FROM trends)
        GROUP BY niche ORDER BY trends DESC, niche LIMIT 12""", "trends")),
    "score_distribution": (score_distribution, sql(
        """SELECT bucket, count(t.trend_id) AS count FROM (VALUES ('0-20', 0, 20), ('20-40', 20, 40), ('40-60', 40, 60),
        ('60-80', 60, 80), ('80-100', 80, 101)) b(bucket, lo, hi)
        LEFT JOIN trends t ON t.opportunity_score >= lo AND t.opportunity_score < hi GROUP BY bucket""", "trends")),
    "adoption_timeline": (adoption_timeline, sql(
        f"""SELECT strftime(captured_at, '%Y-%m-%d') AS date, CAST(sum(video_count) AS BIGINT) AS videos,
        CAST(sum(creator_count) AS BIGINT) AS creators FROM snapshots
        WHERE captured_at >= {E_NOW} - INTERVAL 30 DAY GROUP BY 1""", "snapshots")),
    "totals": (totals, sql(
        f"""SELECT count(*) AS trends, (SELECT count(*) FROM events) AS videos,
        (SELECT count(*) FROM lineitem) AS analyzed_videos, (SELECT count(*) FROM customer) AS creators,
        CAST(sum(avg_views * video_count) AS BIGINT) AS total_reach,
        {rnd('avg(trend_score)', 1)} AS avg_trend_score, {rnd('avg(opportunity_score)', 1)} AS avg_opportunity
        FROM trends""", "trends")),
    "facets": (facets, sql(_FACET, "trends")),
    "dashboard_stats": (dashboard_stats, sql(
        f"""SELECT count(*) AS tracked_trends, CAST(sum(video_count) AS BIGINT) AS videos_analyzed,
        CAST(sum(creator_count) AS BIGINT) AS creators_tracked,
        count(*) FILTER (status IN ('emerging', 'growing')) AS rising_count,
        count(*) FILTER (status = 'viral') AS viral_count,
        {rnd('avg(opportunity_score)', 1)} AS avg_opportunity FROM trends""", "trends")),
    "top_movers": (top_movers, sql(
        """SELECT trend_id, round(growth_7d, 6) AS growth_7d FROM trends
        ORDER BY trends.growth_7d DESC, trend_id LIMIT 8""", "trends")),
    "rising": (rising, sql(
        """SELECT trend_id, status, round(growth_7d, 6) AS growth_7d FROM trends
        WHERE status IN ('emerging', 'growing') ORDER BY trends.growth_7d DESC, trend_id LIMIT 6""", "trends")),
    "best": (best, sql(f"SELECT trend_id, opportunity_score FROM trends {_ORDER} LIMIT 6", "trends")),
    "cross_platform": (cross_platform, sql(
        """SELECT trend_id, len(platforms) AS n_platforms, opportunity_score FROM trends
        WHERE len(platforms) >= 2 ORDER BY len(platforms) DESC, opportunity_score DESC, trend_id LIMIT 6""", "trends")),
    "stale_trends": (stale_trends, sql(
        f"""SELECT DISTINCT trend_id || '/' || niche AS slug FROM members EXCEPT
        SELECT trend_id || '/' || niche FROM members WHERE published_at >= {E_NOW} - INTERVAL 1 DAY""", "members")),
    "ordered_distinct": (niches_in_order, sql(
        """SELECT trend_id, string_agg(niche, ',' ORDER BY first) AS niches FROM (
        SELECT trend_id, niche, min(item_id) AS first FROM members GROUP BY 1, 2) GROUP BY trend_id""", "members")),
    "member_rank": (members_ranked, sql(
        f"SELECT *, rank <= 4 AS is_exemplar FROM ({_MEMBERS})", "members")),
    "trend_details": (trend_details, sql(
        f"""SELECT trend_id, m.rank, item_id, similarity, {rnd('CASE WHEN views = 0 THEN 0.0 ELSE (likes + comments + shares + saves) / views::DOUBLE END', 5)} AS engagement_rate, followers,
        production_difficulty AS difficulty FROM ({_MEMBERS}) m JOIN members USING (trend_id, item_id)
        WHERE m.rank <= 24""", "members")),
    "narration_input": (narration_input, sql(
        f"""SELECT t.trend_id, opportunity_score, m.item_id, m.rank, x.duration_sec, x.niche
        FROM (SELECT trend_id, opportunity_score FROM trends WHERE video_count >= 10 {_ORDER} LIMIT 8) t
        JOIN ({_MEMBERS}) m ON m.trend_id = t.trend_id AND m.rank <= 12
        JOIN members x ON x.item_id = m.item_id""", "trends")),
}
