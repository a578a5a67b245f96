"""Whole jobs as queries: the gold rebuild and streams drained once over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.plans import bindings as B
from formatpulse.plans.catalogue_content import ASSIGN_CUT, CLUSTER_CUT, label_centers
from formatpulse.plans.catalogue_scores import day, r6
from formatpulse.plans.oracle import hours, sql
from formatpulse.plans.rebuild import nightly_rebuild
from formatpulse.session import work_dir
from formatpulse.streaming import jobs as J


def rebuild(spark, sf):
    """Events that have a vector of the same id, clustered, scored and described."""
    members = B.event_members(spark, sf)
    features = B.embeddings(spark, sf).select(
        F.col("vec_id").alias("item_id"), "embedding",
        F.concat(F.lit("Format "), F.col("label").cast("string")).alias("content_format"),
        F.array(F.lit("hook"), F.lit("body"), F.lit("cta")).alias("narrative_structure"),
        F.array(F.concat(F.lit("cut "), (F.col("label") % 3).cast("string"))).alias("editing_patterns"),
        F.lit("calm").alias("emotional_tone"), F.lit("Look at this").alias("hook"))
    creators = members.groupBy("creator_id").agg(
        F.max("followers").alias("followers"),
        F.max("baseline_median_views").alias("baseline_median_views"),
        F.lit("general").alias("niche"), F.lit("US").alias("country"), F.lit("en").alias("language"))
    items = members.drop("trend_id", "followers", "baseline_median_views", "similarity")
    return nightly_rebuild(
        items, features, creators, B.event_metrics(spark, sf), B.EVENTS_NOW, threshold=CLUSTER_CUT,
        min_size=3)


def rebuild_trends(spark, sf):
    return rebuild(spark, sf).trends.select(
        "slug", "name", "status", "video_count", "creator_count", "trend_score",
        "opportunity_score", "summary")


def table_stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files. A name filter would see only the files' own names, and
    a plain path must be a folder; a pattern takes either."""
    return J.stream_files(spark, f"{sf}/[{name[0]}]{name[1:]}.parquet", B.table(spark, sf, name).schema)


def events_stream(spark, sf):
    return table_stream(spark, sf, "events")


def windows_kept(spark, name, rows, **how):
    """Updated windows of a stream, upserted into keyed state and read from there."""
    base = work_dir(spark, name)
    counted = J.stream_adoption(rows, **how)
    sink = J.window_sink(base, counted.schema)
    J.drain(counted, sink, f"{base}/ck", "update")
    return sink.state.read(spark, "windows").select(
        "trend_id", F.date_format("start", "yyyy-MM-dd").alias("date"), "videos")


def stream_daily_rollup(spark, sf):
    return windows_kept(spark, "daily", events_stream(spark, sf).withColumnsRenamed(
        {"ts": "published_at", "event_type": "trend_id"}))


def stream_weekly_adoption(spark, sf):
    return windows_kept(spark, "weekly", events_stream(spark, sf).withColumnsRenamed(
        {"ts": "published_at", "event_type": "trend_id"}), width="7 days", slide="1 day")


def in_turns(spark, rows, turn, turns, sink, base):
    """``rows`` land turn by turn; after each, the stream drains what is new as one batch."""
    for k in range(turns):
        rows.where(turn == k).write.mode("append").parquet(f"{base}/landing")
        J.drain(J.stream_files(spark, f"{base}/landing", rows.schema), sink, f"{base}/ck")


def stream_creators(spark, sf):
    """Events land in two turns as items with their creators; creators, with the baselines of those touched."""
    base = work_dir(spark, "creators")
    zero = F.lit(0).cast("bigint")
    stored = B.table(spark, sf, "supplier").select(
        F.lit("view").alias("platform"), F.col("s_suppkey").alias("handle"), F.col("s_name").alias("display_name"),
        F.floor(F.abs("s_acctbal")).alias("followers"),
        F.when(F.col("s_suppkey") % 3 == 0, F.floor(F.abs("s_acctbal"))).otherwise(zero).alias("baseline_median_views"))
    value = F.floor(F.col("value") * 100)
    rows = B.table(spark, sf, "events").select(
        F.col("event_type").alias("platform"), F.floor(F.col("event_id") / 2).alias("external_id"),
        (F.col("event_id") * 7 % 900).alias("handle"), value.alias("views"),
        *[zero.alias(c) for c in ("likes", "comments", "shares", "saves")],
        F.col("ts").cast("timestamp").alias("published_at"),
        F.when(value % 2 == 0, "").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("display_name"),
        F.when(value % 3 == 0, zero).otherwise(value).alias("followers"), zero.alias("baseline_median_views"),
        F.col("event_id").alias("seq"))
    items = rows.limit(0).select("platform", "external_id", "handle", "views", "likes", "comments", "shares", "saves",
                                 "published_at", F.lit(None).cast("timestamp").alias("collected_at"))
    sink = J.upsert_sink(base, items, C.as_instant(B.EVENTS_NOW), stored, buckets=16)
    in_turns(spark, rows, F.col("seq") % 2, 2, sink, base)
    return sink.state.read(spark, "creators").select(
        "platform", "handle", "display_name", "followers", "baseline_median_views")


def split_events(spark, sf):
    """Events land in three turns; every seventh lands again one turn later."""
    base = work_dir(spark, "split")
    first = B.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("turn"))
    again = first.where((F.col("event_id") % 7 == 0) & (F.col("turn") < 2)).withColumn("turn", F.col("turn") + 1)
    rows = first.unionByName(again)
    in_turns(spark, rows, F.col("turn"), 3, J.split_sink(base, "ts", "10 days", ("event_id",)), base)
    return base, rows.schema


def stream_dedupe(spark, sf):
    base, schema = split_events(spark, sf)
    return J.settled(spark, base, "on_time", schema).select("event_id", "turn")


def stream_late_rows(spark, sf):
    base, schema = split_events(spark, sf)
    return J.settled(spark, base, "late", schema).select("event_id", "turn")


def stream_split_counts(spark, sf):
    base, _ = split_events(spark, sf)
    return J.read_manifest(spark, base).select("batch", day("high").alias("high"), "rows", "on_time", "late", "repeats")


def stream_velocity(spark, sf):
    rows = events_stream(spark, sf).select(
        F.col("user_id").alias("item_id"), F.col("ts").alias("captured_at"), F.col("value").alias("views"))
    base = work_dir(spark, "velocity")
    J.drain(
        J.stream_velocity(rows),
        lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}"), f"{base}/ck", "update")
    newest = spark.read.parquet(f"{base}/out").groupBy("item_id").agg(
        F.max_by(F.struct("velocity", "prior_velocity", "as_of"), "batch").alias("x"))
    return newest.select("item_id", "x.*").select(
        "item_id", r6("velocity"), r6("prior_velocity"), day("as_of").alias("as_of"))


def stream_assign(spark, sf):
    base = work_dir(spark, "assign")
    J.drain(
        table_stream(spark, sf, "embeddings").drop("label"),
        J.assign_sink(f"{base}/out", label_centers(spark, sf), ASSIGN_CUT, key="label"), f"{base}/ck")
    return spark.read.parquet(f"{base}/out").select(
        "vec_id", "label", F.round("similarity", 6).alias("similarity"))


def stream_upsert(spark, sf):
    """Events upserted into the customers' items by a stream; equals the batch upsert."""
    from formatpulse.plans.catalogue_relational import stored_items

    base = work_dir(spark, "upsert")
    rows = events_stream(spark, sf).select(
        F.col("event_type").alias("platform"), F.col("user_id").alias("external_id"),
        F.floor(F.col("value") * 100).alias("views"), (F.col("event_id") % 50).alias("likes"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("comments", "shares", "saves")],
        F.date_format("ts", "yyyy-MM-dd").alias("caption"), F.col("event_id").alias("seq"))
    sink = J.upsert_sink(base, stored_items(spark, sf), C.as_instant(B.EVENTS_NOW))
    J.drain(rows, sink, f"{base}/ck")
    return sink.state.read(spark, "items").select("platform", "external_id", "views", "likes", "caption")


def _relational():
    from formatpulse.plans.catalogue_relational import _UPSERT

    return _UPSERT


_SPLIT = """WITH first AS (SELECT event_id, ts, event_id % 3 AS turn FROM events),
    landed AS (SELECT * FROM first UNION ALL SELECT event_id, ts, turn + 1 FROM first WHERE event_id % 7 = 0 AND turn < 2),
    seen AS (SELECT k AS turn, max(ts) AS before FROM (SELECT unnest(range(0, 3)) AS k) LEFT JOIN landed ON turn < k GROUP BY k),
    marked AS (SELECT l.*, coalesce(ts < before - INTERVAL 10 DAY, false) AS late FROM landed l JOIN seen USING (turn)),
    on_time AS (SELECT event_id, min(turn) AS turn FROM marked WHERE NOT late GROUP BY event_id)"""

QUERIES = {
    "stream_creators": (stream_creators, """WITH stored AS (SELECT 'view' AS platform, s_suppkey AS handle, s_name AS display_name,
        CAST(floor(abs(s_acctbal)) AS BIGINT) AS followers,
        CASE WHEN s_suppkey % 3 = 0 THEN CAST(floor(abs(s_acctbal)) AS BIGINT) ELSE 0 END AS baseline FROM supplier),
      e AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS v, event_id * 7 % 900 AS handle, event_id // 2 AS item,
        event_id % 2 AS turn, event_type AS platform FROM events),
      said AS (SELECT platform, handle, arg_max('user ' || user_id, (turn, event_id)) FILTER (v % 2 <> 0) AS display_name,
        arg_min(CASE WHEN v % 2 = 0 THEN '' ELSE 'user ' || user_id END, (turn, event_id)) AS first_name,
        arg_max(v, (turn, event_id)) FILTER (v % 3 <> 0 AND v <> 0) AS followers,
        arg_min(CASE WHEN v % 3 = 0 THEN 0 ELSE v END, (turn, event_id)) AS first_followers, max(turn) AS last_turn,
        bool_or(turn = 0) AS in_first, bool_or(turn = 1) AS in_second FROM e GROUP BY 1, 2),
      items AS (SELECT t.k AS upto, platform, item, arg_min(handle, (turn, event_id)) AS handle,
        arg_min(ts, (turn, event_id)) AS published_at, arg_max(v, (turn, event_id)) AS views
        FROM e JOIN (SELECT unnest([0, 1]) AS k) t ON turn <= t.k GROUP BY 1, 2, 3),
      medians AS (SELECT upto, platform, handle, CAST(floor(median(views)) AS BIGINT) AS m FROM (SELECT *, row_number() OVER (
        PARTITION BY upto, platform, handle ORDER BY published_at DESC, item) AS r FROM items) WHERE r <= 30
        GROUP BY 1, 2, 3 HAVING count(*) >= 3)
      SELECT coalesce(s.platform, b.platform) AS platform, coalesce(s.handle, b.handle) AS handle,
        coalesce(b.display_name, s.display_name, b.first_name) AS display_name,
        coalesce(b.followers, s.followers, b.first_followers) AS followers,
        coalesce(nullif(s.baseline, 0), nullif(CASE WHEN in_first THEN m0.m END, 0), CASE WHEN in_second THEN m1.m END, CASE WHEN in_first THEN m0.m END, 0) AS baseline_median_views
      FROM stored s FULL JOIN said b ON s.platform = b.platform AND s.handle = b.handle
      LEFT JOIN medians m0 ON m0.upto = 0 AND m0.platform = b.platform AND m0.handle = b.handle
      LEFT JOIN medians m1 ON m1.upto = 1 AND m1.platform = b.platform AND m1.handle = b.handle"""),
    "stream_dedupe": (stream_dedupe, f"{_SPLIT} SELECT event_id, turn FROM on_time"),
    "stream_late_rows": (stream_late_rows, f"{_SPLIT} SELECT event_id, turn FROM marked WHERE late"),
    "stream_split_counts": (stream_split_counts, f"""{_SPLIT} SELECT turn AS batch, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS high,
        count(*) AS rows, (SELECT count(*) FROM on_time o WHERE o.turn = m.turn) AS on_time, count(*) FILTER (late) AS late,
        count(*) FILTER (NOT late) - (SELECT count(*) FROM on_time o WHERE o.turn = m.turn) AS repeats FROM marked m GROUP BY turn"""),
    "nightly_rebuild": (rebuild_trends, None),
    "stream_daily_rollup": (stream_daily_rollup, """SELECT event_type AS trend_id,
        strftime(ts, '%Y-%m-%d') AS date, count(*) AS videos FROM events GROUP BY 1, 2"""),
    "stream_weekly_adoption": (stream_weekly_adoption, """SELECT event_type AS trend_id,
        strftime(date_trunc('day', ts) - to_days(CAST(d AS INTEGER)), '%Y-%m-%d') AS date, count(*) AS videos
        FROM events, (SELECT unnest(range(0, 7)) AS d) GROUP BY 1, 2"""),
    "stream_velocity": (stream_velocity, sql(
        f"""SELECT item_id, round(CASE WHEN t2 > t1 THEN greatest(0.0, (v2 - v1) / {hours('t1', 't2')}) END, 6) AS velocity,
        round(CASE WHEN t1 > t0 THEN greatest(0.0, (v1 - v0) / {hours('t0', 't1')}) END, 6) AS prior_velocity,
        strftime(t2, '%Y-%m-%d %H:%M:%S') AS as_of FROM upoints""", "upoints")),
    "stream_assign": (stream_assign, sql(
        f"""SELECT vec_id, CASE WHEN s >= {ASSIGN_CUT} THEN label END AS label, round(greatest(0.0, s), 6) AS similarity FROM (
        SELECT vec_id, max(s) AS s, arg_max(label, s) AS label FROM (
        SELECT v.vec_id, c.label, list_cosine_similarity(v.v, c.c) AS s FROM vecs v, cents c) GROUP BY vec_id)""", "cents")),
    "stream_upsert": (stream_upsert,
        f"WITH {_relational()} SELECT platform, external_id, views, likes, caption FROM merged"),
}
