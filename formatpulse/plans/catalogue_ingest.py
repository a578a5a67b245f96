"""Landed payloads of four kinds, made from the events, through their normalisers and the ingest job."""

from __future__ import annotations

from pyspark.sql import functions as F

from formatpulse.plans import bindings as B
from formatpulse.plans.ingest import empty_creators, empty_items, ingest
from formatpulse.session import work_dir
from formatpulse.sources import landed as L
from formatpulse.sources import normalise as N
from formatpulse.sources.registry import NotConfigured, register_source
from formatpulse.streaming.jobs import upsert_sink

NOW = B.EVENTS_NOW


def event_rows(spark, sf):
    """Events as the payloads need them; every thirteenth was collected twice."""
    e = B.table(spark, sf, "events").select(
        F.col("event_id").alias("i"), F.col("user_id").alias("u"), F.col("event_type").alias("kind"), "value",
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    return e.unionByName(e.where("i % 13 = 0"))


def land(rows, name, **fields):
    """One JSON text a row; ``fields`` are SQL expressions that give JSON values. Returns the folder."""
    parts = []
    for key, value in fields.items():
        parts += [F.lit(("{" if not parts else ", ") + f'"{key}": '), F.coalesce(F.expr(value).cast("string"), F.lit("null"))]
    path = work_dir(rows.sparkSession, name)
    rows.select(F.concat(*parts, F.lit("}")).alias("value")).write.text(path)
    return path


Q = "'\"'"


def text(value):
    return f"concat({Q}, {value}, {Q})"


#: A time as a number, as digits in a text (no epoch), or as ISO text.
WHEN = (f"CASE i % 3 WHEN 0 THEN cast(sec as string) WHEN 1 THEN {text('cast(sec as string)')} "
        f"ELSE {text('date_format(timestamp_seconds(sec), ' + chr(39) + 'yyyy-MM-dd' + chr(39) + ') || ' + chr(39) + 'T00:00:00Z' + chr(39))} END")
#: A count as a fraction, as a whole number's text, or as a fraction's text (none).
COUNT = f"CASE i % 4 WHEN 0 THEN {text(chr(39) + '3.7' + chr(39))} WHEN 1 THEN {text('cast(i % 1000 as string)')} ELSE cast(value as string) END"
CAPTION = text("concat('clip #k', cast(i % 7 as string), ' for #', kind)")


def landed_tiktok(spark, sf):
    path = land(
        event_rows(spark, sf), "tiktok", id=text("cast(i as string)"), text=CAPTION, createTime=WHEN, playCount="value * 1000",
        diggCount=COUNT, commentCount="i % 50", shareCount="null", collectCount=COUNT, isSlideshow="i % 11 = 0",
        textLanguage=text("'en-US'"), videoMeta="concat('{\"duration\": ', cast(i % 120 as string), '.5}')",
        authorMeta="concat('{\"name\": ', if(u % 10 = 0, 'null', concat('\"u', cast(u as string), '\"')), ', \"fans\": ', cast(u as string), '.9}')",
        hashtags="concat('[{\"name\": \"', kind, '\"}, {\"name\": \"\"}]')")
    return L.well_formed(L.read_landed(spark, path, "json", L.SHORT_VIDEO_ACTOR))


def landed_instagram(spark, sf):
    path = land(
        event_rows(spark, sf), "instagram", type=text("if(i % 6 = 0, 'Image', 'Video')"), shortCode=text("concat('s', cast(i as string))"),
        caption=CAPTION, ownerUsername=text("if(u % 10 = 0, '', concat('o', cast(u as string)))"), ownerFollowersCount="if(u % 10 = 0, 70, u * 10)", timestamp=WHEN,
        videoDuration=text("concat(cast(i % 100 as string), '.25')"), videoPlayCount="CASE i % 5 WHEN 0 THEN '0' WHEN 1 THEN null ELSE cast(value * 2000 as string) END",
        videoViewCount="value * 100", likesCount=COUNT, commentsCount="i % 9", hashtags="if(i % 2 = 0, '[]', '[\"given\"]')")
    return L.well_formed(L.read_landed(spark, path, "json", L.REEL_ACTOR))


def landed_provider(spark, sf):
    rows = event_rows(spark, sf)
    author = ("concat('{\"handle\": \"h', cast(u % 40 as string), '\", \"followers\": ', cast(u as string), '.2, \"median_views\": \"', "
              "cast(i % 20 as string), '\", \"country\": ', if(u % 2 = 0, '\"FR\"', 'null'), '}')")
    item = "concat('[{{\"id\": \"', cast(i as string), '\", \"views\": ', {c}, ', \"saves\": ', cast(value as string), ', \"created_at\": ', {w}, ', \"caption\": ', {t}, ', \"duration\": \"', cast(i % 60 as string), '\", \"author\": ', {a}, '}}]')"
    path = land(rows, "provider", items=item.format(c=COUNT, w=WHEN, t=CAPTION, a=author))
    return L.well_formed(L.read_landed(spark, path, "json", L.PROVIDER))


def landed_youtube(spark, sf):
    rows = event_rows(spark, sf).where("i % 13 <> 0").unionByName(event_rows(spark, sf).where("i % 13 = 0").distinct())
    details = land(
        rows, "details", id=text("concat('v', cast(i as string))"),
        snippet=("concat('{\"channelId\": \"c', cast(u % 60 as string), '\", \"title\": \" Title \", \"description\": ', " + CAPTION
                 + ", ', \"publishedAt\": ', " + WHEN + ", ', \"defaultAudioLanguage\": \"pt-BR\"}')"),
        statistics="concat('{\"viewCount\": \"', cast(i as string), '\", \"likeCount\": ', " + COUNT + ", '}')",
        contentDetails="concat('{\"duration\": \"', CASE i % 4 WHEN 0 THEN 'PT1H2M3S' WHEN 1 THEN concat('PT', cast(i % 60 as string), 'S') WHEN 2 THEN 'P1DT1S' ELSE '1:20' END, '\"}')")
    channels = land(rows.select((F.col("u") % 60).alias("c")).distinct().where("c < 50"), "channels",
                    id=text("concat('c', cast(c as string))"), snippet="concat('{\"customUrl\": \"@name', cast(c as string), '\"}')",
                    statistics="concat('{\"subscriberCount\": \"', cast(c * 7 as string), '\"}')")
    read = lambda path, shape: L.well_formed(L.read_landed(spark, path, "json", shape))
    return read(details, L.VIDEO_DETAILS), read(channels, L.CHANNELS)


def shown(raw):
    return raw.select(
        "platform", "external_id", F.col("creator.handle").alias("handle"), F.col("creator.followers").alias("followers"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "duration_sec", "caption",
        F.array_join("hashtags", ",").alias("hashtags"), "views", "likes", "comments", "shares", "saves", "country", "language")


def normalised_tiktok(spark, sf):
    return shown(N.normalise_tiktok(landed_tiktok(spark, sf), NOW, region="US"))


def normalised_instagram(spark, sf):
    return shown(N.normalise_instagram(landed_instagram(spark, sf), NOW))


def normalised_provider(spark, sf):
    return shown(N.normalise_provider(landed_provider(spark, sf), "vendor", NOW, region="DE"))


def normalised_youtube(spark, sf):
    return shown(N.normalise_youtube(*landed_youtube(spark, sf), NOW, region="BR"))


def ingested(spark, sf):
    """Short videos and reels collected as one run; the search source is not configured."""
    def missing(niche):
        raise NotConfigured("no key")
    register_source("tiktok", lambda niche: N.normalise_tiktok(landed_tiktok(spark, sf), NOW, niche))
    register_source("instagram", lambda niche: N.normalise_instagram(landed_instagram(spark, sf), NOW, niche))
    register_source("youtube", missing)
    base = work_dir(spark, "ingest")
    sink = upsert_sink(f"{base}/state", empty_items(spark), F.lit(NOW).cast("timestamp"), empty_creators(spark), buckets=16)
    report = ingest(spark, ["tiktok", "instagram", "youtube"], [None], sink, NOW, 7, f"{base}/audit", min_views=50_000)
    return sink, report


def ingest_counts(spark, sf):
    return ingested(spark, sf)[1].where("metric <> 'niche'").select("run", "stage", "metric", "value")


def ingest_creators(spark, sf):
    return ingested(spark, sf)[0].state.read(spark, "creators").select("platform", "handle", "followers", "baseline_median_views")


_E = """e AS (SELECT event_id AS i, user_id AS u, event_type AS kind, value, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events
    UNION ALL SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) FROM events WHERE event_id % 13 = 0)"""
_AT = f"""strftime(CASE i % 3 WHEN 0 THEN make_timestamp(sec * 1000000) WHEN 1 THEN TIMESTAMP '{NOW}'
    ELSE date_trunc('day', make_timestamp(sec * 1000000)) END, '%Y-%m-%d %H:%M:%S')"""
_N = "CASE i % 4 WHEN 0 THEN 0 WHEN 1 THEN i % 1000 ELSE CAST(trunc(value) AS BIGINT) END"
_TEXT = "'clip #k' || (i % 7) || ' for #' || kind"
_TIKTOK = f"""SELECT 'tiktok' AS platform, CAST(i AS VARCHAR) AS external_id, 'u' || u AS handle, u AS followers, {_AT} AS published_at,
    (i % 120) + 0.5::DOUBLE AS duration_sec, {_TEXT} AS caption, kind AS hashtags, CAST(trunc(value * 1000) AS BIGINT) AS views, {_N} AS likes,
    i % 50 AS comments, 0 AS shares, {_N} AS saves, 'US' AS country, 'en' AS language FROM e WHERE i % 11 <> 0 AND u % 10 <> 0"""
_INSTAGRAM = f"""SELECT 'instagram' AS platform, 's' || i AS external_id, CASE WHEN u % 10 = 0 THEN 'unknown' ELSE 'o' || u END AS handle,
    CASE WHEN u % 10 = 0 THEN 70 ELSE u * 10 END AS followers, {_AT} AS published_at, (i % 100) + 0.25::DOUBLE AS duration_sec, {_TEXT} AS caption,
    CASE WHEN i % 2 = 0 THEN 'k' || (i % 7) || ',' || kind ELSE 'given' END AS hashtags,
    CASE WHEN i % 5 < 2 OR trunc(value * 2000) = 0 THEN CAST(trunc(value * 100) AS BIGINT) ELSE CAST(trunc(value * 2000) AS BIGINT) END AS views,
    {_N} AS likes, i % 9 AS comments, 0 AS shares, 0 AS saves, NULL AS country, NULL AS language FROM e WHERE i % 6 <> 0"""
_GATE = f"""raw AS (SELECT * FROM tiktok UNION ALL SELECT * FROM instagram), aged AS (SELECT *, greatest(1.0::DOUBLE,
      epoch(TIMESTAMP '{NOW}' - CAST(published_at AS TIMESTAMP)) / 3600.0::DOUBLE) AS hours FROM raw),
    kept AS (SELECT * FROM aged WHERE duration_sec BETWEEN 8 AND 90 AND CAST(published_at AS TIMESTAMP) >= TIMESTAMP '{NOW}' - INTERVAL 21 DAY
      AND (views >= 50000 OR views / hours >= 500)),
    items AS (SELECT platform, external_id, any_value(handle) AS handle, any_value(published_at) AS published_at, any_value(views) AS views,
      count(*) AS n FROM kept GROUP BY 1, 2),
    base AS (SELECT platform, handle, CAST(floor(median(views)) AS BIGINT) AS m FROM (SELECT *, row_number() OVER (PARTITION BY platform, handle
      ORDER BY published_at DESC, external_id) AS r FROM items) WHERE r <= 30 GROUP BY 1, 2 HAVING count(*) >= 3),
    people AS (SELECT platform, handle, max(followers) AS followers, coalesce(any_value(m), 0) AS baseline_median_views
      FROM kept LEFT JOIN base USING (platform, handle) GROUP BY 1, 2)"""
_RUN = f"WITH {_E}, tiktok AS ({_TIKTOK}), instagram AS ({_INSTAGRAM}), {_GATE}"

QUERIES = {
    "normalised_tiktok": (normalised_tiktok, f"WITH {_E} {_TIKTOK}"),
    "normalised_instagram": (normalised_instagram, f"WITH {_E} {_INSTAGRAM}"),
    "normalised_provider": (normalised_provider, f"""WITH {_E} SELECT 'vendor' AS platform, CAST(i AS VARCHAR) AS external_id, 'h' || (u % 40) AS handle,
        u AS followers, {_AT} AS published_at, (i % 60)::DOUBLE AS duration_sec, {_TEXT} AS caption, 'k' || (i % 7) || ',' || kind AS hashtags,
        {_N} AS views, 0 AS likes, 0 AS comments, 0 AS shares, CAST(trunc(value) AS BIGINT) AS saves,
        CASE WHEN u % 2 = 0 THEN 'FR' ELSE 'DE' END AS country, 'en' AS language FROM e"""),
    "normalised_youtube": (normalised_youtube, f"""WITH {_E}, once AS (SELECT DISTINCT * FROM e) SELECT 'youtube' AS platform, 'v' || i AS external_id,
        CASE WHEN u % 60 < 50 THEN 'name' || (u % 60) ELSE 'c' || (u % 60) END AS handle, CASE WHEN u % 60 < 50 THEN (u % 60) * 7 ELSE 0 END AS followers,
        {_AT} AS published_at, CASE i % 4 WHEN 0 THEN 3723 WHEN 1 THEN i % 60 WHEN 2 THEN 86401 ELSE 0 END::DOUBLE AS duration_sec,
        'Title ' || chr(10) || {_TEXT} AS caption, 'k' || (i % 7) || ',' || kind AS hashtags, i AS views, {_N} AS likes, 0 AS comments, 0 AS shares,
        0 AS saves, 'BR' AS country, 'pt' AS language FROM once"""),
    "ingest_counts": (ingest_counts, f"""{_RUN} SELECT 7 AS run, stage, metric, CAST(value AS VARCHAR) AS value FROM (
        SELECT 'normalised' AS stage, 'rows' AS metric, count(*)::BIGINT::VARCHAR AS value FROM raw
        UNION ALL SELECT 'normalised', 'views', sum(views)::BIGINT::VARCHAR FROM raw UNION ALL SELECT 'kept', 'rows', count(*)::BIGINT::VARCHAR FROM kept
        UNION ALL SELECT 'kept', 'views', sum(views)::BIGINT::VARCHAR FROM kept UNION ALL SELECT 'upserted', 'ingested', count(*)::BIGINT::VARCHAR FROM items
        UNION ALL SELECT 'upserted', 'updated', (sum(n) - count(*))::BIGINT::VARCHAR FROM items
        UNION ALL SELECT 'creators', 'rows', count(*)::BIGINT::VARCHAR FROM people
        UNION ALL SELECT 'creators', 'with_baseline', count(*) FILTER (baseline_median_views > 0)::BIGINT::VARCHAR FROM people
        UNION ALL SELECT 'skipped youtube', 'reason', 'no key')"""),
    "ingest_creators": (ingest_creators, f"{_RUN} SELECT * FROM people"),
}
