"""Payloads of four source kinds as one row shape (``schemas.RAW_ITEMS``).

Each normaliser is a projection; only the search form joins (details with channels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.functions.text import extract_hashtags
from formatpulse.schemas import natural_id
from formatpulse.sources.landed import (
    or_else, parse_event_time, parse_iso8601_duration, safe_double, safe_int,
)

SHORTS_CAP_SECONDS = 180.0
HISTORY = "array<struct<captured_at:timestamp,views:bigint>>"


def text(value) -> Column:
    return F.lit(value).cast("string")


def _creator(platform: str, handle: Column, **fields: Column) -> Column:
    get = lambda name, kind: fields.get(name, F.lit(None)).cast(kind).alias(name)
    return F.struct(
        text(platform).alias("platform"), handle.alias("handle"),
        get("display_name", "string"), get("avatar_url", "string"),
        F.coalesce(fields.get("followers", F.lit(0)), F.lit(0)).cast("bigint").alias("followers"),
        F.coalesce(fields.get("baseline_median_views", F.lit(0)), F.lit(0)).cast("bigint").alias(
            "baseline_median_views"),
        get("niche", "string"), get("country", "string"), get("language", "string"),
    ).alias("creator")


def _tags(listed: Column, caption: Column) -> Column:
    return F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(
        extract_hashtags(caption))


def _raw(**c: Column) -> list[Column]:
    """Columns in schema order; counters default to zero, text to null."""
    def of(name, kind, default=None):
        return c.get(name, F.lit(default)).cast(kind).alias(name)

    return [
        of("platform", "string"), of("external_id", "string"), of("url", "string"), c["creator"],
        of("published_at", "timestamp"), of("duration_sec", "double", 0.0), of("caption", "string"),
        of("hashtags", "array<string>"), of("thumbnail_url", "string"),
        *[of(n, "bigint", 0) for n in ("views", "likes", "comments", "shares", "saves")],
        of("country", "string"), of("language", "string"), of("niche", "string"),
        of("content_type", "string"), of("sound_name", "string"), of("view_history", HISTORY),
    ]


def normalise_provider(
    landed: DataFrame, platform: str, now, niche: str | None = None, region: str | None = None
) -> DataFrame:
    """Vendor envelopes ``{items: [...]}``."""
    rows = landed.select(F.explode("items").alias("i"))
    i, a = F.col("i"), F.col("i.author")
    country = or_else(a["country"], text(region))
    caption = F.coalesce(i["caption"], F.lit(""))
    return rows.select(*_raw(
        platform=text(platform), external_id=i["id"], url=F.coalesce(i["url"], F.lit("")),
        creator=_creator(
            platform, F.coalesce(or_else(a["handle"]), F.lit("unknown")), display_name=a["name"],
            avatar_url=a["avatar"], followers=safe_int(a["followers"]),
            baseline_median_views=safe_int(a["median_views"]), niche=text(niche),
            country=country, language=a["language"]),
        published_at=parse_event_time(i["created_at"], now),
        duration_sec=safe_double(i["duration"]), caption=caption,
        hashtags=_tags(i["hashtags"], caption), thumbnail_url=i["thumbnail"],
        **{n: safe_int(i[n]) for n in ("views", "likes", "comments", "shares", "saves")},
        country=country, language=F.coalesce(or_else(a["language"]), F.lit("en")),
        niche=text(niche), sound_name=i["sound"],
    ))


def normalise_youtube(
    details: DataFrame, channels: DataFrame, now, niche: str | None = None,
    region: str | None = None, language: str | None = None,
) -> DataFrame:
    """Video details with their channel; shares and saves are not offered there."""
    ch = channels.select(F.col("id").alias("__channel"), F.col("snippet").alias("cs"),
                         F.col("statistics").alias("cst"))
    rows = details.join(ch, F.col("snippet.channelId") == F.col("__channel"), "left")
    s, st = F.col("snippet"), F.col("statistics")
    caption = F.concat(F.coalesce(s["title"], F.lit("")), F.lit("\n"),
                       F.coalesce(s["description"], F.lit("")))
    spoken = or_else(s["defaultAudioLanguage"], text(language), F.lit("en"))
    return rows.select(*_raw(
        platform=text("youtube"), external_id=F.col("id"),
        url=F.concat(F.lit("https://www.youtube.com/shorts/"), F.col("id")),
        creator=_creator(
            "youtube", F.ltrim(or_else(F.col("cs.customUrl"), s["channelId"]), F.lit("@")),
            display_name=s["channelTitle"], avatar_url=F.col("cs.thumbnails.default.url"),
            followers=safe_int(F.col("cst.subscriberCount")), niche=text(niche),
            country=F.col("cs.country"), language=s["defaultAudioLanguage"]),
        published_at=parse_event_time(s["publishedAt"], now),
        duration_sec=parse_iso8601_duration(F.col("contentDetails.duration")),
        caption=F.regexp_replace(caption, r"(?U)^\s+|\s+$", ""),
        hashtags=extract_hashtags(s["description"]), thumbnail_url=s["thumbnails"]["high"]["url"],
        views=safe_int(st["viewCount"]), likes=safe_int(st["likeCount"]),
        comments=safe_int(st["commentCount"]), country=text(region),
        language=F.split_part(spoken, F.lit("-"), F.lit(1)), niche=text(niche),
    ))


def normalise_tiktok(
    landed: DataFrame, now, niche: str | None = None, region: str | None = None
) -> DataFrame:
    """Short-video actor rows; slideshows and rows without handle or id are left out."""
    a, m = F.col("authorMeta"), F.col("videoMeta")
    handle = or_else(a["name"], a["uniqueId"])
    country = or_else(a["region"], text(region))
    names = F.filter(F.transform("hashtags", lambda h: h["name"]),
                     lambda n: F.coalesce(n, F.lit("")) != "")
    kept = landed.filter(
        ~F.coalesce(F.col("isSlideshow"), F.lit(False)) & handle.isNotNull()
        & (F.coalesce(F.col("id"), F.lit("")) != ""))
    return kept.select(*_raw(
        platform=text("tiktok"), external_id=F.col("id"),
        url=F.coalesce(or_else(F.col("webVideoUrl")), F.concat(
            F.lit("https://www.tiktok.com/@"), handle, F.lit("/video/"), F.col("id"))),
        creator=_creator("tiktok", handle, display_name=a["nickName"], avatar_url=a["avatar"],
                         followers=safe_int(a["fans"]), niche=text(niche), country=country),
        published_at=parse_event_time(or_else(F.col("createTimeISO"), F.col("createTime")), now),
        duration_sec=safe_double(m["duration"]), caption=F.col("text"),
        hashtags=F.coalesce(names, F.array().cast("array<string>")),
        thumbnail_url=or_else(m["coverUrl"], m["originalCoverUrl"]),
        views=safe_int(F.col("playCount")), likes=safe_int(F.col("diggCount")),
        comments=safe_int(F.col("commentCount")), shares=safe_int(F.col("shareCount")),
        saves=safe_int(F.col("collectCount")), country=country,
        language=or_else(F.split_part(F.coalesce("textLanguage", F.lit("")), F.lit("-"), F.lit(1))),
        niche=text(niche), sound_name=F.col("musicMeta.musicName"),
    ))


def normalise_instagram(
    landed: DataFrame, now, niche: str | None = None, region: str | None = None
) -> DataFrame:
    """Reel actor rows: videos with a short code; plays count before stricter views."""
    kept = landed.filter((F.col("type") == "Video") & (F.coalesce("shortCode", F.lit("")) != ""))
    caption = F.coalesce("caption", F.lit(""))
    plays = safe_int(F.coalesce(F.nullif(or_else(F.col("videoPlayCount")), F.lit("0")),
                                F.col("videoViewCount")))
    return kept.select(*_raw(
        platform=text("instagram"), external_id=F.col("shortCode"),
        url=F.coalesce(or_else(F.col("url")), F.concat(
            F.lit("https://www.instagram.com/reel/"), F.col("shortCode"), F.lit("/"))),
        creator=_creator(
            "instagram", F.coalesce(or_else(F.col("ownerUsername")), F.lit("unknown")),
            display_name=F.col("ownerFullName"), followers=safe_int(F.col("ownerFollowersCount")),
            niche=text(niche), country=text(region)),
        published_at=parse_event_time(F.col("timestamp"), now),
        duration_sec=safe_double(F.col("videoDuration")), caption=caption,
        hashtags=_tags(F.col("hashtags"), caption), thumbnail_url=F.col("displayUrl"),
        views=plays, likes=safe_int(F.col("likesCount")),
        comments=safe_int(F.col("commentsCount")), shares=safe_int(F.col("sharesCount")),
        country=text(region), niche=text(niche), sound_name=F.col("musicInfo.song_name"),
    ))


def creators_of(raw: DataFrame) -> DataFrame:
    """Creator batch rows with ids from the natural key."""
    return raw.select("creator.*", *[c for c in raw.columns if c == "seq"]).withColumn(
        "creator_id", natural_id(F.col("platform"), F.col("handle")))


def items_of(raw: DataFrame) -> DataFrame:
    """Item batch rows with ids from natural keys."""
    return raw.withColumn("item_id", natural_id(F.col("platform"), F.col("external_id"))).withColumn(
        "creator_id", natural_id(F.col("platform"), F.col("creator.handle"))).drop("creator")
