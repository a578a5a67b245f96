"""Reading landed payload files, with fixed schemas and parse helpers that never fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formatpulse.functions import curves as C

# Shapes of the landed payloads. Loose fields are parsed here; those where a number
# and its text mean different things are read as variants.
PROVIDER = (
    "items array<struct<id:string,url:string,caption:string,created_at:variant,duration:string,"
    "views:variant,likes:variant,comments:variant,shares:variant,saves:variant,thumbnail:string,"
    "sound:string,hashtags:array<string>,author:struct<handle:string,name:string,avatar:string,"
    "followers:variant,median_views:variant,country:string,language:string>>>"
)
VIDEO_DETAILS = (
    "id string, snippet struct<channelId:string,channelTitle:string,publishedAt:variant,"
    "title:string,description:string,defaultAudioLanguage:string,"
    "thumbnails:struct<high:struct<url:string>>>, "
    "statistics struct<viewCount:variant,likeCount:variant,commentCount:variant>, "
    "contentDetails struct<duration:string>"
)
CHANNELS = (
    "id string, snippet struct<customUrl:string,country:string,"
    "thumbnails:struct<default:struct<url:string>>>, statistics struct<subscriberCount:variant>"
)
SHORT_VIDEO_ACTOR = (
    "id string, text string, webVideoUrl string, createTimeISO variant, createTime variant, "
    "playCount variant, diggCount variant, commentCount variant, shareCount variant, "
    "collectCount variant, isSlideshow boolean, textLanguage string, "
    "authorMeta struct<name:string,uniqueId:string,nickName:string,avatar:string,fans:variant,"
    "region:string>, videoMeta struct<duration:string,coverUrl:string,originalCoverUrl:string>, "
    "musicMeta struct<musicName:string>, hashtags array<struct<name:string>>"
)
REEL_ACTOR = (
    "type string, shortCode string, url string, caption string, ownerUsername string, "
    "ownerFullName string, ownerFollowersCount variant, timestamp variant, videoDuration string, "
    "hashtags array<string>, displayUrl string, videoPlayCount variant, videoViewCount variant, "
    "likesCount variant, commentsCount variant, sharesCount variant, "
    "musicInfo struct<song_name:string>"
)


#: Variant fields that hold times; the others hold counts.
TIMES = ("created_at", "createTime", "createTimeISO", "publishedAt", "timestamp")
#: What digits in a text of a time gain in front.
MARK = "text "


def seconds_of(text: Column) -> Column:
    """Text as a number of seconds. Texts with a colon, as times have, and marked digits are none and are not tried, as a
    cast that fails costs far more than these looks."""
    return F.when(~text.contains(":") & ~text.startswith(MARK), text.try_cast("double"))


def _told(number: Column, is_text: Column, text: Column, name: str) -> Column:
    """A loose value as text that tells numbers from text: counts lose their fraction, numeric times
    become ISO text; text stays as it is, but digits are no epoch, so they gain a mark that no
    time has."""
    if name in TIMES:
        told = F.date_format(F.timestamp_seconds(number), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        digits = F.when(seconds_of(text).isNotNull(), F.concat(F.lit(MARK), text)).otherwise(text)
        return F.when(is_text, digits).otherwise(told)
    return F.when(is_text, text).otherwise(F.coalesce(number.try_cast("bigint").cast("string"), text))


def _plain(value: Column | None, have: T.DataType | None, want: T.DataType, name: str) -> Column:
    """``value`` of type ``have`` (absent if None) as the landed shape ``want`` has it, loose values told apart."""
    if isinstance(want, T.StructType):
        fields = {f.name: f.dataType for f in have.fields} if isinstance(have, T.StructType) else {}
        inner = F.struct(*[_plain(value[f.name] if f.name in fields else None, fields.get(f.name), f.dataType, f.name).alias(f.name)
                           for f in want.fields])
        return F.when(value.isNotNull() if fields else F.lit(False), inner)
    if isinstance(want, T.ArrayType) and isinstance(want.elementType, T.StructType):
        if not isinstance(have, T.ArrayType):
            return F.transform(F.lit(None).cast("array<string>"), lambda x: _plain(None, None, want.elementType, name))
        return F.transform(value, lambda x: _plain(x, have.elementType, want.elementType, name))
    if value is None:
        return F.lit(None).cast("string" if isinstance(want, T.VariantType) else want)
    if not isinstance(want, T.VariantType):
        return value if have == want else value.try_cast(want)
    if isinstance(have, T.VariantType):
        return _told(F.try_variant_get(value, "$", "double"), F.schema_of_variant(value) == "STRING",
                     F.try_variant_get(value, "$", "string"), name)
    if isinstance(have, T.NumericType):
        return _told(value.cast("double"), F.lit(False), value.cast("string"), name)
    if isinstance(have, T.TimestampType) and name in TIMES:
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return _told(F.lit(None).cast("double"), F.lit(True), value.cast("string"), name)


def read_landed(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    """Landed files in a fixed shape. Broken JSON lines stay visible in ``_corrupt_record``. Files of other formats bring
    types of their own: numbers and texts are told apart by these, and fields they lack are null."""
    want = T.StructType.fromDDL(schema)
    if fmt == "json":
        rows = spark.read.schema(schema + ", _corrupt_record string").json(path, mode="PERMISSIVE")
        want = rows.schema
    else:
        rows = spark.read.format(fmt).load(path)
    have = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*[_plain(F.col(f.name) if f.name in have else None, have.get(f.name), f.dataType, f.name).alias(f.name)
                         for f in want.fields])


def well_formed(landed: DataFrame) -> DataFrame:
    if "_corrupt_record" not in landed.columns:
        return landed
    return landed.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def parse_event_time(value: Column, now) -> Column:
    """Epoch seconds or ISO text as a timestamp; anything else counts as seen now."""
    text = value.cast("string")
    return F.coalesce(
        F.timestamp_seconds(seconds_of(text)),
        F.try_to_timestamp(text),
        C.as_instant(now),
    )


def safe_int(value: Column) -> Column:
    """Whole number, or 0 for anything that is not one."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0))


def safe_double(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def parse_iso8601_duration(value: Column) -> Column:
    """PnDTnHnMnS in seconds; 0 unless the whole text has that form."""
    whole = r"^P(?:(\d+)D)?T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    text = F.coalesce(value, F.lit(""))
    seconds = F.lit(0).cast("bigint")
    for group, unit in ((1, 86_400), (2, 3_600), (3, 60), (4, 1)):
        seconds = seconds + F.coalesce(
            F.regexp_extract(text, whole, group).try_cast("bigint"), F.lit(0)
        ) * unit
    return F.when(text.rlike(whole), seconds).otherwise(F.lit(0)).cast("double")


def or_else(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
