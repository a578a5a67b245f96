"""Domain schemas. Operators only need the columns they name; these are the full rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLATFORMS = ("instagram", "tiktok", "youtube")
STATUSES = ("emerging", "growing", "viral", "declining")
LEVELS = ("low", "medium", "high")
EMBEDDING_DIM = 768

CREATORS = (
    "creator_id string, platform string, handle string, display_name string, avatar_url string, "
    "followers bigint, baseline_median_views bigint, niche string, country string, language string"
)
ITEMS = (
    "item_id string, platform string, external_id string, creator_id string, url string, "
    "thumbnail_url string, caption string, hashtags array<string>, published_at timestamp, "
    "duration_sec double, views bigint, likes bigint, comments bigint, shares bigint, "
    "saves bigint, country string, language string, niche string, content_type string, "
    "sound_name string, collected_at timestamp"
)
METRICS = (
    "item_id string, captured_at timestamp, views bigint, likes bigint, comments bigint, "
    "shares bigint"
)
FEATURES = (
    "item_id string, hook string, topic string, content_format string, "
    "narrative_structure array<string>, speaking_style string, visual_style string, "
    "editing_patterns array<string>, caption_style string, call_to_action string, "
    "emotional_tone string, audio_style string, target_audience string, main_message string, "
    "opening_frames string, key_moments array<struct<t:double,label:string,why:string>>, "
    "transcript string, production_difficulty string, extraction_model string, "
    "is_fallback boolean, embedding array<float>"
)
RAW_ITEMS = (
    "platform string, external_id string, url string, "
    "creator struct<platform:string,handle:string,display_name:string,avatar_url:string,"
    "followers:bigint,baseline_median_views:bigint,niche:string,country:string,language:string>, "
    "published_at timestamp, duration_sec double, caption string, hashtags array<string>, "
    "thumbnail_url string, views bigint, likes bigint, comments bigint, shares bigint, "
    "saves bigint, country string, language string, niche string, content_type string, "
    "sound_name string, view_history array<struct<captured_at:timestamp,views:bigint>>"
)
PROFILES = (
    "user_id string, niche string, sub_niches array<string>, audience string, "
    "audience_age string, platforms array<string>, content_types array<string>, "
    "languages array<string>, goal string, country string, preferred_style string, "
    "production_capacity string, notes string"
)
SAVED = (
    "user_id string, entity_type string, entity_id string, note string, created_at timestamp"
)


def one_of(value: Column, domain: tuple[str, ...]) -> Column:
    """Check expression for an enumeration held as text."""
    return value.isin(*domain)


def natural_id(*parts: Column) -> Column:
    """32-hex id of a natural key, so that a re-run writes the same id."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)
