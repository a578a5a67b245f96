"""Upserts and change logs as keyed aggregates joined to what is stored.

Plain Parquet has no MERGE, so every operator returns the next full state. Batches are
reduced to one row per key by map-side combined aggregates before the join, which keeps
a key that fills the batch from reaching one task row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.functions.curves import truthy

COUNTERS = ("views", "likes", "comments", "shares", "saves")


def _said(c: str) -> Column:
    """The value where the source said something, else null."""
    return truthy(F.col(c), F.lit(None))


def _last_said(c: str, order: str) -> Column:
    said = _said(c)
    return F.max_by(said, F.when(said.isNotNull(), F.col(order)))


def upsert_creators(
    existing: DataFrame, incoming: DataFrame, order: str = "seq",
    keys: tuple[str, ...] = ("platform", "handle"),
) -> DataFrame:
    """Insert or update by key. Followers, display name, avatar and baseline change only
    to a value the source actually gave; every other field is set on insert only. A new key
    takes its first row's values, zeros and empty texts included, before later ones apply."""
    live = [c for c in ("followers", "display_name", "avatar_url", "baseline_median_views")
            if c in existing.columns]
    fixed = [c for c in existing.columns if c not in live and c not in keys]
    batch = incoming.groupBy(*keys).agg(
        *[_last_said(c, order).alias(f"__new_{c}") for c in live],
        *[F.min_by(F.struct(F.col(c)), order)[c].alias(f"__first_{c}") for c in (*live, *fixed)],
        F.lit(True).alias("__in"),
    )
    stored = existing.withColumn("__old", F.lit(True))
    joined = stored.join(batch, list(keys), "full_outer")
    is_old = F.col("__old").isNotNull()
    return joined.select(
        *[
            c if c in keys
            else F.coalesce(
                F.col(f"__new_{c}"), F.when(is_old, F.col(c)).otherwise(F.col(f"__first_{c}"))
            ).alias(c) if c in live
            else F.when(is_old, F.col(c)).otherwise(F.col(f"__first_{c}")).alias(c)
            for c in existing.columns
        ]
    )


def upsert_items(
    existing: DataFrame, incoming: DataFrame, now: Column, order: str = "seq",
    keys: tuple[str, ...] = ("platform", "external_id"),
    counters: tuple[str, ...] = COUNTERS,
) -> DataFrame:
    """Insert by key, or update counters and ``collected_at`` only.

    Adds ``change`` (inserted/updated/kept) and ``batch_rows``, from which
    :func:`upsert_counts` gives the ingested and updated totals.
    """
    fixed = [c for c in existing.columns if c not in counters + keys + ("collected_at",)]
    batch = incoming.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batch_rows"),
        *[F.max_by(F.struct(F.col(c)), order)[c].alias(f"__new_{c}") for c in counters],
        *[F.min_by(F.struct(F.col(c)), order)[c].alias(f"__new_{c}") for c in fixed],
    )
    joined = existing.withColumn("__old", F.lit(True)).join(batch, list(keys), "full_outer")
    is_old, is_new = F.col("__old").isNotNull(), F.col("batch_rows").isNotNull()
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == "collected_at":
            out.append(F.when(is_new, now).otherwise(F.col(c)).alias(c))
        elif c in counters:
            out.append(F.when(is_new, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(is_old, F.col(c)).otherwise(F.col(f"__new_{c}")).alias(c))
    change = F.when(is_old & is_new, "updated").when(is_new, "inserted").otherwise("kept")
    return joined.select(
        *out, change.alias("change"), F.coalesce("batch_rows", F.lit(0)).alias("batch_rows")
    )


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """Ingested keys, and batch rows that hit a key already there (repeats included)."""
    inserted = F.count_if(F.col("change") == "inserted")
    return upserted.agg(
        inserted.alias("ingested"),
        (F.coalesce(F.sum("batch_rows"), F.lit(0)) - inserted).alias("updated"),
    )


def append_metrics(incoming: DataFrame, now: Column) -> DataFrame:
    """One snapshot per collected row, plus the history the provider sent (duplicates kept)."""
    current = incoming.select(
        "item_id", now.alias("captured_at"), "views", "likes", "comments", "shares"
    )
    if "view_history" not in incoming.columns:
        return current
    past = incoming.select("item_id", F.explode("view_history").alias("h")).select(
        "item_id", F.col("h.captured_at").alias("captured_at"), F.col("h.views").alias("views")
    )
    return union_history(current, past)


def union_history(snapshots: DataFrame, provider_history: DataFrame) -> DataFrame:
    """Provider history has views only; the other counters are stored as zero."""
    both = snapshots.unionByName(provider_history, allowMissingColumns=True)
    return both.fillna(0, [c for c in ("likes", "comments", "shares") if c in both.columns])


def touched_creators(batch: DataFrame) -> DataFrame:
    return batch.select("creator_id").distinct()


def pending(items: DataFrame, features: DataFrame, limit: int | None = None) -> DataFrame:
    """Items without features, newest first."""
    todo = items.join(features.select("item_id"), "item_id", "left_anti")
    if limit is None:
        return todo
    return todo.orderBy(F.col("published_at").desc(), F.col("item_id")).limit(limit)


def upgrade_queue(
    items: DataFrame, features: DataFrame, members: DataFrame, limit: int | None = None
) -> DataFrame:
    """Fallback rows to redo: exemplars first, then any trend member, then the rest."""
    seen = members.groupBy("item_id").agg(F.bool_or("is_exemplar").alias("is_exemplar"))
    queue = (
        items.join(features.filter("is_fallback").select("item_id"), "item_id", "left_semi")
        .join(seen, "item_id", "left")
        .withColumn("is_member", F.col("is_exemplar").isNotNull())
        .withColumn("is_exemplar", F.coalesce("is_exemplar", F.lit(False)))
    )
    if limit is None:
        return queue
    return queue.orderBy(
        F.col("is_exemplar").desc(), F.col("is_member").desc(),
        F.col("published_at").desc(), F.col("item_id"),
    ).limit(limit)


def upgrade_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace a stored row only by a new row that is not itself a fallback."""
    better = new.filter(~F.col("is_fallback")).select(
        "item_id", *[F.col(c).alias(f"__new_{c}") for c in new.columns if c != "item_id"],
        F.lit(True).alias("__up"),
    )
    use_new = F.col("__up").isNotNull()
    return old.join(better, "item_id", "left").select(
        *[
            F.when(use_new, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
            if c != "item_id" and c in new.columns else c
            for c in old.columns
        ]
    )


def stale_trends(existing: DataFrame, kept: DataFrame, key: str = "slug") -> DataFrame:
    return existing.join(kept.select(key), key, "left_anti")


def ensure_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Stored profiles plus an empty one for every user without; defaults filled on read."""
    missing = users.select("user_id").distinct().join(
        profiles.select("user_id"), "user_id", "left_anti"
    )
    return profile_defaults(profiles.unionByName(missing, allowMissingColumns=True))


def profile_defaults(profiles: DataFrame) -> DataFrame:
    langs = F.col("languages")
    return profiles.withColumn(
        "languages",
        F.when(F.coalesce(F.size(langs), F.lit(0)) > 0, langs).otherwise(F.array(F.lit("en"))),
    ).withColumn(
        "production_capacity",
        F.coalesce(F.nullif(F.col("production_capacity"), F.lit("")), F.lit("medium")),
    )


def update_profiles(profiles: DataFrame, patches: DataFrame, order: str = "seq") -> DataFrame:
    """Apply set-fields-only patches; ``fields`` names what a patch sets (null included)."""
    names = [c for c in profiles.columns if c != "user_id" and c in patches.columns]
    last = []
    for c in names:
        sets = F.array_contains("fields", c)
        last.append(
            F.max_by(F.struct(F.col(c).alias("v")), F.when(sets, F.col(order))).alias(f"__new_{c}")
        )
    batch = patches.groupBy("user_id").agg(*last)
    return profiles.join(batch, "user_id", "full_outer").select(
        "user_id",
        *[
            F.when(F.col(f"__new_{c}").isNotNull(), F.col(f"__new_{c}")["v"])
            .otherwise(F.col(c)).alias(c) if c in names else F.col(c)
            for c in profiles.columns if c != "user_id"
        ],
    )


def merge_profile(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """Profile as one request sees it: truthy request fields win, platform becomes the list."""
    over = [c for c in ("niche", "audience", "audience_age", "goal", "preferred_style",
                        "production_capacity") if c in requests.columns]
    asked = requests.select(
        "user_id", *[F.col(c).alias(f"__r_{c}") for c in over],
        F.nullif(F.col("platform"), F.lit("")).alias("__platform"),
        (F.col("languages") if "languages" in requests.columns
         else F.lit(None).cast("array<string>")).alias("__langs"),
        *([F.col("topic")] if "topic" in requests.columns else []),
    )
    joined = profile_defaults(profiles).join(asked, "user_id", "left")
    merged = [
        F.coalesce(F.nullif(F.col(f"__r_{c}"), F.lit("")), F.col(c)).alias(c) if c in over
        else F.when(F.col("__platform").isNotNull(), F.array("__platform"))
        .otherwise(F.col(c)).alias(c) if c == "platforms"
        else F.when(F.coalesce(F.size("__langs"), F.lit(0)) > 0, F.col("__langs"))
        .otherwise(F.col(c)).alias(c) if c == "languages"
        else F.col(c)
        for c in profiles.columns
    ]
    return joined.select(
        *merged,
        F.coalesce("__platform", F.try_element_at("platforms", F.lit(1))).alias("platform"),
        *(["topic"] if "topic" in requests.columns else []),
    )


SAVED_KEYS = ("user_id", "entity_type", "entity_id")


def apply_changes(saved: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Saved items after a log of ``save``/``delete`` changes.

    Saving again is idempotent and keeps the earlier note when the new one is empty; a
    delete forgets what came before it.
    """
    keys = list(SAVED_KEYS)
    stored = saved.select(
        *keys, "note", "created_at", F.lit("save").alias("op"), F.lit(-1).cast("bigint").alias(order)
    )
    log = stored.unionByName(changes.select(*keys, "note", "created_at", "op", order))
    wiped = log.filter("op = 'delete'").groupBy(*keys).agg(F.max(order).alias("__wiped"))
    alive = log.filter("op = 'save'").join(wiped, keys, "left").filter(
        F.col("__wiped").isNull() | (F.col(order) > F.col("__wiped"))
    )
    return alive.groupBy(*keys).agg(
        _last_said("note", order).alias("note"), F.min_by("created_at", order).alias("created_at")
    )


def saved_resolved(saved: DataFrame, trends: DataFrame, plans: DataFrame) -> DataFrame:
    """Saved rows with the trend name or plan title they point to; other kinds stay open."""
    kind, ref = F.col("entity_type"), F.col("entity_id")
    t = trends.select(F.col("trend_id").alias("__t"), F.col("name").alias("trend_name"))
    p = plans.select(F.col("plan_id").alias("__p"), F.col("title").alias("plan_title"))
    return (
        saved.join(t, (kind == "trend") & (ref == F.col("__t")), "left")
        .join(p, (kind == "scenario") & (ref == F.col("__p")), "left")
        .drop("__t", "__p")
    )
