"""The gold job: corpus, clusters, signals, scores, narrative, tables. No driver-side loop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.operators import clustering as K
from formatpulse.operators import signals as G
from formatpulse.operators.aggregates import build_aggregates
from formatpulse.operators.narrative import describe_clusters
from formatpulse.operators.ranking import member_rank, top_k
from formatpulse.operators.reports import stage_report
from formatpulse.operators.scoring import score_trends
from formatpulse.operators.similarity import assign_to_existing
from formatpulse.operators.slugs import slug_dedupe
from formatpulse.operators.upserts import stale_trends
from formatpulse.schemas import natural_id
from formatpulse.session import cut, store


@dataclass(frozen=True)
class Rebuild:
    trends: DataFrame
    members: DataFrame
    snapshots: DataFrame
    stale: DataFrame | None
    report: DataFrame


def nightly_rebuild(
    items: DataFrame, features: DataFrame, creators: DataFrame, metrics: DataFrame, now,
    lookback_days: int = 30, threshold: float = K.THRESHOLD, min_size: int = K.MIN_SIZE,
    existing: DataFrame | None = None, match: str = "slug",
) -> Rebuild | str:
    """Re-cluster the window and rebuild every trend; a reason string when it may not.

    ``existing`` (trend_id, slug, first_seen_at, centroid) keeps identity across rebuilds:
    by slug, or with ``match="centroid"`` by the nearest earlier centroid, each earlier
    trend going to its closest successor.
    """
    spark = items.sparkSession
    cutoff = C.as_instant(now) - F.make_dt_interval(F.lit(lookback_days))
    # every step is stored before the next is planned: the driver holds the plan of one step, not that of the whole job
    corpus = store(G.corpus(items, features, creators, cutoff), "corpus")
    gate = K.cluster_precheck(corpus, min_size).first()
    if gate["reason"]:
        return gate["reason"]
    members, clusters = K.cluster_embeddings(corpus, threshold, min_size)
    members = cut(members)
    if clusters.isEmpty():
        return "no cluster met the minimum size"
    rows = store(corpus.drop("embedding").join(members, "item_id"), "rows")
    signals = store(G.signals(rows, G.history_for(members, metrics), now))
    scored = store(score_trends(build_aggregates(signals, now)), "scored")
    story = store(describe_clusters(rows, scored), "story")
    named = story.join(clusters.select("trend_id", "size", "centroid"), "trend_id").withColumn(
        "__small_last", -F.col("size"))
    order = ["__small_last", "trend_id"]
    if existing is not None and match == "centroid":
        near = assign_to_existing(
            named.select("trend_id", "centroid"),
            existing.select(F.col("slug").alias("kept"), "centroid"),
            threshold, ident="trend_id", vec="centroid", key="kept",
        ).filter(F.col("kept").isNotNull())
        heirs = top_k(near, ["kept"], [F.col("similarity").desc(), F.col("trend_id")], 1)
        named = (
            named.join(heirs.select("trend_id", "kept"), "trend_id", "left")
            .withColumn("__fresh", F.col("kept").isNull().cast("int"))
            .withColumn("__name", F.coalesce("kept", "name"))
        )
        named = slug_dedupe(named, "__name", ["__fresh", *order]).drop("__fresh", "__name", "kept")
    else:
        named = slug_dedupe(named, "name", order)
    named = named.drop("__small_last", "size")
    gold = scored.join(named, "trend_id").withColumn("gold_id", natural_id(F.col("slug")))
    if existing is not None:
        seen = existing.select("slug", F.col("first_seen_at").alias("__seen"))
        gold = gold.join(seen, "slug", "left")
    else:
        gold = gold.withColumn("__seen", F.lit(None).cast("timestamp"))
    gold = cut(
        gold.withColumn("first_seen_at", F.coalesce("__seen", "first_published_at"))
        .withColumn("last_computed_at", C.as_instant(now))
        .withColumnRenamed("median_creator_lift", "creator_normalized_lift")
        .drop("__seen", "first_published_at")
    )
    ids = gold.select("trend_id", "gold_id")
    lifts = signals.select("item_id", C.round_to(F.col("lift"), 3).alias("creator_lift"))
    bridge = (
        member_rank(members).join(lifts, "item_id").join(ids, "trend_id")
        .select(F.col("gold_id").alias("trend_id"), "item_id", "similarity", "is_exemplar",
                "creator_lift")
    )
    final = gold.drop("trend_id").withColumnRenamed("gold_id", "trend_id")
    snapshots = final.select(
        "trend_id", C.as_instant(now).alias("captured_at"), "video_count", "creator_count",
        "total_views", "avg_engagement_rate", "trend_score")
    return Rebuild(
        trends=final, members=bridge, snapshots=snapshots,
        stale=stale_trends(existing, final) if existing is not None else None,
        report=stage_report(spark, {"videos": gate["rows"], "trends": final.count()}),
    )
