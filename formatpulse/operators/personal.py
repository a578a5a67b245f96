"""Relevance of trends to profiles and per-profile ranked feeds.

The feed's pool of candidate trends is a top-k by definition (120, or 40 for a single
pick), so it travels to the profiles as one array of at most that many structs. Profiles
whose scored traits are equal are scored once, and each keeps its top rows in the map
tasks already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.functions.curves import round_to
from formatpulse.functions.arrays import empty_strings, lowered
from formatpulse.operators.ranking import top_k
from formatpulse.session import store

# Niches that share formats, effort ranks, goal boosts.
ADJACENT_NICHES = {
    "ai": ("technology", "productivity", "business", "startups"),
    "technology": ("ai", "productivity", "gaming"),
    "productivity": ("ai", "business", "education", "technology"),
    "business": ("startups", "productivity", "finance", "marketing"),
    "startups": ("business", "ai", "marketing"),
    "marketing": ("business", "startups", "design"),
    "finance": ("business", "education"),
    "fitness": ("health", "food", "lifestyle"),
    "health": ("fitness", "food"),
    "food": ("lifestyle", "health"),
    "beauty": ("fashion", "lifestyle"),
    "fashion": ("beauty", "lifestyle", "design"),
    "design": ("technology", "marketing", "fashion"),
    "education": ("productivity", "technology", "finance"),
    "gaming": ("technology", "entertainment"),
    "travel": ("lifestyle", "food"),
    "lifestyle": ("travel", "food", "fashion", "beauty"),
}
EFFORT = {"low": 0, "medium": 1, "high": 2}
GOALS = {
    "brand_growth": ("cross_platform", 0.08),
    "audience_growth": ("growth", 0.12),
    "sales": ("engagement", 0.10),
    "authority": ("adaptability", 0.08),
    "community": ("engagement", 0.12),
}
FEED_POOL = 120
PICK_POOL = 40


def adjacent_niches(niche: Column) -> Column:
    table = F.create_map(
        *[x for k, v in ADJACENT_NICHES.items()
          for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))]
    )
    return F.coalesce(F.try_element_at(table, niche), empty_strings())


def _effort(level: Column) -> Column:
    return (
        F.when(level == "low", F.lit(0)).when(level == "high", F.lit(2)).otherwise(F.lit(1))
    )


def _candidates(trends: DataFrame) -> DataFrame:
    components = F.transform(
        F.col("score_breakdown.opportunity_score.components"),
        lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value")),
    )
    return trends.select(
        "trend_id", "opportunity_score", "adaptability", "production_difficulty",
        lowered(F.col("niches")).alias("niches"),
        lowered(F.col("platforms")).alias("platforms"),
        lowered(F.col("languages")).alias("languages"),
        lowered(F.col("content_types")).alias("content_types"),
        F.map_from_entries(components).alias("components"),
    )


def _as_pool(candidates: DataFrame) -> Column:
    """A bounded set of candidate trends as one array, fetched once per query."""
    return candidates.agg(
        F.collect_list(F.struct(*candidates.columns)).alias("pool")
    ).scalar()


def _prepared(profiles: DataFrame) -> DataFrame:
    """Lower-case the profile side once per profile, not once per trend."""
    niche = F.lower(F.coalesce(F.col("niche"), F.lit("")))
    return profiles.select(
        "user_id",
        niche.alias("p_niche"),
        adjacent_niches(niche).alias("p_adjacent"),
        F.array_distinct(lowered(F.col("platforms"))).alias("p_platforms"),
        F.array_distinct(lowered(F.col("languages"))).alias("p_languages"),
        F.array_distinct(lowered(F.col("content_types"))).alias("p_types"),
        _effort(F.col("production_capacity")).alias("p_capacity"),
        F.coalesce(F.col("goal"), F.lit("")).alias("p_goal"),
    )


def _matched(t: Column) -> Column:
    """Overlaps of one trend with the profile columns, as fields for the steps after it."""
    return F.struct(
        t["trend_id"].alias("trend_id"),
        t["opportunity_score"].alias("opportunity_score"),
        t["adaptability"].alias("adaptability"),
        t["components"].alias("components"),
        _effort(t["production_difficulty"]).alias("effort"),
        ((F.col("p_niche") != "") & F.array_contains(t["niches"], F.col("p_niche"))).alias("exact"),
        F.array_min(F.array_intersect(F.col("p_adjacent"), t["niches"])).alias("adjacent"),
        F.array_sort(F.array_intersect(F.col("p_platforms"), t["platforms"])).alias("platforms"),
        (F.size("p_languages") == 0).alias("any_language"),
        F.arrays_overlap(F.col("p_languages"), t["languages"]).alias("language"),
        (F.size(t["languages"]) > 0).alias("has_language"),
        F.array_min(F.array_intersect(F.col("p_types"), t["content_types"])).alias("type"),
    )


def _relevance(m: Column, use_breakdown: bool) -> Column:
    goal = F.lit(0.0)
    for name, (signal, weight) in GOALS.items():
        value = (
            F.coalesce(F.try_element_at(m["components"], F.lit(signal)), F.lit(0.5))
            if use_breakdown else F.lit(0.5)
        )
        goal = F.when(F.col("p_goal") == name, F.lit(weight) * value).otherwise(goal)
    shared = F.size(m["platforms"])
    score = (
        F.when(m["exact"], 0.40).when(m["adjacent"].isNotNull(), 0.26)
        .when(m["adaptability"] == "high", 0.16).otherwise(0.0)
        + F.when(shared > 1, 0.22).when(shared == 1, 0.17).otherwise(0.0)
        + F.when(m["any_language"] | m["language"], 0.12).otherwise(0.0)
        + F.when(m["type"].isNotNull(), 0.12).otherwise(0.0)
        + F.when(m["effort"] <= F.col("p_capacity"), 0.14).otherwise(0.04)
        + goal
    )
    return round_to(F.least(F.lit(1.0), score), 3)


def _reasons(m: Column) -> Column:
    # The sentences below.
    found = F.array_compact(
        F.array(
            F.when(m["exact"], F.concat(F.lit("Already working in "), F.col("p_niche")))
            .when(m["adjacent"].isNotNull(), F.concat(
                F.lit("Working in "), m["adjacent"], F.lit(", which shares formats with "),
                F.col("p_niche")))
            .when(m["adaptability"] == "high", F.lit("Travels well across niches")),
            F.when(F.size(m["platforms"]) > 0, F.concat(
                F.lit("Live on "), F.array_join(m["platforms"], ", "))),
            F.when(~(m["any_language"] | m["language"]) & m["has_language"],
                   F.lit("Mostly in a language you do not publish in")),
            F.when(m["type"].isNotNull(), F.concat(
                F.lit("Matches your "), m["type"], F.lit(" content"))),
            F.when(m["effort"] > F.col("p_capacity"),
                   F.lit("Needs more production than you usually do"))
            .when(m["effort"] == 0, F.lit("Low production effort")),
        )
    )
    return F.slice(found, 1, 3)


def _scored(kinds: DataFrame, candidates: DataFrame, use_breakdown: bool) -> DataFrame:
    """Every kind of profile with every candidate of a bounded pool, scored in codegen."""
    return _score(kinds.withColumn("pool", _as_pool(candidates)).withColumn("t", F.explode("pool")), use_breakdown)


def _feed_score(relevance: Column, opportunity: Column) -> Column:
    return round_to((0.6 * relevance + 0.4 * (opportunity / 100.0)) * 100, 1)


def _score(rows: DataFrame, use_breakdown: bool) -> DataFrame:
    """Scores of rows of kinds with a trend ``t`` each."""
    m = F.col("m")
    scored = rows.withColumn("m", _matched(F.col("t"))).select(
        "kind", m["trend_id"].alias("trend_id"),
        m["opportunity_score"].alias("opportunity_score"), m["exact"].alias("exact"),
        _relevance(m, use_breakdown).alias("relevance_score"),
        _reasons(m).alias("relevance_reasons"),
    )
    return scored.withColumn("feed_score", _feed_score(F.col("relevance_score"), F.col("opportunity_score")))


FEED_ORDER = ("feed_score", "opportunity_score")


def _top(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Ties go to the better opportunity, then to the smaller id."""
    order = [F.col(c).desc() for c in FEED_ORDER] + [F.col("trend_id")]
    return top_k(scored, keys, order, k)


def _kinds(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((user_id, kind), one row per kind): profiles that score alike are scored once."""
    prepared = _prepared(profiles)
    traits = [c for c in prepared.columns if c != "user_id"]
    keyed = prepared.withColumn("kind", F.sha2(F.to_json(F.struct(*traits)), 256))
    return keyed.select("user_id", "kind"), keyed.select("kind", *traits).dropDuplicates(["kind"])


def _listed(users: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ranked rows of every user. The ranked lists travel as one row per kind, so a kind
    that many users share is a small build side."""
    entry = F.struct("rank", "trend_id", "feed_score", "relevance_score", "opportunity_score",
                     "relevance_reasons")
    lists = ranked.groupBy("kind").agg(F.sort_array(F.collect_list(entry)).alias("picks"))
    return users.join(lists, "kind").select("user_id", F.explode("picks").alias("s")).select(
        "user_id", "s.*")


def feed(
    profiles: DataFrame, trends: DataFrame, limit: int = 24, pool: int = FEED_POOL,
    goal_from_breakdown: bool = True,
) -> DataFrame:
    """Ranked feed of every profile: pool by opportunity, then 60/40 relevance and chance.

    ``goal_from_breakdown=False`` gives the goal term its neutral 0.5 throughout.
    """
    best = _candidates(trends).orderBy(F.col("opportunity_score").desc(), "trend_id").limit(pool)
    users, kinds = _kinds(profiles)
    return _listed(users, _top(_scored(kinds, best, goal_from_breakdown), ["kind"], limit))


def best_trend_for(profiles: DataFrame, trends: DataFrame) -> DataFrame:
    return feed(profiles, trends, limit=1, pool=PICK_POOL)


#: Traits that decide a trend's overlaps with a profile; trends that share them differ in scores only.
TRAITS = ("niches", "platforms", "languages", "content_types", "production_difficulty", "adaptability")
SIGNALS = tuple(sorted({signal for signal, _ in GOALS.values()}))


def _signal(components: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(components, F.lit(name)), F.lit(0.5))


def niche_index(trends: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """(entries, buckets). An entry is a trend under one of its niches, and under none; a bucket gathers the
    entries that share a niche, all traits and a step of opportunity, with the bounds of their scores."""
    kept = _candidates(trends).withColumn("opportunity_score", F.coalesce("opportunity_score", F.lit(0)))
    traits = F.sha2(F.to_json(F.struct(*TRAITS)), 256)
    step = F.floor(F.col("opportunity_score") / width)
    named = F.transform(F.filter(F.array_distinct("niches"), lambda n: n != ""), lambda n: F.concat(F.lit("n "), n))
    entries = kept.withColumns({"traits": traits, "step": step}).withColumn(
        "look", F.explode(F.array_union(F.coalesce(named, F.array().cast("array<string>")), F.array(F.lit("all")))))
    entries = store(entries, "niches")
    bound = lambda f, c: F.struct(
        F.lit(None).cast("string").alias("trend_id"), f("opportunity_score").alias("opportunity_score"), F.col("adaptability"),
        F.col("production_difficulty"), *[F.col(x) for x in ("niches", "platforms", "languages", "content_types")],
        F.map_from_arrays(F.array(*[F.lit(x) for x in SIGNALS]), F.array(*[f(_signal(F.col("components"), x)) for x in SIGNALS])).alias("components")).alias(c)
    held = entries.groupBy("look", "traits", "step", *TRAITS).agg(
        F.count("*").alias("n"), bound(F.min, "low"), bound(F.max, "high"))
    return entries, store(held.select("look", "traits", "step", "n", "low", "high"), "buckets")


def niche_candidates(kinds: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(kind, traits of the kind, look, traits, step): the buckets that can hold one of a kind's best ``k``.

    A score grows with the opportunity and with each signal, rounding included, so a bucket's bounds give
    bounds of its scores. The lower bounds, counted as often as a bucket has entries, say what the k-th best
    score is at least; buckets whose upper bound stays below it are out.
    """
    own = buckets.select("look").distinct()
    mine = kinds.join(own, F.col("look") == F.concat(F.lit("n "), F.col("p_niche")), "left")
    mine = mine.withColumn("look", F.coalesce("look", F.lit("all")))
    rows = mine.join(buckets, "look")
    for side in ("low", "high"):
        rows = rows.withColumn("m", _matched(F.col(side))).withColumn(
            f"{side}_score", _feed_score(_relevance(F.col("m"), True), F.col("m.opportunity_score"))).drop("m")
    down = Window.partitionBy("kind").orderBy(F.desc("low_score"), "traits", "step").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("reach", F.sum("n").over(down))
    sure = F.max(F.when(F.col("reach") >= k, F.col("low_score"))).over(Window.partitionBy("kind"))
    rows = rows.withColumn("sure", sure)
    return rows.where(F.col("sure").isNull() | (F.col("high_score") >= F.col("sure"))).select(*kinds.columns, "look", "traits", "step")


def in_niche(profiles: DataFrame, trends: DataFrame, k: int = 6, width: float = 1.0) -> DataFrame:
    """A profile's own-niche trends in feed order over *all* trends; the general ranking
    where its niche has none.

    A top-k join by score bounds over an index of (niche, trend): kinds of profiles meet the buckets of their niche
    first, and only the trends of buckets that can reach their best ``k`` are scored. ``width`` is the step of opportunity
    of a bucket.
    """
    users, kinds = _kinds(profiles)
    entries, buckets = niche_index(trends, width)
    wanted = niche_candidates(store(kinds, "kinds"), buckets, k)
    t = F.struct("trend_id", "opportunity_score", "adaptability", "production_difficulty", "niches", "platforms",
                 "languages", "content_types", "components").alias("t")
    found = wanted.join(entries.select("look", "traits", "step", t), ["look", "traits", "step"])
    return _listed(users, _top(_score(found, True), ["kind"], k))
