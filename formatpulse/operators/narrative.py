"""Deterministic description of a trend from its members' features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.functions.arrays import ordered_distinct
from formatpulse.functions.curves import round_to
from formatpulse.functions.quantiles import group_medians
from formatpulse.operators.aggregates import mode_of
from formatpulse.operators.ranking import top_k

# Beats when nothing was observed, tones that show a payoff.
DEFAULT_BEATS = ("hook", "body", "payoff", "cta")
PAYOFF_TONES = ("surprise", "shock", "satisfaction")
# Fixed value: what the opening of every structure says.
HOOK_DETAIL = "The promise is made before anything is explained."


def title_case(text: Column) -> Column:
    """Each run of letters capitalised."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))
        ),
        "",
    )


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def member_order(sim: str = "similarity", ident: str = "item_id") -> Column:
    return F.struct((-F.col(sim)).alias("s"), F.col(ident).alias("i"))


def modal_sequence(
    rows: DataFrame, beats: str, first: Column, key: str = "trend_id",
    length: Column | None = None,
) -> DataFrame:
    """The usual beat sequence, position by position.

    Its length is the median length of the non-empty sequences, held to 3..6. Only
    (key, position, beat) counts are shuffled, never the sequences. Where ``beats`` holds
    just the opening of longer sequences (six are enough), ``length`` gives the full size.
    """
    size = F.size(beats) if length is None else length
    slim = rows.select(key, first.alias("f"), F.col(beats).alias("b"), size.alias("n"))
    lengths = group_medians(slim.filter("n > 0"), [key], ["n"]).select(
        key, F.least(F.lit(6), F.greatest(F.lit(3), F.floor("n"))).alias("length")
    )
    counted = (
        slim.filter("n > 0")
        .select(key, "f", F.posexplode(F.slice("b", 1, 6)).alias("pos", "beat"))
        .groupBy(key, "pos", "beat")
        .agg(F.count(F.lit(1)).alias("c"), F.min("f").alias("first"))
    )
    at_pos = counted.groupBy(key, "pos").agg(
        F.min_by("beat", F.struct((-F.col("c")).alias("c"), "first", "beat")).alias("beat")
    )
    found = (
        at_pos.join(lengths, key)
        .filter(F.col("pos") < F.col("length"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "beat"))).alias("s"))
        .select(key, F.transform("s", lambda e: e["beat"]).alias("beats"))
    )
    default = F.array(*[F.lit(b) for b in DEFAULT_BEATS])
    return rows.select(key).distinct().join(found, key, "left").select(
        key, F.coalesce("beats", default).alias("beats")
    )


def common_opening(
    rows: DataFrame, hook: str, first: Column, key: str = "trend_id"
) -> DataFrame:
    """The shared first three words of the hooks, where at least max(2, n/3) of n >= 3 agree."""
    text = F.regexp_replace(F.col(hook), r"(?U)^\s+|\s+$", "")
    opening = F.lower(F.array_join(F.slice(F.split(text, r"(?U)\s+"), 1, 3), " "))
    counted = (
        rows.filter(F.coalesce(F.col(hook), F.lit("")) != "")
        .groupBy(key, opening.alias("opening"))
        .agg(F.count(F.lit(1)).alias("c"), F.min(first).alias("first"))
    )
    best = counted.groupBy(key).agg(
        F.sum("c").alias("n"),
        F.min_by(
            F.struct("opening", "c"), F.struct((-F.col("c")).alias("c"), "first", "opening")
        ).alias("b"),
    )
    return best.filter(
        (F.col("n") >= 3) & (F.col("b.c") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3)))
    ).select(
        key,
        F.concat(capitalize(F.col("b.opening")), F.lit(" X …")).alias("format_pattern"),
        F.col("b.c").alias("hits"),
        "n",
    )


def top_elements(
    rows: DataFrame, elements: str, first: Column, k: int = 4, key: str = "trend_id"
) -> DataFrame:
    """The ``k`` most frequent array elements per key."""
    counted = (
        rows.select(key, first.alias("f"), F.posexplode(elements).alias("pos", "element"))
        .groupBy(key, "element")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("f", "pos")).alias("first"))
    )
    return top_k(
        counted, [key], [F.col("n").desc(), F.col("first"), F.col("element")], k
    ).drop("first")


def timed_structure(beats: Column, duration: Column) -> Column:
    """Beats spread over the running time behind a hook of at most three seconds."""
    total = F.greatest(F.lit(12.0), F.coalesce(F.nullif(duration, F.lit(0.0)), F.lit(30.0)))
    hook_end = F.least(F.lit(3.0), total * 0.12)
    rest = F.size(beats) - 1
    weights = F.transform(
        F.slice(beats, 2, F.greatest(rest, F.lit(0))),
        lambda b, i: F.when(i == rest - 1, 0.7)
        .when((rest >= 2) & (i == F.expr("0") + F.floor(rest / 2)), 1.8)
        .otherwise(1.0),
    )
    sum_of = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    parts = F.element_at(
        F.transform(
            F.array(F.struct(weights.alias("w"), total.alias("d"), hook_end.alias("h"))),
            lambda p: F.transform(
                p["w"],
                lambda w, i: F.struct(
                    (p["h"] + (p["d"] - p["h"]) * (sum_of(F.slice(p["w"], 1, i)) / sum_of(p["w"])))
                    .alias("start"),
                    F.least(
                        p["d"],
                        p["h"] + (p["d"] - p["h"])
                        * (sum_of(F.slice(p["w"], 1, i + 1)) / sum_of(p["w"])),
                    ).alias("end"),
                    i.alias("i"),
                ),
            ),
        ),
        1,
    )
    opening = F.struct(
        F.lit(0.0).alias("start"), round_to(hook_end, 1).alias("end"),
        title_case(F.element_at(beats, 1)).alias("label"), F.lit(HOOK_DETAIL).alias("detail"),
    )
    later = F.transform(
        parts,
        lambda p: F.struct(
            round_to(p["start"], 1).alias("start"), round_to(p["end"], 1).alias("end"),
            title_case(F.element_at(beats, p["i"] + 2)).alias("label"), F.lit("").alias("detail"),
        ),
    )
    return F.when(F.size(beats) > 0, F.concat(F.array(opening), later)).otherwise(
        F.array().cast("array<struct<start:double,end:double,label:string,detail:string>>")
    )


def mechanism_keys(
    difficulty: Column, niche_count: Column, beats: Column, has_payoff_tone: Column
) -> Column:
    shows_work = F.exists(beats, lambda b: b.contains("demonstration") | b.contains("process"))
    return ordered_distinct(
        F.array_compact(
            F.array(
                F.lit("curiosity_gap"), F.lit("concrete_promise"),
                F.when(difficulty == "low", "low_production_cost"),
                F.when(niche_count >= 3, "topic_portable"),
                F.when(shows_work, "process_transparency"),
                F.when(has_payoff_tone, "visible_payoff"),
            )
        )
    )


def describe_clusters(members: DataFrame, stats: DataFrame) -> DataFrame:
    """Name, pattern, summary, common elements, mechanisms and timeline of every trend.

    ``members``: trend_id, item_id, similarity and feature columns. ``stats``: trend_id,
    median_duration_sec, niches, production_difficulty, growth_7d. Each part is a counted
    aggregate; one row per trend is joined.
    """
    order = member_order()
    dominant = mode_of(members, "trend_id", "content_format", order)
    beats = modal_sequence(members, "narrative_structure", order)
    opening = common_opening(members, "hook", order).select("trend_id", "format_pattern")
    editing = top_elements(members, "editing_patterns", order)
    tones = members.groupBy("trend_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce(F.lower("emotional_tone").isin(*PAYOFF_TONES), F.lit(False))).alias(
            "payoff"
        ),
    )
    edits = (
        editing.join(tones.select("trend_id", F.col("n").alias("members")), "trend_id")
        .groupBy("trend_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "rank",
                        F.concat(F.col("element"), F.lit(" ("), F.col("n").cast("string"),
                                 F.lit(" of "), F.col("members").cast("string"),
                                 F.lit(" videos)")).alias("t"),
                    )
                )
            ).alias("e")
        )
        .select("trend_id", F.transform("e", lambda x: x["t"]).alias("edits"))
    )
    joined = (
        stats.join(tones, "trend_id")
        .join(beats, "trend_id", "left")
        .join(dominant, "trend_id", "left")
        .join(opening, "trend_id", "left")
        .join(edits, "trend_id", "left")
    )
    label = F.coalesce("content_format", F.lit("short-form format"))
    seconds = F.coalesce(F.nullif(F.col("median_duration_sec"), F.lit(0.0)), F.lit(30.0))
    whole = F.floor(seconds).cast("string")
    arrows = F.array_join("beats", " → ")
    pct = round_to(round_to(F.col("growth_7d") * 100, 1), 0).cast("bigint")
    signed = F.concat(F.when(pct >= 0, "+").otherwise(""), pct.cast("string"))
    nothing = F.array().cast("array<string>")
    return joined.select(
        "trend_id",
        capitalize(F.trim(F.substring(label, 1, 60))).alias("name"),
        F.coalesce("format_pattern", label).alias("format_pattern"),
        F.concat(
            capitalize(label), F.lit(" running about "), whole,
            F.lit(" seconds, structured as "), arrows, F.lit(". Adoption is "),
            F.when(round_to(F.col("growth_7d") * 100, 1) > 0, "growing").otherwise("cooling"),
            F.lit(" ("), signed, F.lit("% week over week) across "),
            F.size("niches").cast("string"), F.lit(" niche(s)."),
        ).alias("summary"),
        F.concat(
            F.array(F.concat(F.lit("Structure: "), arrows),
                    F.concat(F.lit("Median duration: "), whole, F.lit("s"))),
            F.coalesce("edits", nothing),
        ).alias("common_elements"),
        mechanism_keys(
            F.col("production_difficulty"), F.size("niches"), F.col("beats"), F.col("payoff")
        ).alias("mechanisms"),
        timed_structure(F.col("beats"), F.col("median_duration_sec")).alias("format_structure"),
    )
