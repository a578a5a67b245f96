"""Squashing curves and rates as Catalyst expressions, plus their SQL registration."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

HOUR_MICROS = 3_600_000_000


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def log_scale(value: Column, midpoint: float) -> Column:
    """[0, inf) to [0, 1] with 0.5 at ``midpoint``; zero and below give 0."""
    return F.when(value <= 0, F.lit(0.0)).otherwise(
        clamp(F.log1p(value) / F.lit(2 * math.log1p(midpoint)))
    )


def log_ratio(value: Column, midpoint: float, decades: float = 1.5) -> Column:
    """0.5 at ``midpoint``; ``decades`` powers of ten reach either rail."""
    return F.when(value <= 0, F.lit(0.0)).otherwise(
        clamp(F.lit(0.5) + F.log10(value / F.lit(float(midpoint))) / F.lit(2.0 * decades))
    )


def logistic(value: Column, midpoint: float, steepness: float = 1.0) -> Column:
    """S-curve; the JVM ``exp`` overflows to infinity, which gives the right 0."""
    return F.lit(1.0) / (
        F.lit(1.0) + F.exp(F.lit(-steepness) * (value - F.lit(float(midpoint))))
    )


def decay(hours: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours) / F.lit(float(half_life)))


def as_instant(now: str | datetime | Column) -> Column:
    """A clock reading as a timestamp column; pass it in so a run is repeatable."""
    if isinstance(now, Column):
        return now
    return F.lit(str(now)).cast("timestamp")


def hours_between(start: Column, end: Column) -> Column:
    return (
        F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    ) / F.lit(float(HOUR_MICROS))


def age_hours(published_at: Column, now: str | datetime | Column) -> Column:
    return hours_between(published_at, as_instant(now))


def engagement_rate(
    views: Column, likes: Column, comments: Column, shares: Column, saves: Column
) -> Column:
    """Interactions per view; zero views give 0.0, never null."""
    return F.when(views == 0, F.lit(0.0)).otherwise((likes + comments + shares + saves) / views)


def conversation_rate(views: Column, comments: Column, shares: Column, saves: Column) -> Column:
    return F.when(views == 0, F.lit(0.0)).otherwise(
        (F.lit(3) * shares + F.lit(2) * comments + F.lit(2) * saves) / views
    )


def creator_lift(views: Column, baseline: Column, followers: Column) -> Column:
    """Views as a multiple of what the creator usually gets."""
    guess = F.greatest(F.lit(1), F.floor(followers * F.lit(0.08)))
    return views / F.coalesce(F.nullif(baseline, F.lit(0)), guess)


SPLITTER = 134_217_729.0  # 2^27 + 1 halves the bits of a double


def round_to(x: Column, digits: int) -> Column:
    """Nearest multiple of 10^-digits of the exact binary value, exact halves to even.

    Scaling can round a value just beside a half onto it. The error of that product is
    recovered without loss from the two halves of ``x`` and decides such cases; the
    result is never a negative zero.
    """
    scale = F.lit(float(10**digits))

    def rounded(v: Column) -> Column:
        scaled = v * scale
        high = v * SPLITTER - (v * SPLITTER - v)
        error = (high * scale - scaled) + (v - high) * scale
        below = F.floor(scaled).cast("double")
        on_half = (scaled - below == 0.5) & (error != 0)
        whole = F.when(on_half, below + (error > 0).cast("double")).otherwise(F.rint(scaled))
        return whole / scale + F.lit(0.0)

    # the argument is bound once: nested roundings would otherwise multiply the plan
    return F.get(F.transform(F.array(x.cast("double")), rounded), F.lit(0))


def truthy(incoming: Column, existing: Column) -> Column:
    """``incoming`` unless it is null, zero or empty; then ``existing``.

    Zero counters and empty strings both mean "the source did not say".
    """
    return F.when(incoming.isNotNull() & (incoming.cast("string") != F.lit("0"))
                  & (incoming.cast("string") != F.lit("")), incoming).otherwise(existing)


SQL_CURVES = {
    "pulse_clamp": ("x DOUBLE", "greatest(0D, least(1D, x))"),
    "pulse_log_scale": (
        "v DOUBLE, m DOUBLE",
        "CASE WHEN v <= 0 THEN 0D ELSE greatest(0D, least(1D, log1p(v) / (2 * log1p(m)))) END",
    ),
    "pulse_log_ratio": (
        "v DOUBLE, m DOUBLE, decades DOUBLE",
        "CASE WHEN v <= 0 THEN 0D ELSE "
        "greatest(0D, least(1D, 0.5D + log10(v / m) / (2 * decades))) END",
    ),
    "pulse_logistic": ("v DOUBLE, m DOUBLE, k DOUBLE", "1D / (1D + exp(-k * (v - m)))"),
    "pulse_decay": ("h DOUBLE, half_life DOUBLE", "pow(0.5D, greatest(0D, h) / half_life)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """SQL functions that Catalyst inlines, so SQL users get the same expressions."""
    for name, (args, body) in SQL_CURVES.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}"
        )
    return sorted(SQL_CURVES)
