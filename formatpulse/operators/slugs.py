"""Unique slugs for named rows, in a given order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.functions.text import slugify
from formatpulse.operators.ranking import WINDOW_ROWS, number_within
from formatpulse.session import store


def _numbered(base: Column, n: Column) -> Column:
    return F.when(n == 1, base).otherwise(F.concat_ws("-", base, n.cast("string")))


def _allocate(rows: pd.DataFrame) -> pd.DataFrame:
    """Who holds the contested names of one family. A row is a base whose name is number ``k`` of its parent,
    ``r`` parent rows come before its first one, and the parent has ``n`` rows. Returns ``skip``: the
    parent's row from which on numbers move one up; ``taken``: bases whose own name the parent holds."""
    taken, out = set(), []
    # a parent's name is shorter than its children's, so its own fate is known when its turn comes
    parents = sorted(rows.groupby("parent"), key=lambda x: (len(x[0]), x[0]))
    for parent, children in parents:
        start, skipped = 2 if parent in taken else 1, 0
        for base, k, r, n in children.sort_values("k")[["base", "k", "r", "n"]].itertuples(index=False):
            wanting = k - start + 1 - skipped  # the parent's row that would take number k
            if wanting > n:
                break
            if wanting > r:
                out.append((parent, wanting, False))
                skipped += 1
            else:
                taken.add(base)
                out.append((base, None, True))
    return pd.DataFrame(out, columns=["base", "skip", "taken"]).astype({"skip": "Int64", "taken": bool})


def slug_dedupe(
    df: DataFrame, name: str, order: list[str], out: str = "slug", hot_rows: int = WINDOW_ROWS
) -> DataFrame:
    """``base``, ``base-2``, ``base-3``… in ``order`` (unique, ascending), each row the first name that
    is free when its turn comes.

    Numbers come from a rank within the base. Only a base that reads like a number of another one (``x-2`` beside
    ``x``) can contest a name, and who comes first decides: if the ``x-2`` row stands before the row of ``x`` that would
    take number 2, that row and those behind it move one up; else ``x-2`` starts at its own second name. For each such
    pair of bases one row says how many rows of the parent come before the child, and one pass over these
    rows, a family of names at a time, allocates the numbers. Rows themselves are only ranked.
    """
    based = df.withColumn("__base", slugify(F.col(name)))
    ranked = store(number_within(based, ["__base"], order, "__m", hot_rows), "ranked")
    when = F.struct(*order)
    bases = ranked.groupBy("__base").agg(F.count("*").alias("__n"), F.min(when).alias("__first"))
    suffix = F.regexp_extract("__base", r"^(.+)-([1-9]\d{0,17})$", 2)
    children = bases.where(suffix != "").select(
        F.regexp_extract("__base", r"^(.+)-([1-9]\d{0,17})$", 1).alias("parent"), F.col("__base").alias("base"),
        suffix.cast("bigint").alias("k"), F.col("__first").alias("first")).where("k >= 2")
    parents = bases.select(F.col("__base").alias("parent"), F.col("__n").alias("n"))
    siblings = children.groupBy("parent").agg(F.count("*").alias("most"))
    # a parent's numbers end at its rows and the names it may have to skip
    near = store(children.join(parents, "parent").join(siblings, "parent").where(F.col("k") <= F.col("n") + F.col("most")), "near")
    if near.isEmpty():
        return ranked.withColumn(out, _numbered(F.col("__base"), F.col("__m"))).drop("__base", "__m")
    marks = near.select(F.col("parent").alias("__base"), *[F.col(f"first.{c}").alias(c) for c in order], F.col("base").alias("__child"))
    rows = ranked.join(near.select(F.col("parent").alias("__base")).distinct(), "__base", "left_semi")
    both = rows.select("__base", *order, F.lit(None).cast("string").alias("__child")).unionByName(marks)
    place = number_within(both, ["__base"], order, "__all", hot_rows).where("__child IS NOT NULL")
    place = number_within(place, ["__base"], order, "__own", hot_rows).select(
        F.col("__child").alias("base"), (F.col("__all") - F.col("__own")).alias("r"))
    contested = near.join(place, "base").select(
        F.regexp_replace("parent", r"(-\d+)+$", "").alias("family"), "parent", "base", "k", "r", "n")
    found = store(contested.groupBy("family").applyInPandas(_allocate, "base string, skip bigint, taken boolean"), "allocated")
    starts = found.where("taken").select(F.col("base").alias("__base"), F.lit(1).alias("__late")).distinct()
    skips = found.where("NOT taken").select(F.col("base").alias("__base"), F.col("skip").alias("__m"))
    # a row moves up by the skips at or before it: its rank among rows and skips, less its rank among rows
    moved = ranked.join(skips.select("__base").distinct(), "__base", "left_semi").select("__base", "__m", F.lit(1).alias("__row"))
    again = Window.partitionBy("__base", "__m").orderBy(F.lit(0))
    skips = skips.select("__base", "__m", (-F.row_number().over(again)).alias("__row"))
    moved = number_within(moved.unionByName(skips), ["__base"], ["__m", "__row"], "__all", hot_rows).where("__row = 1")
    moved = moved.select("__base", "__m", (F.col("__all") - F.col("__m")).alias("__up"))
    done = ranked.join(starts, "__base", "left").join(moved, ["__base", "__m"], "left")
    number = F.col("__m") + F.coalesce("__late", F.lit(0)) + F.coalesce("__up", F.lit(0))
    return done.withColumn(out, _numbered(F.col("__base"), number)).drop("__base", "__m", "__late", "__up")
