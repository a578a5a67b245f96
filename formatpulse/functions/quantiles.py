"""Exact group medians by counts: one route for groups of any size."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.session import store


#: Sketches find ranks to within a thousandth of their group.
ACCURACY = 1000


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where null meets null; the keys stand once in the result."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"__right_{k}"]) for k in keys])
    return left.join(named, same, how).drop(*[f"__right_{k}" for k in keys])


def middle_values(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __c, __median) from (keys, __c, __v, __m): how often each value of each column stands in each group.

    The counts are dealt by ranges of (keys, column, value), so a large group spreads over as many
    partitions as its values fill. What each partition holds of a group is summed; running sums over
    those few sums say which partitions hold the middle ranks, and only there the values are walked.
    """
    group = [*keys, "__c"]
    dealt = counts.repartitionByRange(*group, "__v").withColumn("__part", F.spark_partition_id())
    dealt = store(dealt, "counts")  # a second dealing need not draw the same borders
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.expr("(__n - 1) div 2"), F.expr("__n div 2")
    slices = dealt.groupBy(*group, "__part").agg(F.sum("__m").alias("__held")).select(
        *group, "__part", "__held", F.sum("__held").over(whole).alias("__n"),
        F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__ahead"))
    end = F.col("__ahead") + F.col("__held")
    slices = slices.where(((F.col("__ahead") <= low) & (low < end)) | ((F.col("__ahead") <= high) & (high < end)))
    upto = Window.partitionBy(*group, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = join_keys(dealt, slices.drop("__held"), [*group, "__part"]).withColumn(
        "__to", F.col("__ahead") + F.sum("__m").over(upto))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__to") - F.col("__m") <= rank) & (rank < F.col("__to")), F.col("__v")))
    return walked.groupBy(*group).agg(((at(low) + at(high)) / 2.0).alias("__median"))


def middle_counts(df: DataFrame, groups: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, __c, __v, __m): how often each value near the middle of each group and column stands there; those before and
    after it are one cell each, at minus and plus infinity. ``groups`` holds (keys, __b0, __b1, …), a pair of values around the middle of each column.

    Each pair is tested by counting: where it misses a middle rank, all values of that group and column are counted.
    """
    brackets = [f"__b{i}" for i in range(len(columns))]
    values = [F.col(c).cast("double") for c in columns]
    near = join_keys(df.select(*dict.fromkeys([*keys, *columns])), groups.select(*keys, *brackets), keys)
    tally = near.groupBy(*keys).agg(*[x for i, (v, b) in enumerate(zip(values, brackets)) for x in (
        F.count(v).alias(f"__n{i}"), F.count_if(v < F.col(b)[0]).alias(f"__less{i}"),
        F.count_if(v.between(F.col(b)[0], F.col(b)[1])).alias(f"__in{i}"))])
    bounds = join_keys(groups.select(*keys, *brackets), tally, keys)
    holds = [F.expr(f"__less{i} <= (__n{i} - 1) div 2 AND __n{i} div 2 < __less{i} + __in{i}") for i in range(len(columns))]
    bounds = store(bounds.select(*keys, *[c for i, held in enumerate(holds) for c in (
        F.when(held, F.col(f"__b{i}")).alias(f"__b{i}"), F.when(held, F.col(f"__less{i}")).alias(f"__less{i}"),
        F.when(held, F.expr(f"__n{i} - __less{i} - __in{i}")).alias(f"__more{i}"))]), "bounds")
    rows = join_keys(df.select(*dict.fromkeys([*keys, *columns])), bounds.select(*keys, *brackets), keys)
    inside = [v.isNotNull() & (F.col(b).isNull() | v.between(F.col(b)[0], F.col(b)[1])) for v, b in zip(values, brackets)]
    cells = F.array(*[F.when(here, F.struct(F.lit(i).alias("c"), v.alias("v"))) for i, (here, v) in enumerate(zip(inside, values))])
    tall = rows.where(reduce(lambda a, b: a | b, inside)).select(*keys, F.explode(cells).alias("x")).where("x IS NOT NULL")
    counted = tall.groupBy(*keys, F.col("x.c").alias("__c"), F.col("x.v").alias("__v")).agg(F.count("*").alias("__m"))
    ends = F.array(*[F.struct(F.lit(i).alias("__c"), F.lit(v).alias("__v"), F.col(f"{name}{i}").alias("__m"))
                     for i in range(len(columns)) for v, name in ((-math.inf, "__less"), (math.inf, "__more"))])
    return counted.unionByName(bounds.select(*keys, F.explode(ends).alias("x")).select(*keys, "x.*").where("__m > 0"))


def group_medians(
    df: DataFrame, keys: list[str], columns: list[str], others: list[Column] | None = None,
) -> DataFrame:
    """``keys`` plus one exact mid-point median per column, named as the column, and any
    ``others`` (sums, counts…). Nulls do not count; a group without values has a null median.

    Sketches of all rows bracket the middle, so only values near it are counted one by one; a task keeps no cell for
    each value it meets. ``df`` is read three times with ``others``: store it where computing it is dear.
    """
    if not others:
        df = store(df.select(*dict.fromkeys([*keys, *columns])), "rows")
    near = (0.5 - 2.0 / ACCURACY, 0.5 + 2.0 / ACCURACY)
    sketches = [F.percentile_approx(F.col(c).cast("double"), near, ACCURACY).alias(f"__b{i}") for i, c in enumerate(columns)]
    groups = store(df.groupBy(*keys).agg(*sketches, *(others or [])), "groups")
    found = middle_values(middle_counts(df, groups, keys, columns), keys).groupBy(*keys).agg(
        *[F.max(F.when(F.col("__c") == i, F.col("__median"))).alias(c) for i, c in enumerate(columns)])
    return join_keys(groups.drop(*[f"__b{i}" for i in range(len(columns))]), found, keys, "left")
