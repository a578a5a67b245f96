"""Round five: medians without a cell for each value, partitions of a bounded size."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from formatpulse.functions import quantiles as Q
from formatpulse.functions import text as X
from formatpulse.operators import signals as G
from formatpulse.plans import bindings as B
from formatpulse.session import deal


def test_medians_count_only_values_near_the_middle(spark, monkeypatch):
    held, kept = {}, Q.store

    def seen(df, name="stored"):
        out = kept(df, name)
        held[name] = out.count()
        return out
    monkeypatch.setattr(Q, "store", seen)
    rng = random.Random(5)
    rows = [(k, rng.gauss(0, 1000)) for k in ("a", None) for _ in range(20_001)]
    found = {r.k: r.v for r in Q.group_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"]).collect()}
    assert found == {k: statistics.median(v for x, v in rows if x == k) for k in ("a", None)}
    assert held["counts"] < 1000  # one cell a value before: 40,002


@pytest.mark.parametrize("bracket", [(1.0, 2.0), (90.0, 95.0), (50.0, 50.0), (float("nan"), float("nan"))])
def test_medians_hold_where_the_bracket_misses(spark, bracket):
    """Brackets are only guesses: counts test them, and a wrong one costs time, no right result."""
    values = [float(i) for i in range(100)] + [float("inf"), float("-inf"), None]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    groups = spark.createDataFrame([("a", list(bracket))], "k string, __b0 array<double>")
    got = Q.middle_values(Q.middle_counts(df, groups, ["k"], ["v"]), ["k"]).collect()
    assert [tuple(r) for r in got] == [("a", 0, 49.5)]


def test_medians_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    cases = {"one": [3.0], "two": [1.0, 2.0], "none": [None], "ends": [-inf, -inf, 5.0], "top": [1.0, inf, inf],
             "nan": [1.0, nan, nan], "zeros": [-0.0, 0.0, 0.0, 7.0], "same": [4.0] * 500 + [9.0] * 499}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v double")
    got = {r.k: r.v for r in Q.group_medians(df, ["k"], ["v"]).collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {
        "one": 3.0, "two": 1.5, "none": None, "ends": -inf, "top": inf, "zeros": 0.0, "same": 4.0}


def test_dealt_rows_fill_partitions_of_a_bounded_size(spark):
    df = deal(spark.range(20_000), "id", 500)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 700


def test_signals_broadcast_no_points(spark):
    """One row an item: as many as there are items, however small the tables look to the planner."""
    items = spark.range(10).selectExpr(
        "'t' AS trend_id", "id AS item_id", "id AS creator_id", *[f"'x' AS {c}" for c in (
            "platform", "niche", "country", "language", "content_type", "production_difficulty")],
        "timestamp'2024-01-01' AS published_at", "1D AS duration_sec", "id AS followers", "id AS baseline_median_views",
        *[f"id AS {c}" for c in ("views", "likes", "comments", "shares", "saves")], "1D AS similarity")
    metrics = items.selectExpr("item_id", "published_at AS captured_at", "views")
    plan = G.signals(items, metrics, "2024-01-02 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("size", [1, 2])
def test_term_counts_keep_no_table_of_terms_before_the_shuffle(spark, monkeypatch, size):
    """A map task's table of terms would grow with its texts; the partitions that add up grow in number instead."""
    monkeypatch.setattr(X, "PART_BYTES", 100)
    texts = ["ab", "cd ef", None, "", "ab cd ef'g", "\u00e9ab \u212aelvin x yy", "ends here", "here ends", "the", "zz-zz"] * 30
    df = spark.createDataFrame([("en" if i % 3 else None, t) for i, t in enumerate(texts)], "lang string, text string")
    counted = X.term_counts(df, "lang", "text", size, "k")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    dealt = plan.split("REPARTITION_BY_NUM")
    assert len(dealt) == 2 and "HashAggregate" not in dealt[1]
    assert int(dealt[0].rsplit("hashpartitioning(", 1)[1].split(")")[0].split(", ")[-1]) > 15
    terms = X.tokenize(F.col("text")) if size == 1 else X.bigrams(X.tokenize(F.col("text")))
    want = df.select("lang", F.explode(terms).alias("k")).groupBy("lang", "k").agg(F.count("*").alias("n"))
    assert sorted(map(str, counted.collect())) == sorted(map(str, want.collect()))


def test_items_of_unique_keys_need_no_join_for_their_points(spark, tmp_path):
    events = [(i, f"2024-01-{1 + i % 28:02d} 10:00:00", i % 9, ("click", "view", None)[i % 3], 3.5 * i, f'{{"k": {i % 23}}}') for i in range(60)]
    odd = [(7, "2024-01-03 00:00:00", 1, "view", 900.0, '{"k": 3}'), (7, "2024-01-03 00:00:00", 1, "view", 900.0, '{"k": 3}'),
           (8, None, None, "click", None, None), (None, "2024-01-05 00:00:00", 2, "view", 10.0, '{"k": 1}'), (None, None, 2, "view", 4.0, '{"k": 1}')]
    for name, rows in (("plain", events), ("odd", events + odd)):
        frame = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
        frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/{name}/events.parquet")
        sf = f"{tmp_path}/{name}"
        got = B.event_signals(spark, sf)
        want = G.signals(B.event_members(spark, sf), B.event_metrics(spark, sf), B.EVENTS_NOW)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() >= len(rows)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("Window" in plan) == (name == "odd")  # always before
