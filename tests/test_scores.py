"""Curves, rates, growth rules, status branches, medians and score properties."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.functions.quantiles import group_medians
from formatpulse.operators import aggregates as A
from formatpulse.operators import scoring as SC
from formatpulse.operators import signals as G

NOW = "2024-03-01 00:00:00"
NOW_DT = datetime(2024, 3, 1)


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_curves_have_their_fixed_points(spark):
    lit = F.lit
    got = one(
        spark, C.log_scale(lit(2500.0), 2500), C.log_scale(lit(0.0), 2500), C.log_scale(lit(-3.0), 10),
        C.log_ratio(lit(5e5), 5e5), C.log_ratio(lit(0), 5e5), C.logistic(lit(1.8), 1.8, 1.1),
        C.logistic(lit(-1e6), 0.25, 2.6), C.logistic(lit(1e6), 0.25, 2.6), C.decay(lit(96.0), 96),
        C.decay(lit(-5.0), 96), C.clamp(lit(3.0)), C.clamp(lit(-3.0)), C.log_scale(lit(1e12), 3))
    assert got == [0.5, 0, 0, 0.5, 0, 0.5, 0, 1, 0.5, 1, 1, 0, 1]


def test_sql_functions_equal_columns(spark):
    C.register_sql_functions(spark)
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 7, 2500, 1e7)], "v double")
    got = df.select(
        F.expr("pulse_log_scale(v, 2500)").alias("a"), C.log_scale(F.col("v"), 2500).alias("b"),
        F.expr("pulse_log_ratio(v, 500, 1.5)").alias("c"), C.log_ratio(F.col("v"), 500).alias("d"),
        F.expr("pulse_logistic(v, 0.25, 2.6)").alias("e"), C.logistic(F.col("v"), 0.25, 2.6).alias("f"),
        F.expr("pulse_decay(v, 96)").alias("g"), C.decay(F.col("v"), 96).alias("h"))
    for r in got.collect():
        assert (r.a, r.c, r.e, r.g) == pytest.approx((r.b, r.d, r.f, r.h))


def test_rounding_equals_python_on_ties_and_beside_them(spark):
    values = [k / 10**d for d in (2, 3, 4) for k in range(-2000, 2000, 5)] + [0.125, 2.675, 72.05, 0.5075]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        for v, got in df.select("v", C.round_to(F.col("v"), digits)).collect():
            assert got == round(v, digits), (v, digits)


def test_rates_and_lift(spark):
    lit = F.lit
    got = one(
        spark, C.engagement_rate(lit(0), lit(1), lit(1), lit(1), lit(1)),
        C.engagement_rate(lit(100), lit(1), lit(2), lit(3), lit(4)),
        C.conversation_rate(lit(100), lit(2), lit(3), lit(4)),
        C.creator_lift(lit(40), lit(20), lit(10_000)), C.creator_lift(lit(40), lit(0), lit(1000)),
        C.creator_lift(lit(40), lit(0), lit(5)), C.creator_lift(lit(40), lit(None).cast("int"), lit(0)),
        C.truthy(lit(0), lit(7)), C.truthy(lit(""), lit("x")), C.truthy(lit("y"), lit("x")),
        C.round_to(lit(2.675), 2), C.round_to(lit(0.125), 2), C.round_to(lit(0.5075), 3))
    assert got == [0.0, 0.1, 0.21, 2.0, 0.5, 40.0, 40.0, 7, "x", "y", 2.67, 0.12, 0.507]


@pytest.mark.parametrize("recent,prior,want", [(0, 0, 0.0), (1, 0, 1.0), (3, 0, 2.0), (6, 4, 0.5)])
def test_adoption_growth_cases(spark, recent, prior, want):
    rows = [("t", NOW_DT - timedelta(days=1))] * recent + [("t", NOW_DT - timedelta(days=9))] * prior
    rows += [("t", NOW_DT - timedelta(days=20))]
    got = A.adoption_growth(spark.createDataFrame(rows, "trend_id string, published_at timestamp"), NOW)
    r = got.first()
    assert (r["recent"], r["prior"], r["growth"]) == (recent, prior, want)


def test_adoption_growth_boundaries_and_future(spark):
    week = timedelta(days=7)
    rows = [("t", NOW_DT - week), ("t", NOW_DT - 2 * week), ("t", NOW_DT + week),
            ("t", NOW_DT - week - timedelta(microseconds=1)),
            ("t", NOW_DT - 2 * week - timedelta(microseconds=1))]
    r = A.adoption_growth(spark.createDataFrame(rows, "trend_id string, published_at timestamp"), NOW).first()
    assert (r["recent"], r["prior"]) == (2, 2)


def history(spark, points):
    rows = [(i, NOW_DT - timedelta(hours=h), v) for i, hs in points.items() for h, v in hs]
    return spark.createDataFrame(rows, "item_id string, captured_at timestamp, views bigint")


def test_velocity_histories(spark):
    metrics = history(spark, {
        "one": [(1, 10)], "two": [(10, 10), (5, 60)], "three": [(30, 0), (20, 100), (10, 150)],
        "four": [(40, 0), (30, 0), (20, 100), (10, 90)], "same": [(5, 10), (5, 20)],
        "dup": [(20, 5), (10, 25), (10, 25)]})
    items = spark.createDataFrame(
        [(i, NOW_DT - timedelta(hours=50), 500) for i in ("none", "one", "two", "three", "four", "same", "dup")]
        + [("new", NOW_DT - timedelta(minutes=6), 500)],
        "item_id string, published_at timestamp, views bigint")
    got = {r["item_id"]: (r["velocity"], r["prior_velocity"]) for r in G.velocity(items, metrics, NOW).collect()}
    assert got == {
        "none": (10.0, None), "one": (10.0, None), "two": (10.0, None), "three": (5.0, 10.0),
        "four": (0.0, 10.0), "same": (10.0, None), "dup": (10.0, 2.0), "new": (500.0, None)}


@pytest.mark.parametrize("recent,prior,want", [
    (5.0, 0.0, 1.0), (0.0, 0.0, 0.0), (None, None, 0.0), (0.0, 10.0, -0.95), (100.0, 10.0, 3.0), (15.0, 10.0, 0.5)])
def test_momentum(spark, recent, prior, want):
    assert one(spark, A.momentum_of(F.lit(recent).cast("double"), F.lit(prior).cast("double"))) == [want]


@pytest.mark.parametrize("g7,g24,views,creators,videos,score,want", [
    (-0.2, 0.0, 1e6, 50, 50, 90.0, "declining"),
    (0.0, -0.5, 1e6, 50, 50, 90.0, "declining"),
    (0.0, 0.0, 400_000, 20, 20, 10.0, "viral"),
    (0.1, 0.0, 1000, 14, 50, 10.0, "emerging"),
    (0.15, 0.0, 1000, 15, 15, 10.0, "growing"),
    (0.06, 0.0, 1000, 15, 15, 55.0, "growing"),
    (0.0, 0.0, 20_000, 20, 20, 10.0, "viral"),
    (0.0, 0.0, 100, 20, 20, 10.0, "declining"),
    (0.0, 0.0, 100, 10, 10, 10.0, "emerging"),
])
def test_status_branches(spark, g7, g24, views, creators, videos, score, want):
    lit = F.lit
    assert one(spark, SC.status(lit(g7), lit(g24), lit(views), lit(creators), lit(videos), lit(score))) == [want]


def test_competition_adaptability_difficulty(spark):
    lit = F.lit
    got = one(
        spark, *[SC.competition_level(lit(x)) for x in (0.37, 0.38, 0.56)],
        *[SC.adaptability(lit(n), lit(c)) for n, c in ((4, 0.5), (4, 0.4), (2, 0.0), (1, 0.9))],
        A.settle_difficulty(lit("low"), lit(76.0)), A.settle_difficulty(lit("low"), lit(75.0)),
        A.settle_difficulty(lit(None).cast("string"), lit(1.0)))
    assert got == ["low", "medium", "high", "high", "medium", "medium", "low", "medium", "low", "medium"]
    rows = [("t", d, 10.0) for d in ("high", "low", "high", "low", "medium", "", None)]
    df = spark.createDataFrame(rows, "trend_id string, production_difficulty string, duration_sec double")
    assert A.consensus_difficulty(df).first()["production_difficulty"] == "low"


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_medians_exact_for_ordinary_and_dominant_groups(spark, parts):
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 1), rng.randrange(5)) for _ in range(401)]
    rows += [("even", rng.random(), rng.randrange(1000)) for _ in range(100)]
    rows += [("small", 1.0, 2), ("small", 4.0, 8)]
    rows += [("same", 3.0, 3)] * 80 + [(None, 2.0, 7), (None, 5.0, 9)] + [("none", None, None), ("half", None, 4)]
    df = spark.createDataFrame(rows, "k string, a double, b bigint").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # with many, every group spans several ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = group_medians(df, ["k"], ["a", "b"], [F.count(F.lit(1)).alias("n")]).collect()
        assert group_medians(df.limit(0), ["k"], ["a"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    got = {r["k"]: (r["a"], r["b"], r["n"]) for r in found}
    middle = lambda values: statistics.median(values) if values else None
    for k in ("hot", "even", "small", "same", None, "none", "half"):
        mine = [r for r in rows if r[0] == k]
        assert got[k] == (*(middle([r[i] for r in mine if r[i] is not None]) for i in (1, 2)), len(mine))


def make_signals(spark, trends=12, seed=2):
    rng = random.Random(seed)
    rows = []
    for t in range(trends):
        for i in range(rng.randrange(1, 60)):
            rows.append((
                f"t{t}", f"t{t}-{i:03d}", f"c{rng.randrange(30)}",
                rng.choice(["tiktok", "youtube", "instagram"]), rng.choice(["ai", "food", "design", "", None]),
                rng.choice(["US", "DE"]), rng.choice(["en", "de"]), rng.choice([None, "vlog"]),
                NOW_DT - timedelta(hours=rng.random() * 500), rng.random() * 120, rng.randrange(10**6),
                round(rng.random(), 4), rng.randrange(10**6), rng.random() * 5000,
                rng.choice([None, rng.random() * 100]), rng.choice([None, rng.random() * 100]),
                rng.random() * 0.2, rng.random() * 0.1, rng.random() * 4, rng.random() * 500,
                rng.choice(["low", "medium", "high", None])))
    return spark.createDataFrame(
        rows, "trend_id string, item_id string, creator_id string, platform string, niche string, "
        "country string, language string, content_type string, published_at timestamp, "
        "duration_sec double, followers bigint, similarity double, views bigint, velocity double, "
        "prior_rate double, recent_rate double, engagement double, conversation double, lift double, "
        "age_hours double, production_difficulty string"), rows


def test_aggregates_against_plain_python(spark):
    df, rows = make_signals(spark)
    got = {r["trend_id"]: r for r in A.build_aggregates(df, NOW).collect()}
    for t, r in got.items():
        mine = sorted((x for x in rows if x[0] == t), key=lambda x: (-x[11], x[1]))
        assert r["video_count"] == len(mine)
        assert r["creator_count"] == len({x[2] for x in mine})
        assert r["avg_views"] == sum(x[12] for x in mine) // len(mine)
        assert r["median_views"] == int(statistics.median(x[12] for x in mine))
        assert r["median_velocity"] == statistics.median(x[13] for x in mine)
        counts = {}
        for x in mine:
            if x[4]:
                counts[x[4]] = counts.get(x[4], 0) + 1
        assert r["niches"] == [k for k, _ in sorted(counts.items(), key=lambda kv: -kv[1])]
        lifts = [x[18] for x in mine]
        want = 0.5 if len(lifts) < 3 else max(0, min(1, 1 - statistics.pstdev(lifts) / max(0.1, statistics.mean(lifts)) / 2))
        assert r["lift_consistency"] == pytest.approx(want)
        assert sum(d["videos"] for d in r["adoption_curve"]) == len(mine)
        assert [d["date"] for d in r["adoption_curve"]] == sorted(d["date"] for d in r["adoption_curve"])


def test_hot_route_and_row_order_change_nothing(spark):
    df, _ = make_signals(spark)
    base = A.build_aggregates(df, NOW).orderBy("trend_id").toPandas()
    other = A.build_aggregates(df.repartition(7).orderBy(F.rand(1)), NOW).orderBy("trend_id").toPandas()
    for c in base.columns:
        if base[c].dtype == float:
            assert base[c].tolist() == pytest.approx(other[c].tolist(), abs=1e-9)
        else:
            assert base[c].map(str).tolist() == other[c].map(str).tolist()


def test_score_properties(spark):
    assert math.isclose(sum(SC.TREND_WEIGHTS.values()), 1) and math.isclose(sum(SC.OPPORTUNITY_WEIGHTS.values()), 1)
    df, _ = make_signals(spark)
    for r in SC.score_trends(A.build_aggregates(df, NOW)).collect():
        assert 0 <= r["trend_score"] <= 100 and 0 <= r["opportunity_score"] <= 100
        parts = r["score_breakdown"]["trend_score"]["components"]
        assert sum(c["contribution"] for c in parts) == pytest.approx(r["trend_score"], abs=0.5)
        assert [c["contribution"] for c in parts] == sorted((c["contribution"] for c in parts), reverse=True)
        if r["status"] == "declining":
            assert r["opportunity_score"] <= 65
        chance = r["score_breakdown"]["opportunity_score"]
        factor = 0.65 if r["status"] == "declining" else 1
        assert factor * sum(c["contribution"] for c in chance["components"]) == pytest.approx(chance["total"], abs=0.5)
    looked = SC.score_trends(A.build_aggregates(df, NOW)).select(
        SC.component_lookup(F.col("score_breakdown"), "growth").alias("g"),
        SC.component_lookup(F.col("score_breakdown"), "absent").alias("x")).first()
    assert 0 <= looked["g"] <= 1 and looked["x"] == 0.5


def test_growth_is_shift_invariant(spark):
    df, _ = make_signals(spark)
    moved = df.withColumn("published_at", F.col("published_at") + F.expr("interval 10 days"))
    a = {tuple(r) for r in A.adoption_growth(df, NOW).collect()}
    assert a == {tuple(r) for r in A.adoption_growth(moved, "2024-03-11 00:00:00").collect()}


def test_backfill_against_direct_count(spark):
    df, rows = make_signals(spark, trends=3)
    got = {(r["trend_id"], r["days_ago"]): r for r in A.snapshot_backfill(df, NOW, 14).collect()}
    for t in ("t0", "t1", "t2"):
        for d in range(1, 15):
            mine = [x for x in rows if x[0] == t and x[8] <= NOW_DT - timedelta(days=d)]
            if not mine:
                assert (t, d) not in got
                continue
            r = got[(t, d)]
            assert (r["video_count"], r["creator_count"]) == (len(mine), len({x[2] for x in mine}))
            assert r["total_views"] == int(sum(x[12] for x in mine) * (1 - d / (14 * 1.6)))
            assert r["avg_engagement_rate"] == pytest.approx(statistics.mean(x[16] for x in mine))


def test_creator_baseline_needs_three_and_takes_newest_thirty(spark):
    rows = [("a", i, NOW_DT - timedelta(days=i), 10 if i < 30 else 10**6) for i in range(90)]
    rows += [("b", 1000 + i, NOW_DT, 5) for i in range(2)] + [("c", 2000 + i, NOW_DT, 7 + i) for i in range(4)]
    items = spark.createDataFrame(rows, "creator_id string, item_id bigint, published_at timestamp, views bigint")
    creators = spark.createDataFrame([("a", 0), ("b", 0), ("c", None), ("d", 0)], "creator_id string, baseline_median_views bigint")
    assert {tuple(r) for r in A.creator_baseline(items, creators).collect()} == {("a", 10), ("c", 8)}
