"""Gold rebuild, gold tables and streams: results equal the batch forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from formatpulse import schemas
from formatpulse.functions import curves as C
from formatpulse.operators import aggregates as A
from formatpulse.operators import similarity as S
from formatpulse.operators import upserts as U
from formatpulse.plans.rebuild import nightly_rebuild
from formatpulse.sources import gold
from formatpulse.streaming import jobs as J
from tests.test_clustering import SIZES, planted

NOW = "2024-03-01 00:00:00"
NOW_DT = datetime(2024, 3, 1)


def corpus(spark):
    rows, truth = planted()
    items, feats = [], []
    for i, vec in rows:
        group = truth.get(i, 999)
        items.append((str(i), "tiktok", str(i), f"c{i % 20}", "", "", f"cap {i}", [], NOW_DT - timedelta(days=i % 28, hours=1),
                      30.0, 1000 + i, 5, 5, 5, 5, None, "en", "", None, None, NOW_DT))
        if any(vec):
            feats.append((str(i), f"Hello there friend {i}", f"format {group % 3}", ["hook", "body", "cta"], ["cuts"], "calm", "low",
                          [float(x) for x in vec]))
    creators = spark.createDataFrame([(f"c{i}", "tiktok", f"h{i}", None, None, 1000, 0, "ai", "US", "en") for i in range(20)], schemas.CREATORS)
    metrics = spark.createDataFrame(
        [(str(i), NOW_DT - timedelta(hours=h), 1000 + i - h, 0, 0, 0) for i, _ in rows for h in (48, 24, 0)], schemas.METRICS)
    return (spark.createDataFrame(items, schemas.ITEMS),
            spark.createDataFrame(feats, "item_id string, hook string, content_format string, narrative_structure array<string>, "
                                         "editing_patterns array<string>, emotional_tone string, production_difficulty string, embedding array<double>"),
            creators, metrics)


@pytest.fixture(scope="module")
def rebuilt(spark):
    data = corpus(spark)
    return data, nightly_rebuild(*data, NOW)


def test_rebuild_recovers_planted_formats(spark, rebuilt):
    (items, *_), out = rebuilt
    trends = out.trends.collect()
    assert sorted(t["video_count"] for t in trends) == sorted(SIZES)
    assert len({t["slug"] for t in trends}) == 8
    by_name = {}
    for t in sorted(trends, key=lambda t: -t["video_count"]):
        by_name.setdefault(t["name"], []).append(t["slug"])
    for name, slugs in by_name.items():
        base = name.lower().replace(" ", "-")
        assert slugs == [base] + [f"{base}-{i}" for i in range(2, len(slugs) + 1)]
    assert out.members.count() == sum(SIZES)
    assert out.members.filter("is_exemplar").count() == 4 * 8
    assert {t["niches"][0] for t in trends} == {"ai"}
    assert out.snapshots.agg(F.sum("video_count")).first()[0] == sum(SIZES)


def test_rebuild_keeps_identity_and_reports_stale(spark, rebuilt):
    data, out = rebuilt
    earlier = out.trends.select("trend_id", "slug", F.lit("2023-01-01").cast("timestamp").alias("first_seen_at"), "centroid")
    renamed = earlier.withColumn("slug", F.concat(F.lit("kept-"), "slug"))
    again = nightly_rebuild(*data, NOW, existing=earlier.unionByName(
        renamed.limit(1).withColumn("slug", F.lit("gone"))))
    assert {t["first_seen_at"] for t in again.trends.collect()} == {datetime(2023, 1, 1)}
    assert [r["slug"] for r in again.stale.collect()] == ["gone"]
    moved = nightly_rebuild(*data, NOW, existing=renamed, match="centroid")
    assert all(t["slug"].startswith("kept-") for t in moved.trends.collect())
    assert moved.stale.isEmpty()


def test_rebuild_refuses_missing_vectors_and_small_corpora(spark):
    items, feats, creators, metrics = corpus(spark)
    holes = feats.withColumn("embedding", F.when(F.col("item_id") != "3", F.col("embedding")))
    assert nightly_rebuild(items, holes, creators, metrics, NOW) == "some analyses are missing embeddings"
    assert nightly_rebuild(items, feats, creators, metrics, "2030-01-01 00:00:00") == "no analysed items in window"


def test_gold_tables_replace_append_and_ignore_unfinished_runs(spark, rebuilt, tmp_path):
    _, out = rebuilt
    path = str(tmp_path / "gold")
    assert gold.read_gold(spark, path) is None
    for run in (1, 2, 2):
        gold.write_gold(out.trends.drop("score_breakdown"), out.members, out.snapshots, path, run)
    out.trends.limit(0).write.parquet(f"{path}/trends/run=3")
    trends, members, snaps = gold.read_gold(spark, path)
    assert (trends.count(), members.count(), snaps.count()) == (8, sum(SIZES), 16)


def slices(spark, tmp_path, df, order, parts):
    """The frame as ``parts`` time-ordered files."""
    path = str(tmp_path / "landed")
    rows = df.orderBy(order).toPandas()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows.iloc[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def events(spark, n=300):
    return spark.createDataFrame(
        [(i, f"u{i * 7 % 11}", NOW_DT - timedelta(minutes=13 * (n - i)), float(i * 37 % 101)) for i in range(n)],
        "event_id bigint, item_id string, captured_at timestamp, views double")


def test_stream_velocity_equals_batch_over_slices(spark, tmp_path):
    from formatpulse.operators import signals as G

    df = events(spark)
    path = slices(spark, tmp_path, df, "event_id", 5)
    out = str(tmp_path / "out")
    J.drain(J.stream_velocity(J.stream_files(spark, path, df.schema, files_per_batch=1)),
            lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "ck"), "update")
    got = spark.read.parquet(out).groupBy("item_id").agg(F.max_by(F.struct("velocity", "prior_velocity"), "batch").alias("x"))
    items = df.groupBy("item_id").agg(F.min("captured_at").alias("published_at"), F.max("views").alias("views"))
    want = {r[0]: (pytest.approx(r[1]), pytest.approx(r[2])) for r in G.velocity(items, df.select("item_id", "captured_at", "views"), NOW).collect()}
    assert {r["item_id"]: (r["x"]["velocity"], r["x"]["prior_velocity"]) for r in got.collect()} == want


def test_stream_dedupe_keeps_one_row_per_key(spark, tmp_path):
    df = events(spark, 60)
    path = slices(spark, tmp_path, df.unionByName(df), "event_id", 3)
    out = str(tmp_path / "out")
    stream = J.dedupe_stream(J.stream_files(spark, path, df.schema), ["event_id"])
    J.drain(stream, out, str(tmp_path / "ck"))
    assert spark.read.parquet(out).count() == 60


def test_stream_adoption_equals_batch(spark, tmp_path):
    df = events(spark).withColumnsRenamed({"item_id": "trend_id", "captured_at": "published_at"})
    path = slices(spark, tmp_path, df, "event_id", 4)
    out = str(tmp_path / "out")
    J.drain(J.stream_adoption(J.stream_files(spark, path, df.schema, files_per_batch=1)),
            lambda b, i: b.write.mode("overwrite").parquet(out), str(tmp_path / "ck"), "complete")
    got = {(r[0], str(r[1].date())): r[3] for r in spark.read.parquet(out).collect()}
    want = {(r["trend_id"], str(d["date"])): d["videos"] for r in A.adoption_curve(df).collect() for d in r["adoption_curve"]}
    assert got == want


def test_stream_upsert_equals_batch_and_survives_replay(spark, tmp_path):
    ddl = "platform string, external_id string, views bigint, likes bigint, comments bigint, shares bigint, saves bigint, caption string, collected_at timestamp"
    stored = spark.createDataFrame([("t", "u1", 1, 0, 0, 0, 0, "old", None)], ddl)
    df = events(spark, 80).select(
        F.lit("t").alias("platform"), F.col("item_id").alias("external_id"), F.col("views").cast("bigint"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("likes", "comments", "shares", "saves")],
        F.col("event_id").cast("string").alias("caption"), F.col("event_id").alias("seq"))
    path = slices(spark, tmp_path, df, "seq", 4)
    base = str(tmp_path / "items")
    sink = J.upsert_sink(base, stored, C.as_instant(NOW))
    J.drain(J.stream_files(spark, path, df.schema, files_per_batch=1), sink, str(tmp_path / "ck"))
    want = sorted(map(tuple, U.upsert_items(stored, df, C.as_instant(NOW)).drop("change", "batch_rows").collect()))
    assert sorted(map(tuple, sink.state.read(spark, "items").select(*stored.columns).collect())) == want
    last = spark.read.parquet(path).orderBy(F.desc("seq")).limit(20)
    sink(last, 3)
    assert sorted(map(tuple, sink.state.read(spark, "items").select(*stored.columns).collect())) == want
    assert spark.read.parquet(f"{base}/metrics").count() == 80


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    df = events(spark, 100)
    late = spark.createDataFrame([(999, "u0", NOW_DT - timedelta(days=5), 1.0)], df.schema)
    path = slices(spark, tmp_path, df.unionByName(late), F.col("event_id"), 4)
    base = str(tmp_path / "out")
    J.drain(J.stream_files(spark, path, df.schema, files_per_batch=1),
            J.late_split_sink(base, "captured_at", "2 days"), str(tmp_path / "ck"))
    assert [r["event_id"] for r in spark.read.schema(df.schema).parquet(f"{base}/late/*").collect()] == [999]
    assert spark.read.schema(df.schema).parquet(f"{base}/on_time/*").count() == 100


def test_stream_assign_equals_batch(spark, tmp_path):
    rows, _ = planted(dim=8)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    centers = spark.createDataFrame([(f"t{i}", rows[i * 20][1]) for i in range(8)], "trend_id string, centroid array<double>")
    path = slices(spark, tmp_path, df, "vec_id", 3)
    out = str(tmp_path / "out")
    J.drain(J.stream_files(spark, path, df.schema, files_per_batch=1), J.assign_sink(out, centers, 0.62), str(tmp_path / "ck"))
    want = {r[0]: r[1] for r in S.assign_to_existing(df, centers, 0.62).collect()}
    assert {r["vec_id"]: r["trend_id"] for r in spark.read.parquet(out).collect()} == want


def test_pending_drain_enriches_newest_first(spark):
    items = spark.createDataFrame([(f"i{i}", NOW_DT - timedelta(days=i)) for i in range(5)], "item_id string, published_at timestamp")
    feats = spark.createDataFrame([("i0",)], "item_id string")
    got = J.drain_pending(items, feats, lambda b: b.withColumn("done", F.lit(True)), 2)
    assert sorted(r["item_id"] for r in got.collect()) == ["i1", "i2"]
