"""Keyed stream state, split streams, medians, slugs and sparse pairs against plain versions; landed counts."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.operators import sparse
from formatpulse.operators.slugs import slug_dedupe
from formatpulse.sources import landed, normalise
from formatpulse.streaming import jobs as J
from formatpulse.streaming.state import KeyedState
from tests.test_relational import plain_slugs

NOW = datetime(2024, 3, 1)

COUNTS = {
    "provider": (landed.PROVIDER, ("views", "likes", "comments", "shares", "saves")),
    "short": (landed.SHORT_VIDEO_ACTOR, ("playCount", "diggCount", "commentCount", "shareCount", "collectCount")),
    "reel": (landed.REEL_ACTOR, ("videoPlayCount", "likesCount", "commentsCount", "sharesCount")),
    "details": (landed.VIDEO_DETAILS, ("viewCount", "likeCount", "commentCount")),
}
LOOSE = [(1200000.0, 1200000), (3.7, 3), ("3.7", 0), ("12", 12), (None, 0), ("x", 0), (7, 7), (-1, -1)]


def payload(kind, i, value):
    fields = COUNTS[kind][1]
    counts = {f: value for f in fields}
    if kind == "provider":
        return {"items": [{"id": str(i), "author": {"followers": value, "median_views": value}, **counts}]}
    if kind == "short":
        return {"id": str(i), "authorMeta": {"name": "a", "fans": value}, **counts}
    if kind == "reel":
        return {"type": "Video", "shortCode": str(i), "ownerUsername": "a", "ownerFollowersCount": value, **counts}
    return {"id": str(i), "snippet": {"channelId": "c", "title": "t"}, "statistics": counts}


def normalised(spark, kind, rows):
    if kind == "provider":
        return normalise.normalise_provider(rows, "p", NOW)
    if kind == "short":
        return normalise.normalise_tiktok(rows, NOW)
    if kind == "reel":
        return normalise.normalise_instagram(rows, NOW)
    channels = spark.createDataFrame([], landed.CHANNELS.replace("variant", "string"))
    return normalise.normalise_youtube(rows, channels, NOW)


@pytest.mark.parametrize("kind", COUNTS)
def test_every_count_field_is_cut_alike(spark, tmp_path, kind):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(json.dumps(payload(kind, i, v)) for i, (v, _) in enumerate(LOOSE)))
    raw = normalised(spark, kind, landed.well_formed(landed.read_landed(spark, str(path), "json", COUNTS[kind][0])))
    names = ["views", "likes", "comments", *(["shares"] if kind != "details" else []), *(["saves"] if kind in ("provider", "short") else [])]
    got = {int(r["external_id"]): r for r in raw.collect()}
    for i, (_, want) in enumerate(LOOSE):
        for n in names:
            assert got[i][n] == want, (n, LOOSE[i], got[i][n])
        if kind != "details":
            assert got[i]["creator"]["followers"] == want


def test_parquet_landings_tell_numbers_from_texts(spark, tmp_path):
    numbers = spark.createDataFrame(
        [("1", 1200000.0, 7, 1709251200.0, "a"), ("2", 3.7, None, None, "a")],
        "id string, playCount double, collectCount bigint, createTime double, name string")
    texts = spark.createDataFrame([("3", "3.7", "12", "1709251200", "a")],
                                  "id string, playCount string, collectCount string, createTime string, name string")
    for name, df in (("n", numbers), ("t", texts)):
        df.select("id", "playCount", "collectCount", "createTime", F.struct("name").alias("authorMeta")).write.parquet(f"{tmp_path}/{name}")
    rows = [landed.read_landed(spark, f"{tmp_path}/{name}", "parquet", landed.SHORT_VIDEO_ACTOR) for name in "nt"]
    got = {r["external_id"]: (r["views"], r["saves"], r["published_at"])
           for r in normalise.normalise_tiktok(rows[0].unionByName(rows[1]), NOW).collect()}
    assert got == {"1": (1200000, 7, datetime(2024, 3, 1)), "2": (3, 0, NOW), "3": (0, 12, NOW)}


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 10) for i in range(200)], "k int, v int")
    state = KeyedState(str(tmp_path / "s"), {"t": ("k",)}, {"t": df.schema}, buckets=8, keep=2)
    state.commit(spark, -1, None, {"t": (df, list(range(8)))})
    for version in range(4):
        one = spark.createDataFrame([(5, version)], df.schema)
        touched = state.touched("t", one)
        assert len(touched) == 1
        before = state.newest(spark, version)
        rest = state.read(spark, "t", before, touched).where("k <> 5")
        state.commit(spark, version, before, {"t": (rest.unionByName(one), touched)})
        written = {p.name for p in (tmp_path / "s" / "t" / f"version={version}").iterdir() if p.is_dir()}
        assert written == {f"bucket={touched[0]}"}
    rows = {r["k"]: r["v"] for r in state.read(spark, "t").collect()}
    assert len(rows) == 200 and rows[5] == 3 and rows[6] == 60
    # the first version still holds the untouched buckets; those between hold nothing that is needed
    assert sorted(p.name for p in (tmp_path / "s" / "t").iterdir()) == ["version=-1", "version=2", "version=3"]
    assert not (tmp_path / "s" / "t" / "version=-1" / f"bucket={touched[0]}").exists()
    assert state.versions(spark) == [2, 3]


def test_creators_and_their_baselines_in_one_sink(spark, tmp_path):
    ddl = ("platform string, external_id string, handle string, views bigint, likes bigint, comments bigint, shares bigint, "
           "saves bigint, published_at timestamp, collected_at timestamp")
    people = "platform string, handle string, display_name string, followers bigint, baseline_median_views bigint"
    items = spark.createDataFrame([("p", "i0", "old", 5, 0, 0, 0, 0, NOW - timedelta(days=9), None)], ddl)
    creators = spark.createDataFrame([("p", "old", "Old", 3, 0), ("p", "set", "Set", 3, 77)], people)

    def batch(rows):
        return spark.createDataFrame(
            [("p", i, h, v, 0, 0, 0, 0, NOW - timedelta(days=d), f"{h} name", f, 0, k) for k, (i, h, v, d, f) in enumerate(rows)],
            "platform string, external_id string, handle string, views bigint, likes bigint, comments bigint, shares bigint, "
            "saves bigint, published_at timestamp, display_name string, followers bigint, baseline_median_views bigint, seq int")
    sink = J.upsert_sink(str(tmp_path / "s"), items, C.as_instant(NOW), creators, buckets=4)
    first = [("i1", "old", 10, 1, 0), ("i2", "old", 100, 2, 9), ("j1", "new", 4, 1, 0), ("j2", "new", 6, 2, 0), ("k1", "set", 1, 1, 0),
             ("k2", "set", 1, 1, 0), ("k3", "set", 1, 1, 0)]
    sink(batch(first), 0)
    read = lambda: {r["handle"]: (r["display_name"], r["followers"], r["baseline_median_views"])
                    for r in sink.state.read(spark, "creators").collect()}
    want = {"old": ("old name", 9, 10), "new": ("new name", 0, 0), "set": ("set name", 3, 77)}
    assert read() == want
    second = [(f"n{i}", "new", 1000 + i, -i, 5) for i in range(35)] + [("j1", "new", 8, 1, 0)]
    for _ in range(2):  # the replay changes nothing
        sink(batch(second), 1)
        newest = sorted([1000 + i for i in range(35)])[-30:]
        assert read() == {**want, "new": ("new name", 5, (newest[14] + newest[15]) // 2)}
        assert sink.state.read(spark, "items").count() == 8 + 35
        assert sink.state.read(spark, "recent").where("handle = 'new'").count() == 30
    assert spark.read.parquet(str(tmp_path / "s" / "metrics")).count() == len(first) + len(second)


def test_idle_items_leave_the_velocity_state(spark, tmp_path):
    ddl = "item_id string, captured_at timestamp, views double"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def land(rows):
        spark.createDataFrame([(i, NOW + timedelta(days=d), float(v)) for i, d, v in rows], ddl).coalesce(1).write.mode("append").parquet(path)
        J.drain(J.stream_velocity(J.stream_files(spark, path, spark.createDataFrame([], ddl).schema),
                                  delay="1 day", idle=timedelta(days=5)),
                lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "ck"), "update")
    land([("a", k / 24, k) for k in range(50)] + [("b", 0, 1), ("b", 1, 25)])
    land([("a", 20, 100)])
    land([("a", 21, 124)])
    land([("b", 21.5, 5)])
    rows = {(r["item_id"], r["as_of"]): r for r in spark.read.parquet(out).collect()}
    assert rows[("b", NOW + timedelta(days=1))]["velocity"] == 1.0
    assert rows[("b", NOW + timedelta(days=21.5))]["points"] == 1  # what was known of b has gone
    assert rows[("a", NOW + timedelta(days=21))]["points"] == 3  # a's next row came before the watermark


def test_newest_three_rows_an_item():
    import pandas as pd

    pdf = pd.DataFrame({"item_id": list("aabaaab"), "captured_at": [3, 1, 9, 2, 5, 4, 1], "views": range(7)})
    got = J.newest_rows(pdf)
    assert sorted(got[got["item_id"] == "a"]["captured_at"]) == [3, 4, 5] and len(got) == 5


def test_windows_are_upserted_and_survive_a_replay(spark, tmp_path):
    schema = spark.createDataFrame([], "trend_id string, start timestamp, end timestamp, videos bigint").schema
    frame = lambda rows: spark.createDataFrame([(t, NOW, NOW + timedelta(days=1), n) for t, n in rows], schema)
    sink = J.window_sink(str(tmp_path / "w"), schema, buckets=4)
    sink(frame([("a", 1), ("b", 2)]), 0)
    for _ in range(2):
        sink(frame([("a", 5), ("c", 3)]), 1)
        assert {r["trend_id"]: r["videos"] for r in sink.state.read(spark, "windows").collect()} == {"a": 5, "b": 2, "c": 3}
    sink(frame([("b", 99)]), 0)  # older than what is there
    assert sink.state.read(spark, "windows").where("videos = 99").count() == 0


def test_split_keeps_first_rows_late_rows_and_counts(spark, tmp_path):
    base = str(tmp_path / "s")
    frame = lambda rows: spark.createDataFrame([(k, NOW + timedelta(days=d) if d is not None else None) for k, d in rows], "k int, at timestamp")
    sink = J.split_sink(base, "at", "2 days", ("k",), buckets=2)
    sink(frame([(1, 0), (1, 1), (2, 5), (None, 5), (None, 5), (9, None)]), 0)
    sink(frame([(2, 6), (3, 1), (4, 4), (1, 0)]), 1)
    for _ in range(2):  # replayed by a new process: keys and watermark come from the folder
        J.split_sink(base, "at", "2 days", ("k",), buckets=2)(frame([(4, 5), (5, 10)]), 2)
    schema = frame([]).schema
    on_time = sorted(((r["k"], r["at"]) for r in J.settled(spark, base, "on_time", schema).collect()), key=str)
    assert on_time == sorted([(1, NOW), (2, NOW + timedelta(days=5)), (None, NOW + timedelta(days=5)), (9, None),
                              (4, NOW + timedelta(days=4)), (5, NOW + timedelta(days=10))], key=str)
    assert sorted(r["k"] for r in J.settled(spark, base, "late", schema).collect()) == [1, 3]
    counts = {r["batch"]: (r["rows"], r["on_time"], r["late"], r["repeats"]) for r in J.read_manifest(spark, base).collect()}
    assert counts == {0: (6, 4, 0, 2), 1: (4, 1, 2, 1), 2: (2, 1, 0, 1)}


@pytest.mark.parametrize("hot_rows", [10**9, 3])
@pytest.mark.parametrize("seed", range(3))
def test_contested_slugs(spark, seed, hot_rows):
    rng = random.Random(seed)
    pool = ["x", "x 2", "x-2-2", "x 3", "x-3-2", "X!", "x 2 2 2", "x 12", "y-1", "y 1 2", "y", "z-02", "z", "q-99999999999999999999"]
    names = rng.choices(pool, weights=[8, 3, 3, 2, 2, 4, 1, 1, 1, 1, 1, 1, 1, 1], k=60)
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string").repartition(5)
    got = [r["slug"] for r in slug_dedupe(df, "n", ["i"], hot_rows=hot_rows).orderBy("i").collect()]
    assert got == plain_slugs(names)


def sparse_rows(seed, n=150, dims=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        near = i % 3 and i > 3
        base = dict(rows[i - 1 - i % 2][1]) if near else {}
        for _ in range(1 if near else rng.randrange(1, 12)):
            base[rng.choice([0, 1, rng.randrange(dims)])] = float(rng.randrange(1, 9))
        rows.append((i, sorted(base.items())))
    return rows


@pytest.mark.parametrize("threshold", [0.3137, 0.8137, 0.9737])
@pytest.mark.parametrize("block", [16, 4096])
def test_sparse_pairs_equal_all_pairs(spark, threshold, block):
    rows = sparse_rows(1)
    long = spark.createDataFrame([(i, d, w) for i, e in rows for d, w in e] + [(900, 1, 0.0)], "id int, d int, w double")
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in sparse.sparse_pairs(long, threshold, block).collect()}
    norm = lambda e: math.sqrt(sum(w * w for _, w in e))
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j:
                cosine = sum(w * dict(b).get(d, 0.0) for d, w in a) / (norm(a) * norm(b))
                if cosine >= threshold:
                    want[(i, j)] = cosine
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert sparse.sparse_pairs(long.limit(0), threshold).collect() == []


def test_the_index_spares_pairs(spark):
    rng = random.Random(5)
    long = spark.createDataFrame([(i, d, float(rng.randrange(1, 4))) for i in range(600) for d in rng.sample(range(768), 12)],
                                 "id int, d int, w double")
    compared = sparse.candidate_pairs(sparse.unit_entries(long), 0.8).count()
    assert compared < 0.05 * 600 * 599 / 2


def test_niche_bounds_spare_candidates(spark):
    """Few of many trends are scored for a kind, and the picks are those of all."""
    from formatpulse.operators import personal as U
    from tests.test_relational import PROFILE, trend_rows

    _, tdf = trend_rows(spark)
    many = tdf.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn(
        "trend_id", F.concat_ws("-", "trend_id", "copy")).withColumn(
        "opportunity_score", (F.col("opportunity_score") * 7 + F.col("copy") * 13) % 101).drop("copy")
    pdf = spark.createDataFrame([(f"u{i}", n, ["tiktok"], ["vlog"], ["en"], g, "low") for i, (n, g) in enumerate(
        [("ai", "sales"), ("food", "authority"), ("chess", None)])], PROFILE)
    entries, buckets = U.niche_index(many, 1.0)
    _, kinds = U._kinds(pdf)
    wanted = U.niche_candidates(kinds, buckets, 6)
    scored = wanted.join(entries, ["look", "traits", "step"]).groupBy("kind").count().collect()
    total = many.count()
    assert len(scored) == 3 and max(r["count"] for r in scored) < total / 10


def test_centroids_are_read_once_a_version(spark, tmp_path):
    reads, run = [], [1]

    def centers(session):
        reads.append(run[0])
        return session.createDataFrame([(f"t{run[0]}", [1.0, 0.0])], "trend_id string, centroid array<double>")
    sink = J.assign_sink(str(tmp_path / "out"), centers, 0.6, version=lambda session: run[0])
    batch = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>")
    sink(batch, 0)
    sink(batch, 1)
    run[0] = 2
    sink(batch, 2)
    got = {(r["batch"], r["vec_id"]): r["trend_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert reads == [1, 2] and got == {(0, 1): "t1", (0, 2): None, (1, 1): "t1", (1, 2): None, (2, 1): "t2", (2, 2): None}
