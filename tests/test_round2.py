"""Cases that an earlier version got wrong; expected values are written by hand."""

import pytest

from formatpulse import session
from formatpulse.operators import similarity, upserts
from formatpulse.operators.clustering import greedy_cluster


def test_new_creator_keeps_zeros_and_empty_texts(spark):
    kind = ("platform string, handle string, display_name string, followers bigint, "
            "baseline_median_views bigint, niche string")
    stored = spark.createDataFrame([("p", "old", "Old", 5, 7, "ai")], kind)
    batch = spark.createDataFrame(
        [("p", "new", "", 0, 0, "food", 1), ("p", "late", "", 0, 0, "food", 1), ("p", "late", "Late", 9, 0, "x", 2),
         ("p", "old", "", 0, 0, "zz", 3)], kind + ", seq bigint")
    got = {r["handle"]: tuple(r[2:]) for r in upserts.upsert_creators(stored, batch).collect()}
    assert got == {"new": ("", 0, 0, "food"), "late": ("Late", 9, 0, "food"), "old": ("Old", 5, 7, "ai")}


def test_centroid_ties_do_not_depend_on_the_table_size(spark):
    centroids = spark.createDataFrame([(10, [1.0, 0.0]), (2, [1.0, 0.0]), (-3, [0.0, 1.0])],
                                      "trend_id bigint, centroid array<double>")
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "vec_id bigint, embedding array<double>")
    for size in (similarity.BROADCAST_BYTES, 0):
        got = {r["vec_id"]: r["trend_id"] for r in
               similarity.assign_to_existing(rows, centroids, broadcast_bytes=size).collect()}
        assert got == {1: 2, 2: -3}


def test_other_masters_need_a_named_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            @staticmethod
                            def isDefined():
                                return False
                        return Empty
                return Sc

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)


def test_leaders_follow_planted_groups(spark):
    rows = [(g * 100 + i, [float(g == k) + 0.01 * ((i * 7 + k) % 5) for k in range(6)]) for g in range(6) for i in range(60)]
    frame = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    found = {}
    for r in greedy_cluster(frame, 0.8).collect():
        found.setdefault(r["trend_id"], set()).add(r["item_id"] // 100)
    assert len(found) == 6 and all(len(v) == 1 for v in found.values())


def test_landed_numbers_and_texts_differ(spark, tmp_path):
    import json
    from datetime import datetime

    from formatpulse.sources import landed, normalise
    now = datetime(2024, 3, 1)
    rows = [("a", 1200000.0, 1709251200), ("b", 3.7, "20240101"), ("c", "3.7", "2024-02-01T00:00:00Z"),
            ("d", "12", 1709251200.5), ("e", None, None), ("f", "x", "soon")]
    path = tmp_path / "landed.jsonl"
    path.write_text("\n".join(json.dumps({"items": [{"id": i, "views": v, "created_at": t}]}) for i, v, t in rows))
    raw = normalise.normalise_provider(
        landed.well_formed(landed.read_landed(spark, str(path), "json", landed.PROVIDER)), "p", now)
    got = {r["external_id"]: r for r in raw.collect()}
    assert {i: r["views"] for i, r in got.items()} == {"a": 1200000, "b": 3, "c": 0, "d": 12, "e": 0, "f": 0}
    assert got["a"]["published_at"] == datetime(2024, 3, 1) and got["c"]["published_at"] == datetime(2024, 2, 1)
    assert got["d"]["published_at"] == datetime(2024, 3, 1, 0, 0, 0, 500000)
    assert all(got[i]["published_at"] == now for i in "bef")
