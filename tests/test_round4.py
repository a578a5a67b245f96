"""Findings of the third review."""

import numpy as np
from pyspark.sql import functions as F

from formatpulse.operators import aggregates as A
from formatpulse.operators import clustering as K
from formatpulse.operators import sparse
from formatpulse.plans import bindings as B
from formatpulse.plans import catalogue_jobs as Q
from formatpulse.streaming import jobs as J


def test_streams_read_tables_of_one_or_many_files(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    rows.repartition(3).write.parquet(f"{tmp_path}/many/events.parquet")
    rows.repartition(2).write.parquet(f"{tmp_path}/many/events_old.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/raw")
    (tmp_path / "one").mkdir()
    next((tmp_path / "raw").glob("part-*")).rename(tmp_path / "one" / "events.parquet")
    for kind in ("one", "many"):
        out = f"{tmp_path}/out-{kind}"
        J.drain(Q.events_stream(spark, f"{tmp_path}/{kind}"), out, f"{tmp_path}/ck-{kind}")
        assert spark.read.parquet(out).count() == 100


def hubs(n=600, dim=24, seed=4):
    """Unit vectors of two labels with more or less of the label's axis: the most typical is everyone's best partner."""
    rng = np.random.default_rng(seed)
    v = 0.5 * rng.normal(size=(n, dim)) / np.sqrt(dim)
    v[np.arange(n), np.arange(n) % 2] += rng.uniform(0.5, 1.5, n)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def tree(merges):
    return {(int(a), int(b)): round(float(s), 9) for a, b, s in merges}


def test_chains_merge_as_the_matrix_does():
    vecs, sizes = hubs(), np.random.default_rng(1).integers(1, 4, 600)
    for cut in (0.3, 0.8):
        want = K._linkage(np.arange(600), vecs, sizes, cut)
        assert len(want) > 100 and tree(K._chain_linkage(np.arange(600), vecs, sizes, cut)) == tree(want)


def test_large_components_come_down_in_levels(spark, monkeypatch):
    """A hub gains one vector a round of mutual best partners; the levels need no such round."""
    def none(*_):
        raise AssertionError("rounds of mutual best partners")
    monkeypatch.setattr(K, "_merge_rounds", none)
    vecs = hubs(300)
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vecs)], "id bigint, vec array<double>, n bigint")
    got = K.average_linkage(df, 0.3, 100).collect()
    want = K._linkage(np.arange(300), vecs, np.ones(300), 0.3)
    assert tree((r["a"], r["b"], r["sim"]) for r in got) == tree(want)
    root = {}
    for a, b, _ in reversed(want):
        root[b] = root.get(a, a)
    assert {r["b"]: r["root"] for r in got} == root


def test_dense_lists_are_multiplied_and_short_ones_indexed(spark, monkeypatch):
    """Vectors that share most dimensions meet in nearly every list: no candidate list of all pairs is made."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (80, 20)) + 0.0
    rows[40:] = rows[:40] + (rng.random((40, 20)) < 0.05)
    long = spark.createDataFrame([(int(i), int(d) * 7, float(rows[i, d])) for i, d in zip(*np.nonzero(rows))], "id int, d int, w double")
    thin = spark.createDataFrame([(i, (i * 13 + k * 97) % 700, 1.0) for i in range(200) for k in range(4)], "id int, d int, w double")
    assert not sparse.spares(sparse.unit_entries(long)) and sparse.spares(sparse.unit_entries(thin))
    sims = np.triu((u := rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ u.T, 1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(sims >= 0.95))}
    indexed = {(r["id_a"], r["id_b"]) for r in sparse.candidate_pairs(sparse.unit_entries(long), 0.95).collect()}
    assert want and want <= indexed
    monkeypatch.setattr(sparse, "candidate_pairs", None)
    got = sparse.sparse_pairs(long, 0.95).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == want
    assert all(abs(r["similarity"] - sims[r["id_a"], r["id_b"]]) < 1e-9 for r in got)


def test_signals_are_stored_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(A, "store", lambda df, name="stored": names.append(name) or df)
    monkeypatch.setattr(B, "store", A.store, raising=False)
    B.event_aggregates(spark, "/root/testdata/sf0.001")
    assert names == ["signals"]


def test_attributes_go_out_as_combinations(spark):
    """Null, empty and equal values, and a trend of nulls only, by a plain count."""
    rng = np.random.default_rng(2)
    fields = ["platform", "niche", "country", "language", "content_type", "production_difficulty"]
    rows = [("t%d" % (i % 3), i, int(rng.integers(0, 9)), float(rng.integers(0, 5)),
             *[[None, "", "low", "high", "b"][k] for k in rng.integers(0, 5, 6)]) for i in range(200)]
    rows.append(("none", 900, None, 1.0, *[None] * 6))
    df = spark.createDataFrame(rows, "trend_id string, item_id long, creator_id long, similarity double, " + ", ".join(f"{f} string" for f in fields))
    got = {r["trend_id"]: r for r in A.attribute_summary(df).collect()}
    assert set(got) == {"t0", "t1", "t2", "none"} and got["none"]["production_difficulty"] is None
    for t, r in got.items():
        mine = [x for x in rows if x[0] == t]
        assert r["creator_count"] == len({x[2] for x in mine} - {None})
        for k, f in enumerate(fields[:5]):
            of = lambda v: [x for x in mine if x[4 + k] == v]  # noqa: E731, B023
            want = sorted({x[4 + k] for x in mine} - {None, ""}, key=lambda v: (-len(of(v)), min((-x[3], x[1]) for x in of(v))))
            assert r[A.LIST_COLUMNS[f]] == want


def test_leaders_by_batches_equal_the_plain_election(spark, monkeypatch):
    """Copies, a row without a direction and any number of rounds, by a plain loop; no pairs are listed."""
    import hashlib

    from formatpulse.operators import clustering as K
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(240, 6))
    vecs[120:180] = vecs[:60]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(900, [0.0] * 6), (901, None)]
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    leaders = []
    for i in sorted(range(240), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        if all(unit[i] @ unit[j] < 0.7 for j in leaders):
            leaders.append(i)
    want = {i: i if i in leaders else min(leaders, key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j)) for i in range(240)}
    monkeypatch.setattr(K, "block_search", None)
    frame = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    for size in (7, 64, None):
        assert {r["item_id"]: r["trend_id"] for r in K.greedy_cluster(frame, 0.7, batch_rows=size).collect()} == want
    assert K.greedy_cluster(frame.where("item_id > 899"), 0.7).count() == 0


def test_texts_are_cut_and_counted_as_by_columns(spark):
    """Nulls, empty texts, letters that lower to others, joins over text borders; tokens, pairs and vectors by the plain columns."""
    from formatpulse.functions import text as X
    texts = ["How to FIX don't-stop 3 cats cats", None, "", "the", "x", "cats", "cats fix", "Kelvin İstanbul naïve 中文 cats cats cats",
             "a b c", "fix cats fix cats fix", "ends'", "'ends", "tab\tline\nbreak 42"]
    df = spark.createDataFrame([(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(texts)], "i int, t string, lang string").repartition(2)
    tokens = X.tokenize(F.col("t"))
    for size, terms in ((1, tokens), (2, X.bigrams(tokens))):
        want = df.select("lang", F.explode(terms).alias("k")).groupBy("lang", "k").agg(F.count("*").alias("n"))
        got = X.term_counts(df, "lang", "t", size, "k")
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and want.count() > 5
    for r in df.select(X.hash_embed(tokens, 96).alias("a"), X.hash_embed_text(F.col("t"), 96).alias("b")).collect():
        assert r["a"] == r["b"] and len(r["b"]) == 96


def test_terms_that_cancel_leave_no_rest(spark):
    """A slot with terms of opposite signs is zero whatever rows its batch holds before it."""
    from formatpulse.functions import text as X
    values = np.array([1 << 63, 0, (1 << 63) + 8, 8], np.uint64)  # two signs, one slot of 8
    for order in ([0, 2, 2, 3, 3, 1], [0, 1, 2, 2, 3, 3], [3, 3, 3, 0, 2, 2, 2, 1]):
        assert not X._hashed_rows(1, np.zeros(len(order), np.int64), np.array(order), values, 8).any()
    rows = [list(p.start for p in X.pieces(np.array(n))) for n in ([], [5], [X.PIECE_BYTES * 2, 1, 1])]
    assert rows == [[], [0], [0, 1]]


def test_velocity_state_costs_a_read_a_write_and_a_timer():
    """Rows in any order, a null time and a null value; the timer moves only with a newer snapshot, and none is listed."""
    from formatpulse.streaming.jobs import LastThree

    class Handle:
        calls, held = [], None

        def getValueState(self, name, schema):
            return self

        def __getattr__(self, name):
            def call(*args):
                self.calls.append((name, *args))
                if name == "update":
                    self.held = args[0]
                return self.held
            return call
    handle, state = Handle(), LastThree(5)
    state.init(handle)
    hour = 3_600_000_000
    of = lambda *rows: list(state.handleInputRows(("a",), iter([{"at": t, "views": v} for t, v in rows]), None))
    assert of((None, 1.0)) == [] and handle.calls == [("get",)]
    got = of((3 * hour, 40.0), (hour, 10.0), (0, 5.0), (2 * hour, 20.0))[0]
    assert got.asDict() == {"item_id": "a", "at": 3 * hour, "points": 3, "velocity": 20.0, "prior_velocity": 10.0}
    assert [c[0] for c in handle.calls[1:]] == ["get", "update", "registerTimer"]
    assert of((2 * hour, None))[0]["points"] == 3 and [c[0] for c in handle.calls[4:]] == ["get", "update"]
    of((4 * hour, 41.0))
    assert handle.calls[-2:] == [("deleteTimer", 3 * hour // 1000 + 5), ("registerTimer", 4 * hour // 1000 + 5)]


def test_ingest_writes_its_batch_once(spark, monkeypatch, tmp_path):
    from formatpulse.plans import catalogue_ingest as CI
    from formatpulse.plans import ingest as IN
    from formatpulse.streaming import jobs as J
    names = []
    for module in (IN, J):
        monkeypatch.setattr(module, "store", lambda df, name="stored", real=module.store: names.append(name) or real(df, name))
    assert CI.ingest_counts(spark, "/root/testdata/sf0.001").count() > 5
    assert names.count("ingest") == 1 and "batch" not in names


def test_seconds_are_read_as_the_plain_cast_reads_them(spark):
    from formatpulse.sources import landed
    texts = ["1709251200", " 12.5 ", "1e9", "-3", "nan", "7d", "", "soon", None, "2024-02-01T00:00:00Z", "12:30", "text 5", "0x1p3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", landed.seconds_of(F.col("t")).alias("a"), F.col("t").try_cast("double").alias("b")).collect():
        assert r["a"] == r["b"] or (r["a"] != r["a"] and r["b"] != r["b"]), r
