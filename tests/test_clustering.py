import numpy as np
import pytest
from pyspark.sql import functions as F

from formatpulse.operators import clustering as K
from formatpulse.operators import similarity as S
from formatpulse.operators.components import connected_components

SIZES = (26, 24, 14, 48, 18, 21, 13, 16)


def planted(dim=64, noise=0.08, seed=3):
    """Eight groups, three singletons, one zero vector and a block of exact copies."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for label, size in enumerate(SIZES):
        center = rng.normal(size=dim)
        center /= np.linalg.norm(center)
        for _ in range(size):
            truth[len(rows)] = label
            rows.append(center + noise * rng.normal(size=dim))
    for label in range(100, 103):
        truth[len(rows)] = label
        rows.append(rng.normal(size=dim))
    rows.append(np.zeros(dim))
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)], truth


def brute_average_linkage(vecs, threshold):
    """Plain O(n^3) average linkage over an explicit similarity matrix."""
    v = np.array(vecs)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        best, pair = -np.inf, None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                s = sims[np.ix_(groups[a], groups[b])].mean()
                if s > best:
                    best, pair = s, (a, b)
        if best < threshold:
            break
        a, b = pair
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.fixture(scope="module")
def planted_df(spark):
    rows, truth = planted()
    return spark.createDataFrame(rows, "item_id bigint, embedding array<double>"), truth


def groups_of(members):
    out = {}
    for r in members.collect():
        out.setdefault(r["trend_id"], set()).add(r["item_id"])
    return out


def test_planted_clusters_are_recovered(spark, planted_df):
    df, truth = planted_df
    members, clusters = K.cluster_embeddings(df)
    got = sorted(len(g) for g in groups_of(members).values())
    assert got == sorted(SIZES)
    labels = spark.createDataFrame(list(truth.items()), "item_id bigint, label int")
    assert {r["purity"] for r in K.purity(members, labels).collect()} == {1.0}
    assert clusters.agg(F.sum("size")).first()[0] == sum(SIZES)
    for r in clusters.collect():
        assert abs(np.linalg.norm(r["centroid"]) - 1) < 1e-9


@pytest.mark.parametrize("local_limit,block_rows", [(2_000, 4_096), (0, 16), (12, 7)])
def test_linkage_equals_brute_force(spark, local_limit, block_rows):
    rng = np.random.default_rng(11)
    vecs = np.abs(rng.normal(size=(60, 6)))
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vecs)],
        "item_id bigint, embedding array<double>",
    )
    want = {g for g in brute_average_linkage(vecs, 0.9) if len(g) >= 2}
    members, _ = K.cluster_embeddings(
        df, 0.9, 2, local_limit=local_limit, block_rows=block_rows
    )
    assert {frozenset(g) for g in groups_of(members).values()} == want


def test_copies_count_with_their_weight(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 8))
    rows = [(i, [float(x) for x in base[0]]) for i in range(50)]
    rows += [(100 + i, [float(x) for x in base[1]]) for i in range(2)]
    df = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    members, clusters = K.cluster_embeddings(df, 0.99, 4)
    assert clusters.select("size").collect() == [(50,)]
    assert members.count() == 50
    _, reps = K.collapse_copies(S.unit_vectors(df, "item_id"))
    assert reps.count() == 2


@pytest.mark.parametrize("block_rows", [9, 40, 4_096])
def test_pairs_and_best_partner_equal_all_pairs(spark, block_rows):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(150, 5))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = unit @ unit.T
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vecs)],
        "vec_id bigint, embedding array<double>",
    )
    got = {(r["id_a"], r["id_b"]) for r in S.similarity_pairs(df, 0.8, block_rows=block_rows).collect()}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if sims[i, j] >= 0.8}
    assert got == want
    near = {r["id"]: r["nn"] for r in S.nearest_partner(S.unit_vectors(df), 0.8, block_rows).collect()}
    np.fill_diagonal(sims, -1)
    assert near == {i: int(sims[i].argmax()) for i in range(150) if sims[i].max() >= 0.8}
    forest = S.block_search(S.unit_vectors(df), 0.8, "forest", block_rows=block_rows)
    comps = {r["id"]: r["component"] for r in connected_components(forest).collect()}
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in want:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    roots = {i: find(i) for i in range(150)}
    nodes = {i for p in want for i in p}
    assert comps == {i: roots[i] for i in nodes}


def test_assignment_same_by_broadcast_and_by_blocks(spark):
    rng = np.random.default_rng(9)
    vecs, centers = rng.normal(size=(80, 6)), rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(999, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    cen = spark.createDataFrame(
        [(f"t{i:02d}", [float(x) for x in v]) for i, v in enumerate(centers)],
        "trend_id string, centroid array<double>",
    )
    a = {r[0]: (r[1], round(r[2], 9)) for r in S.assign_to_existing(df, cen, 0.5).collect()}
    b = {r[0]: (r[1], round(r[2], 9))
         for r in S.assign_to_existing(df, cen, 0.5, broadcast_bytes=0, block_rows=10).collect()}
    assert a == b
    assert a[999] == (None, 0.0)
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    c = centers / np.linalg.norm(centers, axis=1, keepdims=True)
    sims = u @ c.T
    for i in range(80):
        top = sims[i].max()
        want = f"t{sims[i].argmax():02d}" if top >= 0.5 else None
        assert a[i] == (want, round(max(0.0, top), 9))


def test_components_chain_star_and_islands(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want


def test_sweep_finds_usable_cut_on_planted_groups(spark, planted_df):
    df, _ = planted_df
    sweep = {r["threshold"]: r for r in K.threshold_sweep(df, ident="item_id").collect()}
    assert sweep[0.62]["trends"] == 8 and sweep[0.62]["covered"] == sum(SIZES)
    assert sum(r["suggested"] for r in sweep.values()) == 1
    for cut_at in (0.62, 0.3):
        _, clusters = K.cluster_embeddings(df, cut_at)
        again = K.threshold_sweep(df, [0.3, 0.62], ident="item_id").filter(F.col("threshold") == cut_at).first()
        assert again["trends"] == clusters.count()


def test_greedy_covers_every_row_with_a_direction(spark, planted_df):
    df, truth = planted_df
    got = K.greedy_cluster(df.repartition(3))
    assert got.count() == len(truth)
    labels = spark.createDataFrame(list(truth.items()), "item_id bigint, label int")
    assert {r["purity"] for r in K.purity(got, labels).collect()} == {1.0}


def test_precheck_reasons(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "item_id int, embedding array<double>")
    assert K.cluster_precheck(df).first()["reason"] == "some analyses are missing embeddings"
    assert K.cluster_precheck(df.filter("item_id = 1")).first()["reason"] == (
        "no cluster met the minimum size")
    assert K.cluster_precheck(df.filter("false")).first()["reason"] == "no analysed items in window"


def test_quantiles_interpolate_exclusively(spark):
    import statistics

    vals = [float(x) for x in np.random.default_rng(1).normal(size=250)]
    got = {r["name"]: r["value"] for r in S.similarity_quantiles(
        spark.createDataFrame([(v,) for v in vals], "similarity double")).collect()}
    qs = statistics.quantiles(vals, n=100)
    for p in S.REPORT_PERCENTILES:
        assert abs(got[f"p{p:02d}"] - qs[p - 1]) < 1e-12
    assert got["min"] == min(vals) and got["max"] == max(vals)
