"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them, one vector kept
of each group.

Directions are assigned to the nearest of k centroids. A partner may lie across a border, so a vector
also visits every cell whose border is near enough: the great circle half way between two centroids
parts their cells, and two vectors on its sides are at least the sum of their angles to it apart. So
pairs of cells meet (a cell with itself included), and only vectors whose angle to the border, added to
the least such angle on the other side, stays within the angle of the threshold. No link is lost.

In a task, cosines are block products of both sides, each sorted by its angle to the border, so that
whole stretches fall out. It returns a count of links for each vector and a spanning tree of each group
it saw, never pairs. Cells and visits of more than ``block`` vectors are dealt into blocks by a hash,
which meet pairwise in tasks of their own. Equal vectors count once, with their number.

Cells part data that have structure. Where directions are spread evenly in many dimensions, borders
are near to all vectors, and the search costs what comparing all blocks costs, spread over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.llm.common import small
from formatpulse.operators.components import connected_components
from formatpulse.session import store

THRESHOLD = 0.95
#: Vectors a cell should hold, and the most cells.
CELL, MAX_CELLS = 2048, 1024
#: Vectors of each side in a task.
BLOCK = 2048
#: Documented bound of the sample that the centroids are fitted on: vectors, and numbers in them.
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
ROUNDS = 8
#: Added to angles and taken from cosines where they only filter, against rounding.
SLACK = 1e-9

_KEY = ("a", "b")


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(packed: list[bytes]) -> np.ndarray:
    """Rows of unit length from packed doubles, all of one dimension; scaled first, so no square overflows."""
    x = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell takes the row that fits its own centroid worst."""
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        cosine = x @ centers.T
        home = cosine.argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(1))
        poor = np.argsort(cosine[np.arange(len(x)), home])
        for place, cell in enumerate(np.flatnonzero(size < 1e-12)):
            sums[cell], size[cell] = x[poor[place]], 1.0
        centers = sums / size[:, None]
    return np.unique(centers, axis=0)


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """(a, b, dim, weight, data): distinct usable vectors, their number, and their doubles as bytes."""
    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, "<f8").tobytes() for v in values], dtype=object)
    value = F.col("embedding").cast("array<double>")
    rows = vectors.where(usable(value)).select(*_names(value), value.alias("value"))
    once = rows.groupBy(*_KEY).agg(F.count("*").alias("weight"), F.first("value").alias("value"))
    return once.select(*_KEY, F.size("value").alias("dim"), "weight", pack("value").alias("data"))


def _names(value: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), value).alias(name) for i, name in enumerate(_KEY)]


def fit_cells(stored: DataFrame, cell: int = CELL, most: int = MAX_CELLS) -> dict[int, np.ndarray]:
    """Centroids by dimension, from a sample by hash of at most ``SAMPLE`` vectors and ``SAMPLE_VALUES`` numbers of each."""
    found = {}
    for row in stored.groupBy("dim").agg(F.count("*").alias("n")).collect():  # one row a dimension
        dim, n = row["dim"], row["n"]
        k = min(most, max(1, math.ceil(n / cell)), max(1, SAMPLE_VALUES // dim // 16))
        if k > 1:
            rows = stored.where(F.col("dim") == dim).orderBy(F.xxhash64(F.lit(7), *_KEY)).limit(
                min(SAMPLE, max(16 * k, SAMPLE_VALUES // dim))).select("data").collect()
            found[dim] = spherical_kmeans(units([r["data"] for r in rows]), k)
        else:
            found[dim] = np.zeros((1, dim))
    return found


def visits(stored: DataFrame, cells: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(a, b, dim, home, other, angle): a vector's own cell at angle 0, and every cell whose border with its own is
    within the threshold's angle."""
    reach = math.acos(threshold) + SLACK
    shared = stored.sparkSession.sparkContext.broadcast(cells)  # MAX_CELLS rows, SAMPLE_VALUES / 16 numbers at most

    def assign(batches):
        for rows in batches:
            for dim, part in rows.groupby("dim"):
                centers = shared.value[dim]
                gap = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 0)) + np.eye(len(centers))
                for lo in range(0, len(part), BLOCK):
                    some = part.iloc[lo:lo + BLOCK]
                    cosine = units(some["data"].tolist()) @ centers.T
                    home = cosine.argmax(1)
                    at = np.arange(len(some))
                    sine = (cosine[at, home][:, None] - cosine) / gap[home]
                    angle = np.arcsin(np.clip(sine, 0, 1))
                    angle[at, home] = 0
                    which, other = np.nonzero(angle <= reach)
                    yield pd.DataFrame({
                        "a": some["a"].to_numpy()[which], "b": some["b"].to_numpy()[which], "dim": dim,
                        "home": home[which], "other": other, "angle": angle[which, other]})
    return stored.select(*_KEY, "dim", "data").mapInPandas(
        assign, "a bigint, b bigint, dim int, home int, other int, angle double")


def meetings(visited: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, dim, angle, left, right, i, j, side): the tasks each vector takes part in. A task is block i of
    the left cell's visitors against block j of the right one's; blocks of one cell meet once."""
    reach = math.acos(threshold) + 2 * SLACK
    ends = visited.groupBy("dim", "home", "other").agg(F.min("angle").alias("least"), F.count("*").alias("n"))
    ends = store(ends, "borders")  # MAX_CELLS squared rows at most
    back = ends.select("dim", F.col("home").alias("other"), F.col("other").alias("home"),
                       F.col("least").alias("least_there"), F.col("n").alias("n_there"))
    both = ends.join(back, ["dim", "home", "other"]).where(F.col("least") + F.col("least_there") <= reach)
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    both = both.select("dim", "home", "other", "least_there", blocks("n").alias("own"), blocks("n_there").alias("there"))
    rows = visited.join(small(store(both, "facing")), ["dim", "home", "other"]).where(
        F.col("angle") + F.col("least_there") <= reach)
    mine = F.pmod(F.xxhash64(F.lit(9), *_KEY), F.col("own")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("there") - 1)))
    first = (F.col("home") < F.col("other")) | ((F.col("home") == F.col("other")) & (F.col("mine") <= F.col("theirs")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.select(*_KEY, "dim", "angle", pick("home", "other").alias("left"), pick("other", "home").alias("right"),
                       pick("mine", "theirs").alias("i"), pick("theirs", "mine").alias("j"), (~first).cast("int").alias("side"))


def compare(x: np.ndarray, y: np.ndarray | None, threshold: float, at_x: np.ndarray, at_y: np.ndarray,
            step: int = 256):
    """(i, js): rows of x with the rows of y that reach the threshold; without y, x meets itself. Both sides are sorted by
    their angle to the border. Cosines within ``SLACK`` of the threshold are computed anew, one by one."""
    reach = math.acos(threshold) + 2 * SLACK
    other = x if y is None else y
    for lo in range(0, len(x), step):
        until = int(np.searchsorted(at_y, reach - at_x[lo], "right"))
        cosine = x[lo:lo + step] @ other[:until].T
        hit = cosine >= threshold
        for r, c in np.argwhere(np.abs(cosine - threshold) < SLACK):
            hit[r, c] = math.fsum(x[lo + r] * other[c]) >= threshold
        for r in np.flatnonzero(hit.any(1)):
            js = np.flatnonzero(hit[r])
            yield lo + int(r), js[js != lo + r] if y is None else js


def links(stored: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n_links, root): for each task and vector with links in it, their number and a vector of its group there."""
    rows = met.join(stored.select(*_KEY, "weight", "data"), list(_KEY))

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "angle"], kind="stable").reset_index(drop=True)
        x = units(rows["data"].tolist())
        angle, weight = rows["angle"].to_numpy(), rows["weight"].to_numpy()
        one = rows["left"].iloc[0] == rows["right"].iloc[0] and rows["i"].iloc[0] == rows["j"].iloc[0]
        cut = len(rows) if one else int((rows["side"] == 0).sum())
        y = None if one else x[cut:]
        shift = 0 if one else cut
        n_links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for i, js in compare(x[:cut], y, threshold, angle[:cut], angle[shift:]):
            js = js + shift
            n_links[i] += weight[js].sum()
            if not one:
                n_links[js] += weight[i]
            groups = np.unique(label[np.append(js, i)])
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
        some = np.flatnonzero(n_links)
        root = label[some]
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        return pd.DataFrame({"a": a[some], "b": b[some], "n_links": n_links[some], "root_a": a[root], "root_b": b[root]})
    return rows.groupBy("dim", "left", "right", "i", "j").applyInPandas(
        task, "a bigint, b bigint, n_links bigint, root_a bigint, root_b bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK,
                 most: int = MAX_CELLS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
    vectors of different dimensions with each other. Equal vectors, repeated rows included, link with one another.
    A null vec_id is the largest: its group is named by another id, if it has one. Further columns are ignored; a
    table without rows gives none.
    """
    stored = store(packed_vectors(vectors), "vectors")
    cells = fit_cells(stored, cell, most)
    met = meetings(store(visits(stored, cells, threshold), "visits"), threshold, block)
    found = store(links(stored, met, threshold), "links")
    counts = found.groupBy(*_KEY).agg(F.sum("n_links").alias("n"))
    name = lambda *c: F.struct(*[F.col(x).alias(k) for x, k in zip(c, _KEY, strict=True)])
    parts = connected_components(found.select(name("a", "b").alias("a"), name("root_a", "root_b").alias("b")).where("a <> b"))
    parts = parts.select("id.*", F.col("component").alias("part"))
    linked = stored.where("weight > 1").select(*_KEY, "weight").join(counts, list(_KEY), "full").join(parts, list(_KEY), "left")
    linked = store(linked.select(*_KEY, (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                                 F.coalesce("part", name("a", "b")).alias("part")), "linked")
    value = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", *[F.when(usable(value), c).alias(k) for c, k in zip(_names(value), _KEY, strict=True)])
    rows = rows.join(linked, list(_KEY), "left")
    least = rows.where("part IS NOT NULL").groupBy("part").agg(F.min("vec_id").alias("component_id"))
    # the groups' names are one row a group and join the vectors that have links
    out = rows.join(least, "part", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
