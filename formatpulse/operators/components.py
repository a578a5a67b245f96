"""Connected components by alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from formatpulse.session import cut


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, component) for every node with an edge; the component is its smallest id.

    Each round hooks larger neighbours, then smaller ones, onto the smallest neighbour.
    Minima are map-side combined, so a hub with many edges is reduced before it is
    shuffled, and joining a minimum back is an equi-join that AQE may split. The edge
    table is stored once per round; rounds grow with the logarithm of the size.
    """
    x, y = F.col(src), F.col(dst)
    current, mark = _store(
        edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    )
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        large = (
            both.join(low, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .unionByName(low2.withColumnRenamed("m", "v"))
        )
        current, now = _store(small)
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("v").alias("u"), "v").distinct()
    return current.unionByName(roots).select(
        F.col("u").alias("id"), F.col("v").alias("component")
    )


def _store(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges as a stored table, with a fingerprint observed while writing."""
    seen = Observation()
    stored = cut(
        edges.distinct().observe(
            seen, F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h"),
        )
    )
    return stored, (seen.get["n"], seen.get["h"])
