"""Vector columns (``array<float|double>``) as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero.

    The norm is computed once through a one-element array, so it is not re-evaluated
    for every element.
    """
    return F.element_at(
        F.transform(
            F.array(norm(v)),
            lambda n: F.transform(
                v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)
            ),
        ),
        1,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side is a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)
