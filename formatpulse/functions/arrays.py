"""Array columns: case-insensitive membership, overlap, ordered distinct, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def lowered(arr: Column) -> Column:
    return F.transform(F.coalesce(arr, empty_strings()), lambda v: F.lower(v))


def array_contains_ci(arr: Column, value: str) -> Column:
    """Exact element equality, ignoring case."""
    return F.exists(F.coalesce(arr, empty_strings()), lambda v: F.lower(v) == value.lower())


def overlap(left: Column, right: Column) -> Column:
    """Lower-cased set intersection in sorted order."""
    return F.array_sort(F.array_intersect(lowered(left), lowered(right)))


def ordered_distinct(arr: Column) -> Column:
    """First occurrence wins; order kept."""
    return F.array_distinct(arr)


def to_nested(value: Column) -> Column:
    return F.to_json(value)


def from_nested(text: Column, ddl: str) -> Column:
    return F.from_json(text, ddl)
