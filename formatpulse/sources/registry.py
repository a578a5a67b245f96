"""Named sources and their union over platform and niche requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formatpulse import schemas

Normaliser = Callable[[str | None], DataFrame]
_SOURCES: dict[str, Normaliser] = {}


class NotConfigured(RuntimeError):
    """A source cannot run because its landing place or settings are missing."""


def register_source(name: str, normaliser: Normaliser) -> None:
    """``normaliser(niche)`` returns raw items, or raises :class:`NotConfigured`."""
    _SOURCES[name] = normaliser


def get_source(name: str) -> Normaliser:
    if name not in _SOURCES:
        raise KeyError(f"no source registered for platform '{name}'")
    return _SOURCES[name]


def all_sources() -> dict[str, Normaliser]:
    return dict(_SOURCES)


def multi_source_union(
    spark: SparkSession, platforms: list[str], niches: list[str | None]
) -> tuple[DataFrame, DataFrame]:
    """(raw items of every platform and niche, audit rows). The union is lazy: each part
    stays its own scan with its own pushed filters."""
    out, audit = spark.createDataFrame([], schemas.RAW_ITEMS), []
    for platform in platforms:
        for niche in niches:
            try:
                part = get_source(platform)(niche)
            except NotConfigured as exc:
                audit.append((platform, niche, str(exc)))
                continue
            out = out.unionByName(part, allowMissingColumns=True)
            audit.append((platform, niche, None))
    return out, spark.createDataFrame(audit, "platform string, niche string, skipped string")
