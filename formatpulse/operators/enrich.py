"""Pluggable encoders and feature tiers, called once per Arrow batch inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formatpulse.functions.text import hash_embed_text
from formatpulse.schemas import EMBEDDING_DIM
from formatpulse.session import cut, store


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]:
        """One vector per text; raise to signal failure."""


def embed_local(df: DataFrame, text: str = "signature", dim: int = EMBEDDING_DIM) -> DataFrame:
    return df.withColumn("embedding", hash_embed_text(F.coalesce(F.col(text), F.lit("")), dim))


def embed_many(
    df: DataFrame, ident: str = "item_id", text: str = "signature",
    encoder: Encoder | None = None, batch: int = 100, dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """(``ident``, embedding). A failed batch sends the *whole* set to the local encoder,
    since vectors of two encoders cannot be compared. The encoded rows are checkpointed
    before that test, so a hosted encoder is called once per row."""
    rows = df.select(ident, text)
    if encoder is None:
        return embed_local(rows, text, dim).select(ident, "embedding")
    kind = rows.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs: list = []
            for at in range(0, len(pdf), batch):
                part = [t or "" for t in pdf[text].iloc[at:at + batch]]
                try:
                    got = encoder(part)
                    if len(got) != len(part):
                        raise ValueError("encoder returned a wrong number of vectors")
                except Exception:  # any provider failure means fallback
                    got = [None] * len(part)
                vecs += got
            yield pd.DataFrame({ident: pdf[ident], "embedding": vecs})

    encoded = cut(rows.mapInPandas(run, f"{ident} {kind}, embedding array<float>"))
    if encoded.filter(F.col("embedding").isNull()).isEmpty():
        return encoded
    return embed_local(rows, text, dim).select(ident, "embedding")


class QuotaExhausted(RuntimeError):
    """A tier is out of quota; the row should wait rather than take a worse result."""


Tier = tuple[str, Callable[[dict], dict | None]]


def enrich(df: DataFrame, tiers: list[Tier], fields: str) -> DataFrame:
    """Run each row down the tiers until one answers.

    Adds the ``fields`` (a DDL string), ``tier`` and ``fallback_reason`` ("quota" or
    "error" when the last tier answered after a failure, "no_llm" when it was the only
    one). Rows with reason "quota" are meant to be deferred, see :func:`split_deferred`.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    names = [part.strip().split(" ")[0] for part in fields.split(",")]

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {n: [] for n in [*names, "tier", "fallback_reason"]}
            for row in pdf.to_dict("records"):
                answer, used, reason = None, None, None if len(tiers) > 1 else "no_llm"
                for name, call in tiers:
                    try:
                        answer = call(row)
                    except QuotaExhausted:
                        reason = "quota"
                    except Exception:  # one bad row must not fail the task
                        reason = reason or "error"
                    else:
                        if answer is None and name != tiers[-1][0]:
                            reason = reason or "error"
                    if answer is not None:
                        used = name
                        break
                last = used in (None, tiers[-1][0])
                for n in names:
                    out[n].append((answer or {}).get(n))
                out["tier"].append(used)
                out["fallback_reason"].append(reason if last else None)
            yield pdf.assign(**out)

    return df.mapInPandas(climb, f"{schema}, {fields}, tier string, fallback_reason string")


def split_deferred(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows to leave pending). Checkpointed once: tiers are not re-run."""
    done = cut(enriched)
    wait = F.coalesce(F.col("fallback_reason") == "quota", F.lit(False))
    return done.filter(~wait), done.filter(wait)


@dataclass(frozen=True)
class BatchTier:
    """A tier that answers whole batches: a list of rows (dicts) gives a list of answers, None where it has none. With
    ``quota``, all runs of one period together give it at most so many rows."""

    name: str
    call: Callable[[list[dict]], list[dict | None]]
    quota: int | None = None


LEDGER = "period string, run bigint, tier string, used bigint"


class Ledger:
    """What tiers have used, one folder a run and period under ``path``; a repeated run replaces its own rows."""

    def __init__(self, spark: SparkSession, path: str, period: str, run: int):
        self.spark, self.path, self.period, self.run = spark, path, period, run

    def left(self, tier: BatchTier) -> int | None:
        """Rows that the tier may still take, before this run."""
        if tier.quota is None:
            return None
        others = (F.col("period") == self.period) & (F.col("run") != self.run) & (F.col("tier") == tier.name)
        used = self.rows().where(others).agg(F.coalesce(F.sum("used"), F.lit(0))).first()[0]
        return max(0, tier.quota - used)

    def rows(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(self.path)

    def book(self, used: dict[str, int]) -> None:
        rows = [(self.period, self.run, tier, n) for tier, n in used.items()]
        self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/slot={self.period}-{self.run}")


def enrich_batches(
    df: DataFrame, tiers: list[BatchTier], fields: str, ledger: Ledger, order: list[Column], ident: str = "item_id",
    batch: int = 40,
) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows left pending). The first tiers' quotas are dealt before any call: of the rows in ``order``
    (unique, as ``ident`` is), as many go on as the least of the quotas left allows; the others wait with reason "quota" rather than take a
    worse result, and a later run, or the next period, takes them up. What is booked is what was dealt, so a
    task that runs again spends nothing anew.

    Rows that go on meet the tiers in turn, ``batch`` at a time; the ones a tier leaves unanswered, or whose batch fails,
    meet the next. Adds ``fields`` (a DDL string), ``tier`` and ``fallback_reason``: "error" when the last tier answered after
    a failure, "no_llm" when it is the only one, else null.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = [part.strip().split(" ")[0] for part in fields.split(",")]
    free = [x for x in (ledger.left(t) for t in tiers) if x is not None]
    room = min(free, default=None)
    df = store(df, "pending")  # the same rows are dealt, booked and enriched
    dealt, waiting = df, df.limit(0)
    if room is not None:
        dealt = cut(df.orderBy(*order).limit(room))
        waiting = df.join(dealt.select(ident), ident, "left_anti")
    ledger.book({t.name: dealt.count() for t in tiers if t.quota is not None})

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            answers: list[dict | None] = [None] * len(rows)
            used: list[str | None] = [None] * len(rows)
            reason: list[str | None] = ["no_llm" if len(tiers) == 1 else None] * len(rows)
            for tier in tiers:
                todo = [i for i, a in enumerate(answers) if a is None]
                for at in range(0, len(todo), batch):
                    part = todo[at:at + batch]
                    try:
                        got = tier.call([rows[i] for i in part])
                        if len(got) != len(part):
                            raise ValueError("a tier answered for another number of rows")
                    except Exception:  # a failed batch goes to the next tier
                        got = [None] * len(part)
                    for i, answer in zip(part, got, strict=True):
                        answers[i], used[i] = answer, None if answer is None else tier.name
                        if answer is None:
                            reason[i] = reason[i] or "error"
            out = {n: [(a or {}).get(n) for a in answers] for n in names}
            last = tiers[-1].name
            yield pdf.assign(**out, tier=used, fallback_reason=[
                r if u in (None, last) else None for r, u in zip(reason, used, strict=True)])

    done = cut(dealt.mapInPandas(climb, f"{schema}, {fields}, tier string, fallback_reason string"))
    return done, waiting.withColumn("fallback_reason", F.lit("quota"))
