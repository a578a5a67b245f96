"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells (source, language, topic). Raking scales the cells' token weights to the
target shares of each margin in turn until all three hold, and no cell gets more than its tokens. A
cell's documents are then kept with one probability, so that the expected tokens follow the raked
weights and sum to the wanted budget.
Up to ``LOCAL_CELLS`` cells are raked in numpy on the driver; more stay a distributed table throughout,
whose margins are grouped sums, so that only single numbers (errors, totals) reach the driver.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.llm.common import small
from formatpulse.session import cut

DIMS = ("__source", "__lang", "__topic")

#: Cells up to which raking runs on the driver; the rule is the same on both sides.
LOCAL_CELLS = 100_000
#: A round that moves no weight by this share of all tokens has changed nothing.
UNCHANGED = 1e-12
LOG = logging.getLogger(__name__)

#: Topic -> a text that marks it; the first that fits names the topic.
TOPICS = (("legal", ("icensed under", "License", "rights reserved", "Copyright")),
          ("tabular", (" | ",)),
          ("contact", ("@",)),
          ("markup", ("</", "###", "$$$")))


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = F.lit("general")
    for name, marks in reversed(topics):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(text, F.lit(mark))
        out = F.when(hit, name).otherwise(out)
    return out


def celled(docs: DataFrame, topics=TOPICS) -> DataFrame:
    """``docs`` with its cell and its tokens (words); null source or language is a value of its own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "*", F.coalesce("source", F.lit("(none)")).alias("__source"),
        F.coalesce("lang", F.lit("(none)")).alias("__lang"), topic_of(text, topics).alias("__topic"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("__tokens"))


def target_shares(cells: DataFrame, dim: str, wanted: dict[str, float] | None, alpha: float) -> DataFrame:
    """(dim, __target): listed values get their weight, the others share what is left in proportion
    to tokens^alpha; all of them by that rule where nothing is listed. Shares sum to 1 over the
    values that have tokens."""
    margin = cells.groupBy(dim).agg(F.sum("__tokens").alias("__t")).where("__t > 0")
    wanted = wanted or {}
    listed = F.lit(None).cast("double")
    for value, weight in wanted.items():
        listed = F.when(F.col(dim) == value, float(weight)).otherwise(listed)
    rest = max(0.0, 1.0 - sum(wanted.values()))
    raw = margin.select(dim, listed.alias("__listed"), F.pow("__t", F.lit(alpha)).alias("__p"))
    total = raw.agg(F.sum(F.when(F.col("__listed").isNull(), F.col("__p"))).alias("__free")).first()["__free"]
    share = F.coalesce("__listed", F.col("__p") * rest / (total or 1.0))
    raw = raw.select(dim, share.alias("__share"))
    whole = raw.agg(F.sum("__share").alias("s")).first()["s"] or 1.0
    return raw.select(dim, (F.col("__share") / whole).alias("__target"))


def reachable(cells: DataFrame, dim: str, target: DataFrame, budget: float) -> DataFrame:
    """``target`` as ``budget`` tokens can hold it: no value gets more tokens than it has, and what
    such values cannot take goes to the others in proportion to their targets."""
    if not budget:
        return target
    margin = cells.groupBy(dim).agg(F.sum("__tokens").alias("__tokens"))
    side = probabilities(cut(margin.join(target.withColumnRenamed("__target", "__weight"), dim)), budget)
    return side.select(dim, (F.col("__p") * F.col("__tokens") / float(budget)).alias("__target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 500, tolerance: float = 1e-4,
         budget: float | None = None) -> DataFrame:
    """Adds __weight, shares that sum to 1 and meet every margin within ``tolerance``, as far as the
    cells allow: it ends early only when a round no longer changes the weights. A result that misses
    the tolerance, for that reason or because ``rounds``, a safety bound, ran out, is logged.

    With a ``budget`` of tokens no weight exceeds the cell's tokens / budget. A full cell stays at
    that bound while its value's open cells are raked to what is left of the margin, and opens again
    when a factor pulls it below: one Newton step of each value's factor a round.
    """
    cells = cells.where("__tokens > 0")
    few = cells.limit(LOCAL_CELLS + 1).collect()
    if few and len(few) <= LOCAL_CELLS:
        return rake_local(cells, few, targets, rounds, tolerance, budget)
    total = cells.agg(F.sum("__tokens").alias("t")).first()["t"] or 1
    bound = F.col("__tokens") / float(budget) if budget else F.lit(float("inf"))
    held = F.least("__weight", bound)
    out = cut(cells.withColumn("__weight", F.col("__tokens") / total))
    worst = None
    for _ in range(rounds):
        out = out.withColumn("__before", held)
        for dim, target in targets.items():
            is_open = F.col("__weight") < bound
            margin = out.groupBy(dim).agg(
                F.sum(F.when(is_open, F.col("__weight")).otherwise(0.0)).alias("__open"),
                F.sum(F.when(is_open, 0.0).otherwise(bound)).alias("__full"), F.sum("__weight").alias("__m"))
            left, over = F.col("__target") - F.col("__full"), F.col("__open") + F.col("__full") - F.col("__target")
            factor = margin.join(target, dim).select(
                dim, F.when(F.abs(over) <= 1e-12, 1.0)
                .when((F.col("__open") > 0) & (left > 0), left / F.col("__open"))
                .when(over > 0, F.col("__target") / F.col("__m")).otherwise(1.0).alias("__f"))
            out = out.join(factor, dim).withColumn("__weight", F.col("__weight") * F.col("__f")).drop("__f")
        out = cut(out)
        errors = [out.groupBy(dim).agg(F.sum(held).alias("__m")).join(target, dim)
                  .agg(F.max(F.abs(F.col("__m") - F.col("__target"))).alias("e")) for dim, target in targets.items()]
        union = errors[0]
        for e in errors[1:]:
            union = union.union(e)
        worst = union.agg(F.max("e").alias("e")).first()["e"]
        change = out.agg(F.max(F.abs(held - F.col("__before"))).alias("c")).first()["c"]
        out = out.drop("__before")
        if worst is None or worst < tolerance or change < UNCHANGED:
            break
    _report(worst, tolerance)
    return out.withColumn("__weight", held)


def _report(worst: float | None, tolerance: float) -> None:
    if worst is not None and worst >= tolerance:
        LOG.warning("raking misses a margin by %.6f of all tokens (tolerance %.6f)", worst, tolerance)


def rake_local(cells: DataFrame, rows: list, targets: dict[str, DataFrame], rounds: int, tolerance: float,
               budget: float | None) -> DataFrame:
    """``rake`` of the collected ``rows`` of ``cells``."""
    wanted = {d: {r[d]: r["__target"] for r in t.collect()} for d, t in targets.items()}
    rows = sorted(r for r in rows if all(r[d] in wanted[d] for d in targets))
    frame = pd.DataFrame(rows, columns=cells.columns)
    places, shares = {}, {}
    for d in targets:
        places[d], values = pd.factorize(frame[d])
        shares[d] = np.array([wanted[d][v] for v in values], float)
    tokens = frame["__tokens"].to_numpy(float)
    weight = tokens / tokens.sum()
    bound = tokens / budget if budget else np.full(len(tokens), np.inf)

    def margin(d: str, x: np.ndarray) -> np.ndarray:
        return np.bincount(places[d], x, len(shares[d]))

    worst = None
    for _ in range(rounds):
        start = np.minimum(weight, bound)
        for d, target in shares.items():
            is_open = weight < bound
            opened, full = margin(d, np.where(is_open, weight, 0)), margin(d, np.where(is_open, 0, bound))
            left, over = target - full, opened + full - target
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.select(
                    [np.abs(over) <= 1e-12, (opened > 0) & (left > 0), over > 0],
                    [1.0, left / opened, target / margin(d, weight)], 1.0)
            weight = weight * factor[places[d]]
        held = np.minimum(weight, bound)
        worst = max(np.abs(margin(d, held) - target).max(initial=0) for d, target in shares.items())
        if worst < tolerance or np.abs(held - start).max() < UNCHANGED:
            break
    _report(worst, tolerance)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    out = [(*r, float(w)) for r, w in zip(rows, np.minimum(weight, bound), strict=True)]
    return cells.sparkSession.createDataFrame(out, f"{names}, __weight double")


def probabilities(raked: DataFrame, budget: float, max_steps: int = 60) -> DataFrame:
    """Adds __p: min(1, scale * weight / tokens), with the scale that makes expected tokens meet
    ``budget`` (all tokens if that is more). Each step caps more cells, so it ends."""
    ratio = F.col("__weight") / F.col("__tokens")
    scale, before = float(budget), None
    for _ in range(max_steps):
        full = ratio * scale >= 1
        row = raked.agg(F.sum(F.when(full, F.col("__tokens"))).alias("full"), F.count_if(full).alias("n"),
                        F.sum(F.when(~full, F.col("__weight"))).alias("open")).first()
        if row["n"] == before or not row["open"]:
            break
        before = row["n"]
        scale = max(scale, (budget - (row["full"] or 0)) / row["open"])
    return raked.withColumn("__p", F.least(F.lit(1.0), ratio * scale))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = 0.5,
        keep: float = 0.5, topics=TOPICS, seed: int = 11) -> DataFrame:
    """``docs`` with topic, n_tokens, probability, weight (1/probability) and kept.

    ``targets`` maps source, lang, topic to wanted shares of tokens; ``alpha`` flattens the margins
    that are not given; ``keep`` is the budget as a share of all tokens. Where the budget asks for
    more tokens of a value than there are, all of them are kept and the other values share the rest in
    proportion to their targets; a smaller ``keep`` meets the targets as given. The draw is a hash of
    seed, doc_id and text, so it repeats, and repeated rows share their fate. Documents without a
    word (null and empty texts among them) carry no token mass: probability 0, kept false. An empty
    table gives no rows. Further columns pass through, save those named above.
    """
    targets = targets or {}
    rows = celled(docs, topics)
    cells = cut(rows.groupBy(*DIMS).agg(F.sum("__tokens").alias("__tokens"), F.count("*").alias("__docs")))
    wanted = {d: cut(target_shares(cells, d, targets.get(d.strip("_")), alpha)) for d in DIMS}
    total = cells.agg(F.sum("__tokens").alias("t")).first()["t"] or 0
    for d in DIMS:  # cells of a value with target 0 are left out of all margins
        cells = cells.join(wanted[d].where("__target > 0").select(d), d, "left_semi")
    cells = cut(cells.where("__tokens > 0"))
    budget = float(min(keep * total, cells.agg(F.sum("__tokens").alias("t")).first()["t"] or 0))
    wanted = {d: cut(reachable(cells, d, wanted[d], budget)) for d in DIMS}
    chance = cut(probabilities(rake(cells, wanted, budget=budget), budget).select(*DIMS, "__p"))
    both = rows.join(small(chance, 100_000), list(DIMS), "left")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    chance_of = F.when(F.col("__tokens") > 0, F.coalesce("__p", F.lit(0.0))).otherwise(0.0)
    both = both.withColumns({"probability": chance_of, "n_tokens": F.col("__tokens"), "topic": F.col("__topic")})
    both = both.withColumns({
        "weight": F.when(F.col("probability") > 0, 1 / F.col("probability")),
        "kept": draw < F.col("probability")})
    return both.drop(*DIMS, "__tokens", "__p")
