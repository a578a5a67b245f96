"""Quality rules: learned decision lists over text statistics.

Sequential covering in the RIPPER manner: rules for low quality are grown one at a time, condition
by condition, by information gain on two thirds of the labelled rows, pruned back from the end on
the other third, and accepted while they stay precise there; covered rows leave. The ordered list of
threshold conjunctions becomes one Spark conditional expression, so it can be read and it runs in
the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.session import store

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
_CAPITALS = bytes(range(65, 91))

#: Documented bound of the training sample, in labelled rows.
SAMPLE_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words",
          "n_lines", "n_capitals", "n_exclamations")

#: Feature -> SQL expression over the counts; the rules speak of these.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "exclamation_share": "n_exclamations / greatest(n_words, 1)",
}


def repeated_words(ids: np.ndarray, n: int = 5) -> int:
    """Words that stand in an n-word window found twice or more. Windows are named exactly, by
    numbering pairs of (name of the first words, next word)."""
    if len(ids) < n + 1:
        return 0
    width = int(ids.max()) + 1
    names = ids
    for k in range(1, n):
        names = names[:-1] * width + ids[k:]
        names, counts = np.unique(names, return_inverse=True, return_counts=True)[1:]
    twice = counts[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; words are runs of anything but the six ASCII blanks, as bytes.split has it."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(ids), len(known), len(lines),
            len(data) - len(data.translate(None, _CAPITALS)), data.count(b"!"))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of whole texts; null and empty texts count zero throughout."""
    @F.pandas_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([count_text(t) for t in texts], columns=list(COUNTS), dtype="int64")
    return docs.select("doc_id", counted("text").alias("c")).select("doc_id", "c.*")


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for feature, sign, bound in rule:
        out &= x[feature] <= bound if sign == "<=" else x[feature] > bound
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the condition of most information gain until no good row is covered."""
    rule: Rule = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best, best_gain = None, 1e-9
        for feature, values in x.items():
            for bound in np.unique(np.quantile(values[inside], np.linspace(0.01, 0.99, 40))):
                under = inside & (values <= bound)
                p_under, n_under = int((under & bad).sum()), int((under & ~bad).sum())
                for sign, pp, nn in (("<=", p_under, n_under), (">", p - p_under, n - n_under)):
                    if pp:
                        gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p / (p + n)))
                        if gain > best_gain:
                            best, best_gain = (feature, sign, float(bound)), gain
        if best is None:
            break
        rule.append(best)
        inside &= _covers([best], x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4,
          precision: float = 0.9, seed: int = 1) -> list[Rule]:
    """An ordered list of rules for low quality; empty where nothing precise is found."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    for _ in range(max_rules):
        rows = np.flatnonzero(left)
        if not bad[rows].any():
            break
        growing = rng.random(len(rows)) < 2 / 3
        grow, prune = rows[growing], rows[~growing]
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], max_conditions)
        held = {f: v[prune] for f, v in x.items()}

        def worth(part: Rule, held=held, prune=prune) -> float:
            hit = _covers(part, held)
            p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            return (p - n) / (p + n) if p + n else -1.0
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def rules_sql(rules: list[Rule]) -> str:
    """The list as one SQL expression: true where a rule finds low quality."""
    cases = " ".join(
        "WHEN " + " AND ".join(f"({FEATURES[f]}) {sign} {bound!r}D" for f, sign, bound in rule) + " THEN true"
        for rule in rules)
    return f"CASE {cases} ELSE false END" if rules else "false"


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn_rules(counts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled ids, by a hash of the id, that pass the base rule."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.select("doc_id", "quality").distinct().orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(
        sample_rows)
    # an id may stand in many rows; its counts are reduced to one row before they travel
    rows = counts.where(~base_failed()).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in COUNTS])
    rows = rows.join(known, "doc_id").select("doc_id", "quality", *[F.expr(e).alias(f"__{f}") for f, e in FEATURES.items()])
    sample = rows.orderBy("doc_id", "quality").toPandas()
    if sample["quality"].nunique() < 2:
        return []
    return learn({f: sample[f"__{f}"].to_numpy(float) for f in FEATURES}, sample["quality"].to_numpy() == 0)


def judge_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the other counts.

    Null and empty texts have no words and fail the base rule; repeated rows give repeated results;
    an empty table gives no rows; without labels of both classes the base rule alone decides;
    further columns are ignored.
    """
    counts = store(text_counts(docs.select("doc_id", "text")), "counts")
    rules = learn_rules(counts, labels, sample_rows)
    return counts.select(
        "doc_id", *COUNTS[:5], base_failed().alias("base_failed"),
        (~base_failed() & ~F.expr(rules_sql(rules))).alias("kept"), *COUNTS[5:])
