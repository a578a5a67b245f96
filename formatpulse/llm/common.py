"""Shared pieces: reading tables, row identities, the word pattern of shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formatpulse.session import store

#: Upper and lower case A-Z, for case folding that touches nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of shingles: letters and digits of ASCII, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The two internal columns that identify a text (128 bits).
KEY = ("__key_a", "__key_b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """Lower-case A-Z only; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def identity(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that stand for (id, text), nulls told from values. They follow from the row alone, so
    a second reading of a table gives every row the same name, however its files are split."""
    return [F.xxhash64(F.lit(i), doc_id.isNull(), doc_id, text.isNull(), text) for i in range(2)]


def with_identity(docs: DataFrame) -> tuple[DataFrame, tuple[str, str], str]:
    """``docs`` with two columns of :func:`identity` and a flag on rows that repeat another's (id, text); one row of
    each keeps it unset. Returns their names too. Repeated rows are stored once with a number, others pass."""
    a, b, copy, n = free(docs, "__id_a", "__id_b", "__copy", "__n")
    rows = docs.withColumns(dict(zip((a, b), identity(F.col("doc_id"), F.col("text")), strict=True)))
    twice = small(store(rows.groupBy(a, b).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n), "repeated"))
    many = store(rows.join(twice, [a, b], "left_semi").withColumn(n, F.monotonically_increasing_id()), "repeats")
    first = many.groupBy(a, b).agg(F.min(n).alias(copy))
    marked = many.join(first, [a, b]).withColumn(copy, F.col(n) > F.col(copy)).select(*rows.columns, copy)
    single = rows.join(twice, [a, b], "left_anti").select(*rows.columns, F.lit(False).alias(copy))
    return single.unionByName(marked), (a, b), copy


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: equal texts get equal results, so operators whose
    decision depends on the text alone key their work by it and join back; repeated rows and
    null ids need no row number."""
    return [F.xxhash64(F.lit(i), text).alias(name) for i, name in enumerate(KEY)]

#: Rows up to which a side keyed by two longs is broadcast (some 30 MB); beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay below ``rows``; call it on stored data."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row. Inside a lambda, Spark evaluates an
    expression anew for each element unless it is a variable of an enclosing lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(
        F.array().cast("array<int>"))
