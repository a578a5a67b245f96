"""Line dedup: prefix doubling over line-ID sequences finds repeated runs; later copies go.

A document is a sequence of its lines with a word. A line is deleted if it lies in a run of
consecutive lines with at least ``min_words`` words that also occurs earlier, in the order of
(doc_id, text name, copy, line); the first copy stays. Blank lines stay. Rows are named by their id and text,
so the table may be read again in other splits; of rows that repeat both, all but one are later copies whole.

Every such run is the union of its shortest qualifying runs: from a line forward, and from a line
backward, the fewest lines that reach ``min_words`` words. So the common prefixes of suffixes matter
only up to that length, and prefix doubling stops there: round k names the 2^k lines that begin at
each place by the pair of names of its halves, and any run of m lines by two overlapping names of
the largest 2^k <= m. Names are 128-bit digests instead of dense ranks; equal names group the
suffixes of one common-prefix interval, whose smallest place is the copy that stays. Rounds work on
each document's own array and need no shuffle; one shuffle of the names finds the intervals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.llm.common import free, identity, let, with_identity
from formatpulse.session import store

MIN_WORDS = 10
ID = ("__id_a", "__id_b")
_WORDS = r"[^\x20\x09-\x0D]+"


def run_names(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id_a, __id_b, doc_id, __start, __lines, __a, __b): shortest qualifying runs and their names."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    lined = F.transform(lines, lambda l, i: F.struct(
        i.alias("at"), F.regexp_count(l, F.lit(_WORDS)).alias("words"),
        F.xxhash64(F.lit(0), l).alias("a"), F.xxhash64(F.lit(1), l).alias("b")))
    levels = max(1, math.ceil(math.log2(max(2, min_words))))

    def reach(w: Column, step: int) -> Column:
        """Fewest lines from each place on, in the direction of step, with min_words words; 0 if none."""
        def walk(own: Column, i: Column) -> Column:
            def add(acc: Column, j: Column) -> Column:
                more = F.coalesce(F.when(i + j * step >= 0, F.get(w, i + j * step)), F.lit(0))
                go = acc["s"] < min_words
                return F.struct((acc["s"] + F.when(go, more).otherwise(0)).alias("s"),
                                (acc["m"] + F.when(go, 1).otherwise(0)).alias("m"))
            start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("m"))
            far = F.aggregate(F.sequence(F.lit(0), F.lit(min_words - 1)), start, add)
            return F.when(own >= min_words, 1).otherwise(
                let(far, lambda f: F.when(f["s"] >= min_words, f["m"]).otherwise(0)))
        return F.transform(w, walk)

    def doubled(names: list[Column], k: int, body) -> Column:
        """Calls body with the two lanes of names of rounds 0 to levels, each round computed once."""
        if k == levels:
            return body(names)

        def half(lane: Column) -> Column:
            return F.transform(lane, lambda x, i: F.xxhash64(x, F.get(lane, i + 2 ** k)))
        last = names[-1]
        return let(F.struct(half(last["a"]).alias("a"), half(last["b"]).alias("b")),
                   lambda level: doubled([*names, level], k + 1, body))

    def run(names: list[Column], start: Column, m: Column) -> Column:
        out = []
        for lane in "ab":
            name = F.get(names[0][lane], start)
            for k in range(1, levels + 1):
                whole = names[k][lane]
                pair = F.xxhash64(m, F.get(whole, start), F.get(whole, start + m - 2 ** k))
                name = F.when(m >= 2 ** k, pair).otherwise(name)
            out.append(name)
        return F.when(m > 0, F.struct(start.alias("start"), m.alias("len"), out[0].alias("a"), out[1].alias("b")))

    def runs(line: Column) -> Column:
        def both(names: list[Column]) -> Column:
            return F.array_distinct(F.concat(
                F.transform(reach(line["words"], 1), lambda m, i: run(names, i, m)),
                F.transform(reach(line["words"], -1), lambda m, i: run(names, i - m + 1, m))))
        first = F.struct(line["a"].alias("a"), line["b"].alias("b"))
        return let(first, lambda names: doubled([names], 0, both))

    def columns(kept: Column) -> Column:
        return F.struct(*[kept[f].alias(f) for f in ("at", "words", "a", "b")])

    kept = let(F.filter(lined, lambda x: x["words"] > 0), columns)
    found = let(kept, lambda line: F.transform(
        F.filter(runs(line), lambda x: x.isNotNull()), lambda x: F.struct(
            x["start"].alias("start"), F.slice(line["at"], x["start"] + 1, x["len"]).alias("lines"),
            x["a"].alias("a"), x["b"].alias("b"))))
    named = [c.alias(k) for c, k in zip(identity(F.col("doc_id"), F.col("text")), ID, strict=True)]
    one = docs.select(*named, "doc_id", F.explode(found).alias("__run"))
    # places count lines with a word; the deleted lines are named by their place in the text
    return one.select(*ID, "doc_id", F.col("__run.start").alias("__start"), F.col("__run.lines").alias("__lines"),
                      F.col("__run.a").alias("__a"), F.col("__run.b").alias("__b"))


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id_a, __id_b, __gone): the sorted places of the lines that go, for rows that lose any as first of their kind."""
    runs = run_names(docs, min_words)
    place = F.struct("doc_id", *ID, "__start")
    first = runs.groupBy("__a", "__b").agg(F.min(place).alias("__first"), F.count("*").alias("__n"))
    later = runs.join(first.where("__n > 1").drop("__n"), ["__a", "__b"]).where(place > F.col("__first"))
    # a row's runs are as many as its lines at most twice; each has min_words lines at most
    return later.groupBy(*ID).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("__lines")))).alias("__gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of later copies, ``n_chars`` (if there) set anew, and the columns
    n_lines, n_removed, n_runs (maximal runs of removed lines).

    Null texts stay null, empty ones empty, both with no lines of words; repeated rows count as later copies
    of the first; a table without rows gives none; further columns pass through, but n_lines,
    n_removed and n_runs are replaced.
    """
    rows, own, copy = with_identity(docs)
    gone_name, = free(rows, "__gone")
    gone = store(deleted_lines(docs, min_words), "lines").select(
        *[F.col(x).alias(y) for x, y in zip(ID, own, strict=True)], F.col("__gone").alias(gone_name))
    # text and places meet by shuffle at every size: both grow with the corpus
    both = rows.join(gone.hint("shuffle_hash"), list(own), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    # a repeated row is one run from its first line with a word to its last
    words = F.transform(lines, lambda l: F.regexp_count(l, F.lit(_WORDS)))
    whole = let(words, lambda w: F.when(
        F.aggregate(w, F.lit(0), lambda x, y: x + y) >= min_words, F.filter(every, lambda i: F.get(w, i) > 0)))
    both = both.withColumn(gone_name, F.when(F.col(copy), whole).otherwise(F.col(gone_name)))
    kept = F.array_join(F.transform(F.array_except(every, F.col(gone_name)), lambda i: F.get(lines, i)), "\n")
    starts = F.filter(gone_name, lambda x, i: (i == 0) | (F.get(gone_name, F.greatest(i - 1, F.lit(0))) < x - 1))
    both = both.withColumns({
        "text": F.when(F.col(gone_name).isNull(), F.col("text")).otherwise(kept),
        "n_lines": F.size(lines).cast("long"),
        "n_removed": F.coalesce(F.size(gone_name), F.lit(0)).cast("long"),
        "n_runs": F.coalesce(F.size(starts), F.lit(0)).cast("long")})
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                               .otherwise(F.col("n_chars")))
    added = [c for c in ("n_lines", "n_removed", "n_runs") if c not in docs.columns]
    return both.select(*docs.columns, *added)
