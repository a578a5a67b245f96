"""Removal of long repeated substrings after prefix-free parsing.

Texts are bytes. A byte goes if a string of ``length`` bytes covers it that also starts elsewhere.

Parsing: a rolling hash over ``TRIGGER`` bytes picks triggers, the least hash of every ``GAP``
consecutive places (the first of equal ones), so phrases end where content says and none is longer
than GAP. Each string of ``length`` bytes belongs to the trigger of its first GAP places; equal
strings therefore have equal triggers at equal offsets. A phrase's strings and what they need of the
phrases that follow are its context, up to GAP - 1 + length bytes.

Corpus order: the suffixes of the corpus matter only up to ``length`` bytes, and only which of them
are equal. So dictionary and parse are combined as classes rather than as one sorted array:

1. phrases whose next bytes (the part all their strings share) occur once in the corpus are dropped:
   none of their strings repeats;
2. contexts that occur twice or more repeat as a whole;
3. the distinct contexts left, the dictionary, are cut into blocks of ``BLOCK`` suffixes, which share
   a core and differ by the few bytes on its sides; blocks with equal cores and sides repeat as a
   whole, and where equal cores have different sides, each suffix is compared by its bytes.

A full suffix array would hold one entry per byte of the corpus; here the tables hold one row per
phrase, then far fewer. Names are two independent 64-bit hashes each. Of texts that stand in several
rows only the first is parsed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.llm.common import KEY, small, text_key
from formatpulse.session import store

LENGTH = 400
GAP = 288
TRIGGER = 16
BLOCK = 16
#: Places of a text that are hashed at a time.
SLICE = 1 << 18

_U = np.uint64
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64)


def triggers(data: np.ndarray, length: int = LENGTH, gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, trigger): the strings that start in [first, last] belong to ``trigger``."""
    starts = len(data) - length + 1
    parts = []
    for lo in range(0, max(starts, 0), SLICE):
        hi = min(lo + SLICE, starts)
        h = _TABLE[data[lo: hi + gap + TRIGGER - 2]]
        for step, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xBF58476D1CE4E5B9), (4, 0x94D049BB133111EB), (8, 0xD6E8FEB86659FD93)):
            h = h[:-step] * _U(odd) + h[step:]
        h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
        least = (h >> _U(20) << _U(20)) | np.arange(len(h), dtype=np.uint64)  # ties: the first place
        width = 1
        while width < gap:
            step = min(width, gap - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = (least & _U((1 << 20) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(at)])) - 1
        parts.append((first + lo, last + lo, at[first] + lo))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def phrases(texts: DataFrame, length: int = LENGTH, gap: int = GAP) -> DataFrame:
    """(key, at, ahead, context) of every phrase of ``texts`` (key, data). ``at`` packs the trigger
    with its distances to the first and last string, of 10 bits each."""
    ahead = length - gap + 1

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            rows, places, names = [], [], ([], [])
            for i, value in enumerate(batch.column(2)):
                data = value.as_buffer()
                if data is None or data.size < length:
                    continue
                first, last, at = triggers(np.frombuffer(data, np.uint8), length, gap)
                view = memoryview(data)
                names[0].extend([xxhash.xxh3_64_intdigest(view[t:t + ahead]) for t in at.tolist()])
                names[1].extend([xxhash.xxh3_64_intdigest(view[a:b + length], seed=t - a + 1)
                                 for a, b, t in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)])
                rows.append(np.full(len(at), i))
                places.append(at << 20 | (at - first) << 10 | (at - last))
            if rows:
                which = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([
                    *[pa.array(k[which]) for k in keys], pa.array(np.concatenate(places)),
                    pa.array(_signed(names[0])), pa.array(_signed(names[1]))],
                    names=[*KEY, "at", "ahead", "context"])
    return texts.select(*KEY, "data").mapInArrow(
        parse, ", ".join(f"{c} bigint" for c in (*KEY, "at", "ahead", "context")))


def _unpack(at: int) -> tuple[int, int, int]:
    trigger = at >> 20
    return trigger - (at >> 10 & 1023), trigger - (at & 1023), trigger


def _first(at: Column) -> Column:
    return F.shiftright(at, 20) - F.shiftright(at, 10).bitwiseAND(F.lit(1023))


def _last(at: Column) -> Column:
    return F.shiftright(at, 20) - at.bitwiseAND(F.lit(1023))


def _suffix_blocks(found: DataFrame, length: int, block: int) -> DataFrame:
    """(core, ahead, context, from, before, after): for each context (data, contexts), its strings in
    blocks of ``block`` offsets to the trigger. All strings of a block hold its core; ``before`` and
    ``after`` are the further bytes of the block; ``from`` counts strings of the context before it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = tuple([] for _ in range(6))
            for value, contexts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(value.as_buffer())
                for c in contexts:
                    first, last, t = _unpack(c["at"])
                    for k in range((t - last) // block, (t - first) // block + 1):
                        core = t - k * block
                        end = core - block + 1 + length
                        lo, hi = max(first, core - block + 1), min(last, core)
                        row = (xxhash.xxh3_64_intdigest(view[core:end], seed=k + 1), c["ahead"], c["context"],
                               lo - first, bytes(view[lo:core]), bytes(view[end:hi + length]))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(out[0])), *[pa.array(x, kind) for x, kind in zip(out[1:], kinds, strict=True)]],
                names=["core", "ahead", "context", "from", "before", "after"])
    return found.select("data", "contexts").mapInArrow(
        cut, "core bigint, ahead bigint, context bigint, from int, before binary, after binary")


def _dictionary_offsets(blocks: DataFrame, block: int) -> DataFrame:
    """(ahead, context, lo, hi): strings of a context, counted from its first, that another has too."""
    sides = F.xxhash64("before", "after")
    cores = blocks.groupBy("core").agg(F.count("*").alias("n"), (F.min(sides) < F.max(sides)).alias("mixed"))
    shared = blocks.join(cores.where("n > 1").drop("n"), "core")
    kinds = shared.groupBy("core", "before", "after").agg(
        F.count("*").alias("n"), F.first("mixed").alias("mixed"))
    size = F.octet_length("before")  # a block's first string begins that far before its core
    count = F.octet_length("before") + F.octet_length("after") - (block - 1) + 1
    alike = kinds.where("n > 1").select("core", "before", "after")
    whole = shared.join(alike, ["core", "before", "after"]).select(
        "ahead", "context", F.col("from").alias("lo"), (F.col("from") + count - 1).alias("hi"))
    # strings of the blocks that differ, named by core and the bytes on its sides
    step = F.explode(F.sequence(F.lit(0), count - 1)).alias("k")
    single = kinds.where("mixed").select("core", "before", "after", size.alias("size"), step)
    string = [F.expr("substring(before, k + 1, size - k)").alias("left"),
              F.expr(f"substring(after, 1, {block - 1} - (size - k))").alias("right")]
    single = single.select("core", "before", "after", "k", *string)
    twice = single.groupBy("core", "left", "right").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hit = single.join(twice, ["core", "left", "right"]).select("core", "before", "after", "k")
    part = shared.where("mixed").join(hit, ["core", "before", "after"]).select(
        "ahead", "context", (F.col("from") + F.col("k")).alias("lo"), (F.col("from") + F.col("k")).alias("hi"))
    return whole.unionByName(part)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, data). Texts are named by what they hold, not by their place in the table."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *text_key(text), text.cast("binary").alias("data"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gap: int = GAP, block: int = BLOCK) -> DataFrame:
    """(key, spans): the [begin, end) of ``texts`` (key, data) that repeated strings cover, as they
    are found; they may overlap. No two texts are equal."""
    parsed = phrases(texts, length, gap)
    # stored apart from the join: the planner then sees its size, and may split the rows of a frequent key
    twice = store(parsed.groupBy("ahead").agg(F.count("*").alias("__n")).where("__n > 1").select("ahead"), "twice")
    active = store(parsed.join(small(twice), "ahead"), "active")
    contexts = active.groupBy("ahead", "context").agg(
        F.count("*").alias("n"), F.min(F.struct(*KEY, "at")).alias("place"))
    contexts = store(contexts, "contexts")
    mixed = contexts.groupBy("ahead").agg(F.count("*").alias("__n")).where("__n > 1").select("ahead")
    # the dictionary: one place of each context that shares its next bytes with another
    wanted = contexts.join(mixed, "ahead").groupBy(*[F.col(f"place.{k}").alias(k) for k in KEY]).agg(
        F.collect_list(F.struct(F.col("place.at").alias("at"), "ahead", "context")).alias("contexts"))
    wanted = store(wanted, "wanted")
    chosen = texts.join(small(wanted.select(*KEY)), list(KEY), "left_semi").select(*KEY, "data")
    blocks = store(_suffix_blocks(chosen.join(wanted, list(KEY)), length, block), "blocks")
    found = _dictionary_offsets(blocks, block)
    first = _first(F.col("place.at"))
    single = contexts.where("n = 1").join(found, ["ahead", "context"]).select(
        *[F.col(f"place.{k}").alias(k) for k in KEY], (first + F.col("lo")).alias("begin"), (first + F.col("hi") + length).alias("end"))
    whole = active.join(contexts.where("n > 1").select("ahead", "context"), ["ahead", "context"]).select(
        *KEY, _first(F.col("at")).alias("begin"), (_last(F.col("at")) + length).alias("end"))
    return whole.unionByName(single).groupBy(*KEY).agg(  # bounded by the text's bytes
        F.collect_list(F.struct("begin", "end")).alias("spans"))


def cut_spans(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_data: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_data``
    kept (binary, which may cut characters).

    Null and empty texts, and texts shorter than ``length``, lose nothing. A text that stands in
    several rows goes whole from all of them, if it is long enough. Further columns are ignored.
    """
    texts = keyed_texts(docs)
    size = F.octet_length("data").cast("long")
    copies = small(store(texts.groupBy(*KEY).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), "copies"))
    # one text of each group of copies; map tasks keep one each before the shuffle
    single = texts.join(copies, list(KEY), "left_anti").select(*KEY, "data")
    once = single.unionByName(texts.join(copies, list(KEY), "left_semi").groupBy(*KEY).agg(F.first("data").alias("data")))
    spans = store(repeated_spans(once, length), "spans")
    known = texts.join(copies.withColumn("__copied", F.lit(True)), list(KEY), "left").join(
        small(spans.select(*KEY, F.lit(True).alias("__part"))), list(KEY), "left")
    copied = F.col("__copied").isNotNull()
    gone = copied & (size >= length)
    kept = F.when(gone, F.lit(b"")).otherwise(F.col("data"))
    plain = known.where(copied | F.col("__part").isNull()).select(
        "doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(0).alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"),
        *([kept.alias("kept")] if keep_data else []))

    @F.pandas_udf("n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    def removed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for data, begins, ends in batches:
            rows = []
            for d, b, e in zip(data, begins, ends, strict=True):
                n, runs, left = cut_spans(d, np.asarray(b), np.asarray(e))
                rows.append((n, runs, hashlib.sha256(left).hexdigest(), left if keep_data else b""))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept"])
    part = known.where(~copied & F.col("__part")).select("doc_id", *KEY, "data").join(spans, list(KEY))
    part = part.select("doc_id", size.alias("n_bytes"), removed("data", "spans.begin", "spans.end").alias("r"))
    names = ["n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_data else [])]
    return plain.unionByName(part.select("doc_id", "n_bytes", *[f"r.{c}" for c in names]))
