"""Near-duplicate groups by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number, so that
all are distinct. A sketch has ``SKETCHES`` entries: each takes the ``TUPLE`` shingles of smallest
hash under its own seed and keeps them in text order. Equal entries therefore favour texts with the
same shingles in the same order. Texts that share an entry are candidates.

Candidates are aligned: as labelled shingles are distinct, the best alignment is the longest rising
run of matching places, within the band of shifts that the threshold allows. Its similarity is
matches / (all shingles - matches), an ordered Jaccard; 0.8 or more links two texts.

Groups are the connected components of links. A bucket of equal entries is not expanded into pairs:
its members meet one pivot at a time, the member whose entries stand in the largest buckets first, as
the centre of a group shares more entries than its edge. In buckets that still hold several components
after ``rounds`` pivots, the pairs across components are tried, in blocks of bounded size within tasks.
All pairs first pass a filter on lengths and on one-permutation MinHash signatures that leaves 0.8 some
four standard errors (six where texts are short); those left are aligned. Exact copies count once throughout.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.llm.common import KEY, identity, small, text_key, with_identity
from formatpulse.operators.components import connected_components
from formatpulse.session import store

SHINGLE = 5
SKETCHES = 12
TUPLE = 3
BINS = 64
ROUNDS = 3
#: Texts of a block in the exact rest.
BLOCK = 512

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def labelled_shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """64-bit names of the n-word shingles in text order, no two equal. A text of fewer words is one
    shingle; one without words has none. Linear in the text but for one sort."""
    if not text:
        return np.zeros(0, np.uint64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int((end - begin).max()), 0xD6E8FEB86659FD93, np.uint64))
    lengths = end - begin
    spot = np.flatnonzero(inside) - np.repeat(begin, lengths)
    starts = np.cumsum(lengths) - lengths
    words = _mix(np.add.reduceat((data[inside].astype(np.uint64) + _U(1)) * powers[spot], starts))
    width = min(n, len(words))
    names = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        names = _mix(names * _U(0x9E3779B97F4A7C15) + words[k: len(words) - width + 1 + k])
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if not fresh.all():
        place = np.arange(len(ranked))
        number = place - np.maximum.accumulate(np.where(fresh, place, 0))
        label = np.empty(len(names), np.uint64)
        label[order] = number.astype(np.uint64)
        names = np.where(label > 0, _mix(names + label * _U(0xA24BAED4963EE407)), names)
    return names


def sketch(names: np.ndarray, entries: int = SKETCHES, size: int = TUPLE) -> list[int]:
    """The order-minhash entries, each a signed 64-bit name of its number and ordered tuple."""
    if not len(names):
        return []
    seeds = _mix(np.arange(1, entries + 1, dtype=np.uint64))
    lowest = np.tile(np.arange(len(names)), (entries, 1))
    if len(names) > size:
        lowest = np.stack([np.argpartition((names ^ seed) * _U(0x81DADEF4BC2DD44D), size - 1)[:size] for seed in seeds])
        lowest.sort(axis=1)
    value = seeds
    for column in lowest.T:
        value = _mix(value * _U(0x9E3779B97F4A7C15) + names[column])
    return value.view(np.int64).tolist()


def signature(names: np.ndarray, bins: int = BINS) -> list[int]:
    """One-permutation MinHash: the least value of each bin, cut to 15 bits; -1 where empty."""
    h = np.sort(_mix(names + _U(77)))
    which = (h % _U(bins)).astype(np.int64)
    out = np.full(bins, -1, np.int64)
    at, first = np.unique(which, return_index=True)
    out[at] = (h[first] >> _U(6) & _U(0x7FFF)).astype(np.int64)
    return out.tolist()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = 0.8) -> float:
    """Ordered Jaccard by banded alignment; a value below ``threshold`` is an upper bound only."""
    both = len(a) + len(b)
    if not both:
        return 0.0
    best = lambda m: m / (both - m)
    if best(min(len(a), len(b))) < threshold:
        return best(min(len(a), len(b)))
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    hit = np.flatnonzero(b[order][at] == a)
    there = order[at[hit]]
    band = both * (1 - threshold) / (1 + threshold)  # more shifts than that lose too many shingles
    there = there[np.abs(there - hit) <= band]
    if best(len(there)) < threshold or np.all(there[1:] > there[:-1]):
        return best(len(there))
    tails: list[int] = []  # least end of a rising run of each length
    for t in there.tolist():
        i = bisect_left(tails, t)
        tails[i:i + 1] = [t]
    return best(len(tails))


def many_shingles(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(names, sizes): :func:`labelled_shingles` of every text, one after the other, and how many each has."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)]  # a byte of no word between texts
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    inside = _IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edges = np.concatenate(([0], edges))
    begin, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    owner = np.searchsorted(ends, begin, "right")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    powers = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, np.uint64))
    spot = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = _mix(np.add.reduceat((data[inside].astype(np.uint64) + _U(1)) * powers[spot], np.cumsum(lengths) - lengths))
    names, short = words.copy(), {}
    for k in range(1, n):
        few = np.flatnonzero(counts == k)  # texts of fewer words are one shingle
        short[k] = (few, names[first[few]])
        names[: len(words) - k] = _mix(names[: len(words) - k] * _U(0x9E3779B97F4A7C15) + words[k:])
    place = np.arange(len(words)) - np.repeat(first, counts)
    whole = place + n <= np.repeat(counts, counts)
    for few, values in short.values():
        whole[first[few]] = True
        names[first[few]] = values
    names, owner = names[whole], owner[whole]
    sizes = np.bincount(owner, minlength=len(texts))
    # the same name again in a text gets its number mixed in
    own = _mix(names ^ (owner.astype(np.uint64) * _U(0xA24BAED4963EE407)))
    ranked = np.sort(own)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        at = np.flatnonzero(np.isin(own, twice))
        order = at[np.argsort(own[at], kind="stable")]
        fresh = np.concatenate(([True], own[order][1:] != own[order][:-1]))
        run = np.arange(len(order))
        number = run - np.maximum.accumulate(np.where(fresh, run, 0))
        again = order[number > 0]
        names[again] = _mix(names[again] + number[number > 0].astype(np.uint64) * _U(0xA24BAED4963EE407))
    return names, sizes


def many_sketches(names: np.ndarray, sizes: np.ndarray, entries: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """:func:`sketch` of every text, as a row each; rows of texts without a shingle are zero.

    The least values of a text are sought among those below a bound that some sixteen of them pass; texts in
    which too few do so for a seed take the plain way."""
    out = np.zeros((len(sizes), entries), np.int64)
    first = np.cumsum(sizes) - sizes
    plain = (sizes > 0) & (sizes < 32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bound = np.full(len(sizes), np.iinfo(np.uint64).max, np.uint64)
    large = ~plain & (sizes > 0)
    bound[large] = (2.0**64 / sizes[large] * max(16, 6 * size)).astype(np.uint64) if large.any() else 0
    bound = np.repeat(bound, sizes)
    if large.any():
        for e, seed in enumerate(_mix(np.arange(1, entries + 1, dtype=np.uint64))):
            value = (names ^ seed) * _U(0x81DADEF4BC2DD44D)
            at = np.flatnonzero(value < bound)
            at = at[np.lexsort((value[at], owner[at]))]
            group = owner[at]
            rank = np.arange(len(at)) - np.searchsorted(group, group)
            found = np.bincount(group, minlength=len(sizes))
            plain |= large & (found < size)
            keep = (rank < size) & ((found >= size) & large)[group]
            lowest = np.sort(at[keep].reshape(-1, size), axis=1)
            name = np.full(len(lowest), seed)
            for column in lowest.T:
                name = _mix(name * _U(0x9E3779B97F4A7C15) + names[column])
            out[owner[lowest[:, 0]], e] = name.view(np.int64)
    for t in np.flatnonzero(plain):
        out[t] = sketch(names[first[t]: first[t] + sizes[t]], entries, size)
    return out


def many_signatures(names: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """:func:`signature` of every text, as a row each."""
    h = _mix(names + _U(77))
    least = np.full(len(sizes) * bins, np.iinfo(np.uint64).max, np.uint64)
    at = np.repeat(np.arange(len(sizes)), sizes) * bins + (h % _U(bins)).astype(np.int64)
    np.minimum.at(least, at, h)
    out = (least >> _U(6) & _U(0x7FFF)).astype(np.int16)
    seen = np.zeros(len(least), bool)
    seen[at] = True
    return np.where(seen, out, -1).astype(np.int16).reshape(-1, bins)


def portions(texts: list[str | None], characters: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """[from, to) of runs of texts with about so many characters, or of one longer text."""
    lo = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= characters:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def sketches(docs: DataFrame, n: int = SHINGLE, entries: int = SKETCHES, size: int = TUPLE) -> DataFrame:
    """One row per distinct text with a word: key, n (shingles), entries, bins."""
    @F.pandas_udf("n int, entries array<bigint>, bins array<smallint>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, parts = batch.tolist(), []
            for lo, hi in portions(texts):
                names, sizes = many_shingles(texts[lo:hi], n)
                parts.append((sizes, many_sketches(names, sizes, entries, size), many_signatures(names, sizes)))
            if not parts:
                parts = [(np.zeros(0, np.int64), np.zeros((0, entries), np.int64), np.zeros((0, BINS), np.int16))]
            counts, found, bins = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pd.DataFrame({"n": counts.astype(np.int32), "entries": list(found), "bins": list(bins)})
    rows = docs.select(*text_key(F.col("text")), sketched("text").alias("s")).where("s.n > 0")
    return rows.groupBy(*KEY).agg(F.first("s").alias("s")).select(*KEY, "s.*")


#: Standard errors that a signature's estimate may lie below the threshold: for texts of SURE shingles or more, and fewer.
ERRORS, FEW_ERRORS, SURE = 4.0, 6.0, 200


def _likely(threshold: float) -> Column:
    """Whether the lengths and signatures of a pair (_a, _b) leave the threshold possible."""
    shorter, longer = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    def count(test) -> Column:
        return F.size(F.filter(F.zip_with("bins_a", "bins_b", test), lambda x: x))
    same = count(lambda x, y: (x == y) & (x >= 0))
    used = count(lambda x, y: (x >= 0) | (y >= 0))
    errors = F.when(shorter < SURE, FEW_ERRORS).otherwise(ERRORS) * (threshold * (1 - threshold)) ** 0.5
    return (shorter >= threshold * longer) & (same >= threshold * used - errors * F.sqrt(used))


def _rivals(entries: np.ndarray, bins: np.ndarray, sizes: np.ndarray, parts: np.ndarray, owner: np.ndarray | None,
            bucket: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(a, bs): later rows of a bucket that row ``a`` may be linked to: of another component, with ``bucket`` as the first
    one they share, and lengths and signatures that leave the threshold possible. With ``owner``, of the other block."""
    for a in range(len(sizes) - 1):
        longer, shorter = np.maximum(sizes[a + 1:], sizes[a]), np.minimum(sizes[a + 1:], sizes[a])
        able = (shorter >= threshold * longer) & (parts[a + 1:] != parts[a])
        if owner is not None:
            able &= owner[a + 1:] != owner[a]
        at = np.flatnonzero(able) + a + 1
        if not len(at):
            continue
        at = at[entries[a][(entries[at] == entries[a]).argmax(1)] == bucket]
        same = ((bins[at] == bins[a]) & (bins[a] >= 0)).sum(1)
        used = ((bins[at] >= 0) | (bins[a] >= 0)).sum(1)
        errors = np.where(np.minimum(sizes[at], sizes[a]) < SURE, FEW_ERRORS, ERRORS) * (threshold * (1 - threshold)) ** 0.5
        at = at[same >= threshold * used - errors * np.sqrt(used)]
        if len(at):
            yield a, at


def _ids(side: str) -> list[str]:
    return [f"{k}_{side}" for k in KEY]


def _side(df: DataFrame, side: str, *names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in (*KEY, *names)])


def linked(pairs: DataFrame, marks: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """The pairs (keys _a, _b) that alignment confirms. ``marks`` has n and bins of each text."""
    @F.pandas_udf("boolean")
    def close(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            known: dict[str, np.ndarray] = {}  # a pivot stands in many rows of a batch
            out = []
            for a, b in zip(left, right, strict=True):
                if b not in known:
                    known = {b: labelled_shingles(b, n)}
                out.append(similarity(labelled_shingles(a, n), known[b], threshold) >= threshold)
            yield pd.Series(out, dtype=bool)
    for side in "ab":
        pairs = pairs.join(_side(marks, side, "n", "bins"), _ids(side))
    pairs = pairs.where(_likely(threshold)).select(*_ids("a"), *_ids("b"))
    for side in "ab":
        pairs = pairs.join(_side(texts, side, "text"), _ids(side))
    return pairs.where(close("text_a", "text_b")).select(*_ids("a"), *_ids("b"))


def _labels(links: DataFrame) -> DataFrame:
    """(key, part): the component of each text that has links; part is a struct of key columns."""
    name = lambda side: F.struct(*[F.col(c).alias(k) for c, k in zip(_ids(side), KEY, strict=True)])
    found = connected_components(links.select(name("a").alias("a"), name("b").alias("b")))
    return found.select("id.*", F.col("component").alias("part"))


def _meet(open_buckets: DataFrame, texts: DataFrame, threshold: float, n: int, block: int) -> DataFrame:
    """Links (keys _a, _b) that join the components of each bucket wherever any pair across them does.

    Blocks of a bucket meet in pairs; a pair of texts is tried in the first bucket it shares. A first pass over narrow
    rows keeps the texts that have a rival left by lengths and signatures, a row each; only these get their
    texts, are aligned, and give spanning links, never all pairs.
    """
    sized = open_buckets.join(open_buckets.groupBy("bucket").agg(
        F.ceil(F.count("*") / block).cast("int").alias("__blocks")), "bucket")
    own = F.pmod(F.xxhash64(F.lit(5), *KEY), F.col("__blocks")).cast("int")
    rows = sized.withColumn("__own", own).withColumn(
        "__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    fields = ("bucket", "__i", "__j", "__own", *KEY, "entries", "bins", "n", "part")
    rows = rows.select("bucket", F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"),
                       "__own", *KEY, "entries", "bins", "n", F.xxhash64("part").alias("part"))

    def rivals(rows: pd.DataFrame):
        one = rows["__i"].iloc[0] == rows["__j"].iloc[0]
        return _rivals(np.stack(rows["entries"].to_numpy()), np.stack(rows["bins"].to_numpy()),
                       rows["n"].to_numpy().astype(np.int64), rows["part"].to_numpy(),
                       None if one else rows["__own"].to_numpy(), rows["bucket"].iloc[0], threshold)

    def sift(rows: pd.DataFrame) -> pd.DataFrame:
        kept = np.zeros(len(rows), bool)
        for a, at in rivals(rows):
            kept[a] = True
            kept[at] = True
        return rows[kept]

    def align(rows: pd.DataFrame) -> pd.DataFrame:
        keys, texts_here = rows[list(KEY)].to_numpy(), rows["text"].to_numpy()
        label, names, out = rows["part"].to_numpy().copy(), {}, []

        def shingles(i: int) -> np.ndarray:
            if i not in names:
                names[i] = labelled_shingles(texts_here[i], n)
            return names[i]
        for a, at in rivals(rows):
            for b in at.tolist():
                if label[a] != label[b] and similarity(shingles(a), shingles(b), threshold) >= threshold:
                    label[label == label[b]] = label[a]
                    out.append((*keys[a], *keys[b]))
        return pd.DataFrame(out, columns=[*_ids("a"), *_ids("b")])
    kinds = dict(rows.dtypes)
    sifted = rows.groupBy("bucket", "__i", "__j").applyInPandas(sift, ", ".join(f"{c} {kinds[c]}" for c in fields))
    return store(sifted, "rivals").join(texts, list(KEY)).groupBy("bucket", "__i", "__j").applyInPandas(
        align, ", ".join(f"{c} bigint" for c in (*_ids("a"), *_ids("b"))))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = SHINGLE, entries: int = SKETCHES,
                    size: int = TUPLE, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(key, __class): for every distinct text that shares a group with another, the group's name."""
    marks = store(sketches(docs, n, entries, size), "sketches")
    one = marks.select(*KEY, F.explode("entries").alias("bucket"))
    member = F.struct(*KEY)
    shared = one.groupBy("bucket").agg(F.count("*").alias("__n")).where("__n > 1")
    buckets = one.join(shared, "bucket")
    degree = store(buckets.groupBy(*KEY).agg(F.sum("__n").alias("degree")), "degree")
    buckets = store(buckets.drop("__n").join(degree, list(KEY)), "buckets")
    texts = docs.select(*text_key(F.col("text")), "text").join(small(degree.select(*KEY)), list(KEY), "left_semi")
    texts = store(texts.groupBy(*KEY).agg(F.first("text").alias("text")), "texts")
    central = Window.partitionBy("bucket").orderBy(F.desc("degree"), *KEY)
    pivots = store(buckets.withColumn("turn", F.row_number().over(central)).where(F.col("turn") <= rounds).select(
        "bucket", "turn", F.struct(*KEY).alias("pivot")), "pivots")
    links, parts = None, None
    for turn in range(1, rounds + 2):
        labelled = buckets.withColumn("part", member)
        if parts is not None:
            labelled = buckets.join(parts, list(KEY), "left").withColumn("part", F.coalesce("part", member))
        apart = labelled.groupBy("bucket").agg(F.min("part").alias("__lo"), F.max("part").alias("__hi"))
        labelled = store(labelled.join(apart.where("__lo < __hi").select("bucket"), "bucket"), "open")
        if turn <= rounds:
            named = labelled.select("bucket", member.alias("pivot"), F.col("part").alias("pivot_part"))
            here = pivots.where(F.col("turn") == turn).join(named, ["bucket", "pivot"])
            pairs = labelled.join(here, "bucket").where(F.col("part") != F.col("pivot_part")).select(
                *[F.col(k).alias(f"{k}_a") for k in KEY], *[F.col(f"pivot.{k}").alias(f"{k}_b") for k in KEY])
            new = linked(store(pairs.distinct(), "pairs"), marks.select(*KEY, "n", "bins"), texts, threshold, n)
        else:
            new = _meet(labelled.join(marks, list(KEY)), texts, threshold, n, block)
        new = store(new, "links")
        links = new if links is None else links.union(new)
        parts = store(_labels(links), "parts")
    return parts.select(*KEY, F.col("part").alias("__class"))


def classes(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its group), class_size.

    Texts without a word (null and empty among them) are alone, each its own class; equal texts
    share a class; repeated rows count as members; an empty table gives no rows; further columns
    are ignored.
    """
    keyed = docs.select("doc_id", *text_key(F.col("text")), _wordless(F.col("text")).alias("__none"))
    own = F.struct(*KEY)
    rows = keyed.where("NOT __none").join(near_duplicates(docs.select("text"), **how), list(KEY), "left")
    rows = rows.withColumn("__class", F.coalesce("__class", own)).drop("__none")
    # copies are reduced before the groups' sizes are joined back to every row
    sizes = rows.groupBy("__class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = rows.join(sizes, "__class").select("doc_id", "class_id", "class_size")
    alone = keyed.where("__none").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone)


def _wordless(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class, the one of least doc_id (null first), then of least text name. Rows
    are named by their id and text, so the table may be read again in other splits.

    Texts without a word (null and empty among them) all stay; of repeated rows one stays; an empty table gives no rows;
    columns, whatever their names, stay as they were.
    """
    rows, own, copy = with_identity(docs)
    a, b = own
    keyed = docs.where(~_wordless(F.col("text"))).select(
        "doc_id", *text_key(F.col("text")), *[c.alias(k) for c, k in zip(identity(F.col("doc_id"), F.col("text")), own, strict=True)])
    named = keyed.join(near_duplicates(docs.select("text"), **how), list(KEY), "left").withColumn(
        "__class", F.coalesce("__class", F.struct(*KEY)))
    place = F.struct("doc_id", a, b)
    first = named.groupBy("__class").agg(F.min(place).alias("__first"), F.count("*").alias("__rows")).where("__rows > 1")
    gone = store(named.join(first, "__class").where(place > F.col("__first")).select(a, b).distinct(), "copies")
    kept = rows.where(~F.col(copy) | _wordless(F.col("text"))).join(small(gone), [a, b], "left_anti")
    return kept.select(*docs.columns)
