"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Sets are the distinct five-word shingles of a text. Long documents are cut into blocks of at most
``BLOCK`` shingles, so that a short item is not lost in a set thousands of times its size; every
shingle belongs to one block. A block's sketch is its bottom-k MinHash values, an item's its
``ITEM_VALUES`` smallest. Items are partitioned by size (powers of two): against a partition whose
smallest set has q shingles, a block of x shingles shows the k = ceil(DEPTH * x / q) smallest of
its values. The smallest value of a contained item lies beyond that with probability about
exp(-DEPTH), so a block that holds the item shares a value with it in all but some exp(-DEPTH) of
cases. A document that shares a sketch value with an item is a candidate, and the exact share of
the item's shingles in the whole document decides.

An item of fewer than five words is one shingle, its words; documents that hold those words in a row are
its candidates, found by an equality join of word runs of the lengths that such items have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.llm.common import KEY, WORD, fold, let, shingle_starts, small, text_key, words_of
from formatpulse.session import store

SHINGLE = 5
BLOCK = 128
ITEM_VALUES = 8
DEPTH = 12.0


def _shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of the n-word shingles of an array of words, in text order; each word is hashed once."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        shingle_starts(h, n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))


def shingle_texts(words: Column, n: Column) -> Column:
    """The distinct shingles themselves, for the exact check; linear in the number of words."""
    return F.array_distinct(let(words, lambda w: F.transform(
        F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(w, i + 1, n), " "))))


def item_sets(items: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(item_id, __item, __words, width, shingles, n_shingles); items without a word drop out. The width of a
    shingle is n, or the item's words where it has fewer."""
    one = items.select("item_id", F.coalesce("text", F.lit("")).alias("__text")).distinct()
    one = one.withColumn("__words", words_of(F.col("__text"))).where(F.size("__words") > 0)
    one = one.withColumn("width", F.least(F.size("__words"), F.lit(n)))
    one = one.withColumn("shingles", shingle_texts(F.col("__words"), F.col("width")))
    return one.select("item_id", F.xxhash64("item_id", "__text").alias("__item"), "__words", "width", "shingles",
                      F.size("shingles").alias("n_shingles"))


def item_sketches(sets: DataFrame, n: int = SHINGLE, values: int = ITEM_VALUES) -> DataFrame:
    """(value, __item, __least): least is the smallest size of the item's partition."""
    least = F.pow(F.lit(2), F.floor(F.log2(F.col("n_shingles")))).cast("int")
    lowest = F.slice(F.sort_array(F.array_distinct(_shingle_hashes(F.col("__words"), n))), 1, values)
    return sets.where(F.col("width") == n).select(F.explode(lowest).alias("value"), "__item", least.alias("__least"))


def block_sketches(words: DataFrame, n: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(text key, x, pos, value): the values of each block in rising order; ``words`` has key and __words. The hashes of
    a text are made once and cut into blocks."""
    def cut(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(block)),
                           lambda i: F.array_sort(F.array_distinct(F.slice(hashes, i + 1, block))))
    rows = words.where(F.size("__words") >= n).select(*KEY, F.explode(
        let(_shingle_hashes(F.col("__words"), n), cut)).alias("__values"))
    return rows.select(*KEY, F.size("__values").alias("x"), F.posexplode("__values").alias("pos", "value"))


def run_candidates(words: DataFrame, sets: DataFrame, n: int = SHINGLE) -> DataFrame | None:
    """(text key, __item) of texts that hold the words of an item of fewer than n, by their hash."""
    short = sets.where(F.col("width") < n)
    widths = sorted(r[0] for r in short.select("width").distinct().collect())  # n - 1 at most
    if not widths:
        return None
    named = lambda w: F.array_distinct(_shingle_hashes(F.col("__words"), w))
    runs = words.select(*KEY, F.explode(F.flatten(F.array(*[
        F.transform(named(w), lambda x: F.xxhash64(F.lit(w), x)) for w in widths]))).alias("value"))
    whole = [F.when(F.col("width") == w, F.transform(named(w), lambda x: F.xxhash64(F.lit(w), x))) for w in widths]
    return runs.join(short.select("__item", F.explode(F.coalesce(*whole)).alias("value")), "value").select(*KEY, "__item")


def candidates(docs: DataFrame, sketches: DataFrame, n: int = SHINGLE, block: int = BLOCK,
               depth: float = DEPTH) -> DataFrame:
    """(text key, __item) that share a sketch value; ``docs`` has key and __words."""
    pairs = block_sketches(docs, n, block).join(sketches, "value")
    deep = F.ceil(F.lit(depth) * F.col("x") / F.col("__least"))
    return pairs.where(F.col("pos") < deep).select(*KEY, "__item")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = SHINGLE,
                 block: int = BLOCK, depth: float = DEPTH) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_shingles, containment), one for each document row and item
    whose shingles stand in the document to at least ``threshold``.

    Null and empty texts, and texts without a word, match nothing. An item of fewer than n words is one shingle and
    matches where its words stand in a row. Repeated rows of documents give repeated results, equal rows of items
    count once; empty tables give no rows; further columns are ignored.
    """
    sets = store(item_sets(items, n), "items")
    words = docs.select(*text_key(F.col("text")), words_of(F.col("text")).alias("__words"))
    found = candidates(words, small(store(item_sketches(sets, n), "sketches")), n, block, depth)
    runs = run_candidates(words, sets, n)
    found = store((found if runs is None else found.unionByName(runs)).distinct(), "candidates")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"),
                       *text_key(F.col("text"))).join(small(found), list(KEY))
    # items travel to the candidates by shuffle or by what the planner knows of their size
    rows = rows.join(sets.drop("__words"), "__item")
    rows = rows.withColumn("__have", shingle_texts(words_of(F.col("__text")), F.col("width")))
    rows = rows.withColumn("n_shared", F.size(F.array_intersect("shingles", "__have")))
    share = F.col("n_shared") / F.col("n_shingles")
    return rows.where(share >= threshold).select(
        "doc_id", "item_id", F.col("n_shared").cast("long").alias("n_shared"),
        F.col("n_shingles").cast("long").alias("n_shingles"), share.alias("containment"))


def contaminated_keys(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Distinct text keys of contaminated documents, for filters."""
    keyed = docs.select(F.struct(*text_key(F.col("text"))).alias("doc_id"), "text")
    return contaminated(keyed, items, **how).select("doc_id.*").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without contaminated documents, all columns as they were."""
    hit = small(store(contaminated_keys(docs, items, **how), "hit"))
    rows = docs.select("*", *text_key(F.col("text")))
    return rows.join(hit, list(KEY), "left_anti").drop(*KEY)
