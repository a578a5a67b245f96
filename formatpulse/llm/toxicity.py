"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of the word itself, hashed into
buckets; a document is the mean of its distinct words; a linear softmax reads the class. Vectors and
softmax are trained together, by Adam on a bounded sample of labelled rows, in one task: the executors make
the sample's bags, the task takes them in small pieces into two flat arrays, which is all it holds of them, and neither
texts nor bags reach the driver. Unseen spellings
share most n-grams with the words that were seen. As the model is linear, a trained bucket is one
number, so scoring looks up and averages numbers, and only those (two megabytes) travel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.llm.common import free
from formatpulse.session import store

BITS = 19
BUCKETS = 1 << BITS
DIM = 4
#: Documented bounds of the training sample: labelled rows of each class, and buckets in all bags together.
PER_CLASS = 2000
SAMPLE_BUCKETS = 24_000_000
#: Buckets of a bag that travel as one row: an Arrow batch of 10,000 rows then holds some 10 MB, whatever the texts.
PIECE = 128
#: Logits are averages of words of which few matter, so they are scaled up.
SCALE = 40.0
_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of_text(text: str | None) -> list[str]:
    """The distinct words in lower case."""
    return list(set(_WORD.findall(text.lower()))) if text else []


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER
    return ((h ^ (h >> np.uint64(32))) * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of its word) of every n-gram of 3 to 5 characters with word ends, and of every
    whole word; time and memory are linear in the characters, however long a word is."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(points))  # characters to the word's end
    buckets, owners = [], []
    h = points.copy()
    for n in range(2, 6):
        h = h[:-1] * np.uint64(1_000_003) + points[n - 1:]
        if n > 2:
            fits = left[:len(h)] >= n
            buckets.append(_bucket(h[fits] + np.uint64(n)))
            owners.append(owner[:len(h)][fits])
        if len(h) < 2:
            break
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), 0x5851F42D4C957F2D, np.uint64))
        spot = np.arange(len(points)) - np.repeat(starts, sizes)
        whole = np.add.reduceat(points * powers[spot], starts)
    buckets.append(_bucket(whole))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight): the document as the mean of its words, each the mean of its buckets."""
    words = words_of_text(text)
    buckets, owner = subwords(words)
    if not len(buckets):
        return buckets.astype(np.int32), np.zeros(0, np.float32)
    each = 1.0 / (np.bincount(owner) * len(words))
    used, place = np.unique(buckets, return_inverse=True)
    return used.astype(np.int32), np.bincount(place, each[owner]).astype(np.float32)


def train(texts: list[str], labels: list[int], **how) -> tuple[np.ndarray, float]:
    return train_bags([bag(t) for t in texts], labels, **how)


def train_bags(parts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], **how) -> tuple[np.ndarray, float]:
    ends = np.cumsum([len(b) for b, _ in parts])
    return train_flat(np.concatenate([b for b, _ in parts]), np.concatenate([w for _, w in parts]),
                      np.concatenate(([0], ends[:-1])), ends, labels, **how)


def train_flat(flat: np.ndarray, share: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: list[int], epochs: int = 12,
               rate: float = 0.035, batch: int = 100, decay: float = 1e-4, dim: int = DIM, dropout: float = 0.6,
               min_share: float = 0.005, seed: int = 5) -> tuple[np.ndarray, float]:
    """(bucket scores, bias): a word's score is the mean of its buckets, a document's logit the mean
    of its words plus bias. Vectors and softmax are trained together by Adam. Bag i is [starts[i], ends[i]) of
    ``flat`` (buckets) and ``share`` (weights), in any order; both arrays are overwritten, not copied."""
    rng = np.random.default_rng(seed)
    n_texts = len(starts)
    seen = np.zeros(BUCKETS, np.int32)
    for lo, hi in zip(starts, ends, strict=True):  # no bucket stands twice in a bag
        seen[flat[lo:hi]] += 1
    known = np.flatnonzero(seen >= max(2, min_share * n_texts))
    local = np.full(BUCKETS, -1, np.int32)
    local[known] = np.arange(len(known))
    starts, ends, at = np.array(starts), np.array(ends), 0
    for i in np.argsort(starts, kind="stable"):  # known buckets move to the front, bag by bag
        lo, hi = starts[i], ends[i]
        named = local[flat[lo:hi]]
        here = named >= 0
        starts[i], ends[i] = at, at + np.count_nonzero(here)
        flat[at:ends[i]], share[at:ends[i]] = named[here], share[lo:hi][here]
        at = ends[i]
    y = np.array(labels)
    per_class = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
    params = [rng.normal(0, 0.1, (len(known), dim)).astype(np.float32),
              rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros((1, 2), np.float32)]
    slow, fast = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n_texts)
        speed = rate * (1 - epoch / epochs) + rate * 0.05
        for lo in range(0, len(order), batch):
            ids = order[lo:lo + batch]
            sizes = ends[ids] - starts[ids]
            rows = [slice(starts[i], ends[i]) for i in ids]
            bucket, weight = (np.concatenate([x[r] for r in rows]) for x in (flat, share))
            weight = weight * (rng.random(len(weight), np.float32) >= dropout) / np.float32(1 - dropout)
            doc = np.repeat(np.arange(len(ids)), sizes)
            vectors = np.zeros((len(ids), dim), np.float32)
            if len(bucket):
                some = np.flatnonzero(sizes)
                begin = (np.cumsum(sizes) - sizes)[some]
                vectors[some] = np.add.reduceat(params[0][bucket] * weight[:, None], begin, axis=0)
            logits = SCALE * vectors @ params[1] + params[2]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = ((p - np.eye(2)[y[ids]]) * per_class[y[ids]][:, None] / len(ids)).astype(np.float32)
            inner = SCALE * error @ params[1].T
            touched = np.stack([np.bincount(bucket, inner[doc, d] * weight, len(known)) for d in range(dim)], 1)
            grads = [touched + decay * params[0], SCALE * vectors.T @ error, error.sum(0, keepdims=True)]
            step += 1
            for k, (value, grad) in enumerate(zip(params, grads, strict=True)):
                slow[k] += 0.1 * (grad - slow[k]).astype(np.float32)
                fast[k] += 0.01 * (grad * grad - fast[k]).astype(np.float32)
                params[k] = value - np.float32(speed / (1 - 0.9**step)) * slow[k] / (
                    np.sqrt(fast[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    axis = params[1][:, 1] - params[1][:, 0]
    scores = np.zeros(BUCKETS, np.float32)
    scores[known] = SCALE * params[0] @ axis
    return scores, float(params[2][0, 1] - params[2][0, 0])


def score_text(text: str | None, scores: np.ndarray, bias: float) -> float:
    words = words_of_text(text)
    total = 0.0
    for lo in range(0, len(words), 50_000):  # a slice at a time bounds the memory
        part = words[lo:lo + 50_000]
        buckets, owner = subwords(part)
        total += float((np.bincount(owner, scores[buckets]) / np.bincount(owner)).sum())
    return float(1 / (1 + np.exp(-np.clip(total / max(1, len(words)) + bias, -500, 500))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled_bags(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = SAMPLE_BUCKETS) -> DataFrame:
    """(doc_id, toxic, bag) of at most ``per_class`` labelled ids of each class outside the held-out fold, by a hash of the
    id, with the bags of their whole texts, stored. Where these hold more than ``most`` buckets, ids behind
    that sum in the hash's order are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", "toxic").distinct().withColumn("__h", F.xxhash64(F.lit(3), "doc_id"))
    picked = [r for y in (0, 1) for r in
              known.where(F.col("toxic") == y).orderBy("__h", "doc_id").limit(per_class).collect()]
    chosen = docs.sparkSession.createDataFrame(picked, known.schema)  # two per_class rows at most

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([b"".join(x.tobytes() for x in bag(t.as_py())) for t in texts], pa.binary())

    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(
        F.max("text").alias("text"), F.first("__h").alias("__h"))
    bags = store(rows.select("doc_id", "toxic", "__h", packed("text").alias("bag")), "bags")
    total, last = 0, None
    for r in bags.groupBy("__h").agg(F.sum(F.octet_length("bag")).alias("bytes")).orderBy("__h").collect():  # two per_class rows
        total += r["bytes"] // 8
        if total > most:
            break
        last = r["__h"]
    return bags.where(F.lit(False) if last is None else F.col("__h") <= last).select("doc_id", "toxic", "bag")


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 8
    return np.frombuffer(data, np.int32, n), np.frombuffer(data, np.float32, n, 4 * n)


def pieces(bags: DataFrame, piece: int = PIECE) -> DataFrame:
    """(doc_id, toxic, buckets, weights): each bag in rows of ``piece`` buckets, in order and one after the other; an
    empty bag in one row."""
    half, step = "octet_length(bag) div 2", 4 * piece
    cut = bags.select("doc_id", "toxic", "bag", F.explode(F.expr(f"sequence(0, greatest({half} - 1, 0) div {step})")).alias("k"))
    size = f"cast(least({step}, {half} - k * {step}) as int)"
    return cut.select(
        "doc_id", "toxic", F.expr(f"substring(bag, cast(k * {step} + 1 as int), {size})").alias("buckets"),
        F.expr(f"substring(bag, cast({half} + k * {step} + 1 as int), {size})").alias("weights"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Without both classes there is nothing to learn: every score is then 0.5."""
    bags = sampled_bags(docs, labels, per_class)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, share = np.empty(SAMPLE_BUCKETS, np.int32), np.empty(SAMPLE_BUCKETS, np.float32)  # memory is taken as it fills
        keys, starts, at = [], [], 0
        for batch in batches:
            ids, marks, buckets, weights = batch.columns
            for d, y, b, w in zip(ids.to_pylist(), marks.to_pylist(), buckets, weights, strict=True):
                if not keys or keys[-1] != (d, y):
                    keys.append((d, y))
                    starts.append(at)
                part = np.frombuffer(b.as_buffer(), np.int32)
                flat[at:at + len(part)], share[at:at + len(part)] = part, np.frombuffer(w.as_buffer(), np.float32)
                at += len(part)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        ys = [keys[i][1] for i in order]
        if len(set(ys)) == 2:
            scores, bias = train_flat(flat, share, np.array(starts)[order], np.array([*starts[1:], at])[order], ys)
            at = np.flatnonzero(scores).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"at": [at.tobytes()], "score": [scores[at].tobytes()], "bias": [bias]})
    # a bounded sample in one task; a lost executor only means that it runs again
    found = pieces(bags.coalesce(1)).mapInArrow(learn, "at binary, score binary, bias double").collect()
    scores = np.zeros(BUCKETS, np.float32)
    if not found:
        return scores, 0.0
    scores[np.frombuffer(found[0]["at"], np.int32)] = np.frombuffer(found[0]["score"], np.float32)
    return scores, found[0]["bias"]


def with_scores(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with the probability as a further column; any column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:  # one text at a time becomes a Python string
            yield pa.array([score_text(t.as_py(), *shared.value) for t in texts], pa.float64())
    return docs.withColumn(name, score("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, cut_at: float = 0.7,
                   per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts, and texts without a word, get the bias alone; repeated rows repeated
    results; an empty table gives no rows; labels of several values for one id all count; further
    columns are ignored.
    """
    rows = with_scores(docs.select("doc_id", "text"), fit(docs, labels, per_class), "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= cut_at).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut_at: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` without those that score ``cut_at`` or more; columns, whatever their names, as they were.

    Null and empty texts get the bias alone, repeated rows fare alike, a table without rows gives none; without labels of
    both classes all scores are 0.5.
    """
    name, = free(docs, "__toxic")
    return with_scores(docs, fit(docs, labels, per_class), name).where(F.col(name) < cut_at).drop(name)
