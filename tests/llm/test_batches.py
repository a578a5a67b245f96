"""Batch forms against their plain forms, and further cases of the third round."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from formatpulse.llm import orderminhash as O
from formatpulse.llm import toxicity as T


def test_batch_sketches_equal_single_ones():
    rng = random.Random(2)
    texts = [None, "", "one", "one two", "a b c d", "a b c d e", "a b c d e f", "x " * 500, "x y " * 300, "...", "é ü 漢字 a b",
             "a" * 70_000, "same " * 7, " ".join(f"w{i}" for i in range(5000))]
    texts += [" ".join(rng.choices(["aa", "bb", "cc"], k=rng.randrange(1, 80))) for _ in range(200)]
    for part in (texts, texts[::-1], texts[:1], texts[2:3], []):
        for lo, hi in O.portions(part, 9_000):
            names, sizes = O.many_shingles(part[lo:hi])
            entries, bins = O.many_sketches(names, sizes), O.many_signatures(names, sizes)
            at = 0
            for i, text in enumerate(part[lo:hi]):
                want = O.labelled_shingles(text)
                assert names[at:at + sizes[i]].tolist() == want.tolist()
                at += sizes[i]
                if len(want):
                    assert entries[i].tolist() == O.sketch(want) and bins[i].tolist() == O.signature(want)
        assert [t for lo, hi in O.portions(part, 9_000) for t in part[lo:hi]] == part


def plain_score(text, scores, bias):
    """By nested loops: each word the mean of its buckets, the text the mean of its distinct words."""
    words, total = set(re.findall(r"\w+", (text or "").lower())), 0.0
    for word in words:
        names = {}
        padded = f"<{word}>"
        grams = [padded[i:i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
        mask = 2**64 - 1
        for gram in grams:
            h = 0
            for c in gram:
                h = (h * 1_000_003 + ord(c)) & mask
            names.setdefault(len(names), (h + len(gram)) & mask)
        whole, power = 0, 1
        for c in padded:
            power = power * 0x5851F42D4C957F2D & mask
            whole = (whole + ord(c) * power) & mask
        buckets = []
        for h in [*names.values(), whole]:
            h = ((h ^ h >> 29) * 0x9E3779B97F4A7C15) & mask
            buckets.append((((h ^ h >> 32) * 0x9E3779B97F4A7C15) & mask) >> (64 - T.BITS))
        total += sum(float(scores[b]) for b in buckets) / len(buckets)
    return 1 / (1 + np.exp(-(total / max(1, len(words)) + bias)))


def test_scores_equal_nested_loops():
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 3, T.BUCKETS).astype(np.float32)
    for text in (None, "", "a", "ab", "The the THE cat's naïve 漢字 x_1", "... !!!", "w" * 300, "é\u0301 \U0001F600z", "one two three " * 20):
        assert T.score_text(text, scores, 0.3) == pytest.approx(plain_score(text, scores, 0.3), abs=1e-6)


def test_toxicity_trains_from_small_pieces_in_place(spark):
    """A stage that trained on bags held whole took more than an executor's memory: pieces bound what a batch holds, and
    the flat arrays are reused instead of copied."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    texts = ["", "..."] + [" ".join(rng.choices(words[:200 + 50 * (i % 3)], k=rng.randrange(1, 120))) for i in range(40)]
    bags = [T.bag(t) for t in texts]
    labels = [i % 2 for i in range(len(bags))]
    df = spark.createDataFrame([(i, y, b.tobytes() + w.tobytes()) for i, ((b, w), y) in enumerate(zip(bags, labels, strict=True))],
                               "doc_id bigint, toxic int, bag binary")
    rows = T.pieces(df.coalesce(1), 7).collect()
    assert max(len(r["buckets"]) for r in rows) == 28 and all(len(r["buckets"]) == len(r["weights"]) for r in rows)
    for i, (b, w) in enumerate(bags):
        mine = [r for r in rows if r["doc_id"] == i]
        assert len(mine) == max(1, -(-len(b) // 7)) and {r["toxic"] for r in mine} == {labels[i]}
        assert b"".join(r["buckets"] for r in mine) == b.tobytes() and b"".join(r["weights"] for r in mine) == w.tobytes()
    # bags that lie in another order give the same model bit by bit
    want, bias = T.train_bags(bags, labels, epochs=3)
    place = rng.sample(range(len(bags)), len(bags))
    ends = np.cumsum([len(bags[i][0]) for i in place])
    starts = np.concatenate(([0], ends[:-1]))
    back = np.argsort(place)
    flat, share = (np.concatenate([bags[i][k] for i in place]) for k in (0, 1))
    got, other = T.train_flat(flat, share, starts[back], ends[back], labels, epochs=3)
    assert np.array_equal(got, want) and other == bias and np.count_nonzero(want)


def test_toxicity_training_copies_no_bags():
    n, size = 400, 10_000
    rng = np.random.default_rng(1)
    flat = np.concatenate([rng.choice(T.BUCKETS // 8, size, replace=False) for _ in range(n)]).astype(np.int32)
    share = np.full(n * size, 1e-4, np.float32)
    ends = np.arange(1, n + 1) * size
    tracemalloc.start()
    T.train_flat(flat, share, ends - size, ends, [i % 2 for i in range(n)], epochs=1, batch=10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < flat.nbytes + share.nbytes, peak
