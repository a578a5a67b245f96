"""Merkle manifest, fill-in-middle and embedding near-dedup against brute force, edge cases included."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formatpulse.llm import fim, merkle, vectordedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word, " * 30_000
ROWS = [
    (1, "one\ntwo", "en", "a", 7), (1, "one\ntwo", "en", "a", 7), (1, "other", None, "a", None), (2, None, None, None, None),
    (None, "x\ny", "en", "b", 3), (None, None, None, None, None), (3, "", "en", "b", 0), (4, LONG, "de", "a", len(LONG)),
    (5, "ÀÉ 漢字 \U0001F600 word<\nS>", "fr", "é", 1), (6, "has <P> in it", "fr", "", 1), (2**53 + 1, "a\nb c", "en", "a", 5),
    *[(i, f"text {i}\nmore {'<' * (i % 3)}", "en", "hot", i) for i in range(100, 160)],
]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows) -> list[tuple]:
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources: dict = {}
    for doc, text, lang, source, n in rows:
        bad = text
        if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0:
            bad = text.replace("\n", "")
        leaf, other = (digest("".join(map(part, (doc, source, lang, n, t)))) for t in (text, bad))
        sources.setdefault(source, []).append((doc, leaf, other))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            first = i // 3 * 3
            yield "".join(nodes[first:i]), "".join(nodes[i + 1:first + 3])
            i //= 3
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = levels([leaf for _, leaf, _ in sources[name]])
    top = levels([trees[name][-1][0] for name in names])
    root, out = top[-1][0], []
    for k, name in enumerate(names):
        for i, (doc, leaf, other) in enumerate(sources[name]):
            steps = [*path(trees[name], i), *path(top, k)]
            acc = other
            for left, right in steps:
                acc = digest(left + acc + right)
            out.append((doc, leaf, trees[name][-1][0], root, digest("".join(x + y for x, y in steps)), acc, acc == root))
    return sorted(out, key=str)


def with_clashes(df):
    for name in ("leaf", "n", "idx", "kids", "path", "node", "root", "form", "r", "part", "weight", "a", "b"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("rows", [ROWS, ROWS[5:6]])
def test_manifest_equals_plain_trees(spark, rows):
    got = merkle.verify_documents(with_clashes(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)


def test_manifest_steps_do_not_change_it(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for step in (2,):
        assert sorted((tuple(r) for r in merkle.verify_documents(docs, step=step).collect()), key=str) == plain_manifest(ROWS)
    assert merkle.verify_documents(docs.limit(0)).collect() == []


def test_tampering_is_seen(spark):
    rows = merkle.verify_documents(spark.createDataFrame(ROWS, SCHEMA)).where("doc_id >= 100 and doc_id < 160").collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1)


def test_boundaries_in_every_container():
    rng = random.Random(3)
    kinds = set()
    for alphabet, size in (("ab. ", 70_000), ("aaaaaaaaaaaaaaaaaaa.", 140_000), (".", 66_000), ("a", 66_000), ("é漢\U0001F600a", 300),
                           ("a", 65_536), ("a.", 65_537), ("abcde ", 9), ("", 0), ("a.b", 131_072)):
        text = "".join(rng.choices(alphabet, k=size)) if alphabet else ""
        words = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        ends, sums = fim.Boundaries(text), np.cumsum([0, *map(len, words)])
        assert len(ends) == len(words)
        for u in {0, len(words), *rng.sample(range(len(words) + 1), min(50, len(words) + 1))}:
            assert ends.cut(u) == sums[u]
        kinds |= {type(c).__name__ for c in ends.containers}
    assert kinds == {"ArrayContainer", "BitmapContainer", "RunContainer"}


def test_fill_in_middle_round_trip(spark):
    docs = with_clashes(spark.createDataFrame(ROWS, SCHEMA))
    rows = fim.fill_in_middle(docs, keep_output=True).collect()
    texts = [(digest(r[1] or ""), r[0]) for r in ROWS]
    assert sorted(((r["restored_sha256"], r["doc_id"]) for r in rows), key=str) == sorted(texts, key=str)
    for r in rows:
        assert digest(r["output"]) == r["output_sha256"] and digest(fim.restore(r["output"], r["form"])) == r["restored_sha256"]
        assert (r["form"] == "plain") == (r["prefix_chars"] is None)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["form"] == by_id[3]["form"] == by_id[2]["form"] == "plain" and by_id[3]["n"] == 0
    text = next(r[1] for r in ROWS if r[0] == 2**53 + 1)
    name = hashlib.sha256(f"1:{2**53 + 1}".encode()).hexdigest()
    words = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    low, high = sorted(int(name[i:i + 8], 16) % (len(words) + 1) for i in (0, 8))
    if by_id[2**53 + 1]["form"] != "plain":
        assert by_id[2**53 + 1]["prefix_chars"] == len("".join(words[:low]))
        assert by_id[2**53 + 1]["middle_chars"] == len("".join(words[low:high]))
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_forms_have_their_shares():
    forms = [fim.transform_text("some text here", i)[1] for i in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.1) < 0.03 and abs(forms.count("spm") / 4000 - 0.18) < 0.03


def plain_near(rows, threshold=0.95):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    link = [[] for _ in rows]
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and fine(a) and fine(b) and len(a) == len(b):
                x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    link[i].append(j)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in link[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((name, len(link[i]), least, name == least))
    return sorted(out, key=str)


def planted_vectors(dim=8, seed=2):
    rng = np.random.default_rng(seed)
    rows, names = [], iter(range(1, 10_000))
    for spread, size in ((0.02, 40), (0.12, 40), (0.2, 30)):
        for _ in range(3):
            center = rng.normal(size=dim)
            rows += [(next(names), (center / np.linalg.norm(center) + rng.normal(0, spread, dim)).tolist()) for _ in range(size)]
    chain = np.linspace(0, np.pi, 25)  # each links with its neighbours only
    rows += [(next(names), [float(np.cos(t)), float(np.sin(t)), *[0.0] * (dim - 2)]) for t in chain]
    rows += [(next(names), rows[0][1]) for _ in range(30)] + [rows[0], (None, rows[0][1]), (None, None), (9001, []), (9002, [0.0] * dim),
             (9003, [float("nan")] * dim), (9004, [float("inf")] + [1.0] * (dim - 1)), (9005, [None] + [1.0] * (dim - 1)),
             (9006, [1e200] * dim), (9007, [1e-200] * dim), (9008, [1.0, 0.0]), (9009, [1.0, 0.01]), (9010, [-1.0] * dim)]
    return rows


@pytest.mark.parametrize("how", [{}, {"cell": 20, "block": 8}, {"cell": 60, "block": 1000}, {"cell": 5, "block": 1000}])
def test_near_vectors_equal_all_pairs(spark, how):
    rows = planted_vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((tuple(r) for r in vectordedup.near_vectors(with_clashes(df), **how).collect()), key=str)
    assert got == plain_near(rows)


def test_near_vectors_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id bigint, embedding array<float>")
    assert vectordedup.near_vectors(df.limit(0)).collect() == []
    assert sorted(map(tuple, vectordedup.near_vectors(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_cells_spare_comparisons(spark):
    """Where data have structure, a vector meets few cells."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(24, 16))
    rows = [(i, (centers[i % 24] / np.linalg.norm(centers[i % 24]) + rng.normal(0, 0.02, 16)).tolist()) for i in range(2400)]
    stored = vectordedup.packed_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    cells = vectordedup.fit_cells(stored, cell=100)
    met = vectordedup.meetings(vectordedup.visits(stored, cells, 0.95), 0.95)
    pairs = met.groupBy("left", "right", "i", "j").agg(F.sum("side").alias("s"), F.count("*").alias("n")).selectExpr(
        "sum(CASE WHEN left = right AND i = j THEN n * n / 2 ELSE s * (n - s) END) AS pairs").first()["pairs"]
    assert pairs < 0.15 * 2400**2 / 2
