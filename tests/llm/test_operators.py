"""The operators against brute force, held-out accuracy or an exact round trip."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formatpulse.llm import (
    decontam, licenses, linededup, mixing, orderminhash, quality, repeats, tokens, toxicity, urls,
)

from formatpulse.llm.common import identity

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("run_lines", [1, 2, licenses.RUN_LINES])
def test_license_join_equals_all_pairs(spark, run_lines):
    rng = random.Random(3)
    pool = "licensed under the apache mit license version 2 0 4 cc by nc a b c d e f".split()
    lines = [" ".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(3000)]
    frame = spark.createDataFrame([(i, "\n".join(lines[i * 3: i * 3 + 3])) for i in range(1000)],
                                  "doc_id bigint, text string")
    got = {(r["block"], r["label"], r["template"], round(r["containment"], 9), r["doc_id"])
           for r in licenses.block_matches(frame, run_lines=run_lines).join(
               frame.select("doc_id", *licenses.text_key(F.col("text"))), list(licenses.KEY)).collect()}
    want = set()
    for i in range(1000):
        for b in range(3):
            have = set(WORD.findall(" ".join(lines[i * 3 + b: min(i * 3 + 3, i * 3 + b + run_lines)])))
            for label, all_texts in licenses.TEMPLATES.items():
                for k, t in enumerate(all_texts):
                    ws = set(licenses.template_words(t))
                    if len(have & ws) / len(ws) >= 0.8:
                        want.add((b, label, k, round(len(have & ws) / len(ws), 9), i))
    assert len(want) > 20 and got == want


def test_wrapped_licenses_are_found(spark):
    import textwrap

    texts = {label: t for label, all_texts in licenses.TEMPLATES.items() for t in all_texts}
    rows = []
    for width in (40, 72, 79):
        for label in ("mit", "bsd"):
            body = "\n".join(f" * {line}" for line in textwrap.wrap(texts[label], width))
            rows.append((f"{label} {width}", f"a first line\n\n{body}\n\nand a last one"))
    rows.append(("none", "\n".join(f"word {i} of the text and so on" for i in range(60))))
    rows.append(("far", "\n".join(w + "\n" * 7 for w in licenses.template_words(texts["mit"]))))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name in got:
        label = name.split()[0] if " " in name else ""
        assert got[name]["labels"] == label and got[name]["score"] == (1.0 if label else 0.0), name
        assert got[name]["n_blocks"] == (1 if label else 0)


def test_license_places(spark):
    text = "CC-BY, all rights reserved; General  Public\nLicense cc by 4. Kcc by"
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    words = WORD.findall(fold(text))
    assert row["n_words"] == len(words) and row["n_base"] == 4
    assert (row["first_word"], row["last_word"]) == (0, words.index("4") - 2)
    assert row["base_labels"] == "cc-by,gpl,reserved" and row["score"] == 1.0


def test_contamination_equals_brute_force(spark, docs, texts):
    def shingles(text):
        w = WORD.findall(fold(text))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    sets = {r["item_id"]: shingles(r["text"]) for r in items.collect()}
    want = set()
    for d, t in texts.items():
        have = shingles(t)
        want |= {(d, i, len(s & have)) for i, s in sets.items() if s and len(s & have) / len(s) >= 0.8}
    got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == want and want


def test_short_items_match_as_word_runs(spark):
    docs = spark.createDataFrame([(1, "so Red, green! it is"), (2, "green red"), (3, "one"), (4, "one two three four five"),
                                  (5, "two three four five six seven"), (6, None), (7, "red green blue one two")], "doc_id int, text string")
    items = spark.createDataFrame([(0, "red green"), (1, "one"), (2, "two three four five"), (3, "four five six seven eight"),
                                   (4, ""), (5, None), (6, "four five six seven")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 0, 1, 1), (7, 0, 1, 1), (3, 1, 1, 1), (4, 1, 1, 1), (7, 1, 1, 1), (4, 2, 1, 1), (5, 2, 1, 1), (5, 6, 1, 1)}


def line_dedup_brute(rows, min_words):
    """Deleted (row, line) by definition, over all runs."""
    lines = [(t or "").split("\n") for _, t in rows]
    kept = [[i for i, l in enumerate(ls) if l.strip(" \t\n\v\f\r")] for ls in lines]
    seen, runs = {}, []
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, r))
    for r in order:
        idx = kept[r]
        for a in range(len(idx)):
            for b in range(a + 1, len(idx) + 1):
                run = tuple(lines[r][i] for i in idx[a:b])
                if sum(len(re.findall(r"[^\x20\x09-\x0D]+", l)) for l in run) >= min_words:
                    runs.append((r, a, b, run))
                    seen.setdefault(run, (order.index(r), a))
    return {(r, kept[r][i]) for r, a, b, run in runs if (order.index(r), a) > seen[run] for i in range(a, b)}


def test_line_dedup_equals_all_runs(spark):
    rng = random.Random(5)
    pool = ["a", "b c", "d e f", "g h i j", "k l m n o", "", "  ", "p q r s t u v w x y z"]
    rows = [(i % 37, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)] + [(None, "g h i j\nk l m n o\nb c")]
    rows += rows[:4] + rows[:2] + [(None, rows[-1][1])]  # rows that repeat id and text
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    named = frame.distinct().select("doc_id", "text", *[c.alias(n) for c, n in zip(
        identity(F.col("doc_id"), F.col("text")), "ab", strict=True)]).collect()
    place = {(r["doc_id"], r["text"]): (r["a"], r["b"]) for r in named}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, place[r]))
    gone = line_dedup_brute(rows, 8)
    want = sorted([(str(d), "\n".join(l for i, l in enumerate(t.split("\n")) if (k, i) not in gone)) for k, (d, t) in enumerate(rows)])
    got = linededup.dedup_lines(frame, 8).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == want and gone
    assert sum(r["n_removed"] for r in got) == len(gone)


def in_other_splits(spark, path, build):
    """What ``build`` returns when its table is read in one split, then in many, and stored rows meet both."""
    def rows(parts):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        return sorted(map(str, build(spark.read.parquet(path)).collect()))
    out = [rows(1)]
    lazy = None
    try:
        lazy = build(spark.read.parquet(path))  # steps stored while the table has one split
        spark.conf.set("spark.sql.files.minPartitionNum", 24)
        out.append(sorted(map(str, lazy.collect())))
        out.append(rows(24))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    return out


@pytest.mark.parametrize("operator", ["linededup", "repeats", "keep_one"])
def test_other_file_splits_change_nothing(spark, tmp_path, operator):
    path = str(tmp_path / "docs")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 400")
    docs.unionByName(docs.where("doc_id < 40")).repartition(24).write.parquet(path)
    build = {"linededup": linededup.dedup_lines, "repeats": repeats.remove_repeats, "keep_one": orderminhash.keep_one}[operator]
    first, mixed, other = in_other_splits(spark, path, build)
    assert first == mixed == other and first


def test_line_dedup_text(spark):
    run = "one two three four\nfive six seven\neight nine ten eleven"
    frame = spark.createDataFrame([(1, "head\n" + run), (2, run + "\n\ntail"), (3, run)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in linededup.dedup_lines(frame).collect()}
    assert got == {1: ("head\n" + run, 0, 0), 2: ("\ntail", 3, 1), 3: ("", 3, 1)}


def test_raking_meets_margins(spark, docs):
    wanted = {"lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}}
    rows = mixing.celled(docs)
    cells = rows.groupBy(*mixing.DIMS).agg(F.sum("__tokens").alias("__tokens"))
    targets = {d: mixing.target_shares(cells, d, wanted.get(d.strip("_")), 0.5) for d in mixing.DIMS}
    raked = mixing.rake(cells, targets).toPandas()
    # numpy raking of the same cells
    w = raked["__tokens"].to_numpy(float) / raked["__tokens"].sum()
    shares = {d: {r[d]: r["__target"] for r in t.collect()} for d, t in targets.items()}
    for _ in range(25):
        for d in mixing.DIMS:
            total = collections.defaultdict(float)
            for v, x in zip(raked[d], w, strict=True):
                total[v] += x
            w = np.array([x * shares[d][v] / total[v] for v, x in zip(raked[d], w, strict=True)])
    assert np.allclose(raked["__weight"], w, atol=2e-4)
    for d in mixing.DIMS:
        for value, got in raked.groupby(d)["__weight"].sum().items():
            assert abs(got - shares[d][value]) < 1e-3


def test_mix_budget_and_draw(docs):
    out = mixing.mix(docs, keep=0.5).toPandas()
    tokens_all = out["n_tokens"].sum()
    assert abs((out["probability"] * out["n_tokens"]).sum() / tokens_all - 0.5) < 1e-6
    assert out["probability"].between(0, 1).all() and abs(out["kept"].mean() - out["probability"].mean()) < 0.06


def test_tokens_round_trip(docs, texts):
    encoder, sizes = tokens.build(tokens.load_ranks())
    for r in tokens.count_tokens(docs).limit(150).collect():
        text = texts[r["doc_id"]]
        ids = tokens.encode(text, encoder)
        assert encoder.decode(ids.tolist()) == text and len(ids) == r["n_tokens"] == sum(r["section_tokens"])
        start, end = tokens.spans(text, ids, sizes)
        begins = [0, *[i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]]
        want = [0] * len(begins)
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            held = [max(0, min(e, b2) - max(s, b1)) for b1, b2 in zip(begins, [*begins[1:], len(text)], strict=True)]
            want[max(range(len(held)), key=lambda k: (held[k], -k))] += 1
        assert want == r["section_tokens"]


def test_token_rules_at_boundaries():
    start, end, begins = np.array([0, 2, 3]), np.array([2, 6, 9]), np.array([0, 3, 5])
    assert tokens.attribute(start, end, begins, 9, "first")[0].tolist() == [2, 1, 0]
    assert tokens.attribute(start, end, begins, 9, "last")[0].tolist() == [1, 0, 2]
    per, crossing = tokens.attribute(start, end, begins, 9)
    assert per.tolist() == [1, 1, 1] and crossing == 2


def repeats_brute(data, length):
    count = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 9)))
    prose = [" ".join(word() for _ in range(400)) for _ in range(12)]
    rows = list(prose[:6])
    for _ in range(25):  # pasted pieces, some edited, some at the very edge of the length
        a, b = rng.sample(prose, 2)
        n, i = rng.choice([395, 399, 400, 401, 480, 900]), rng.randint(0, 900)
        piece = a[i:i + n]
        if rng.random() < 0.3:
            k = rng.randint(0, len(piece) - 1)
            piece = piece[:k] + "#" + piece[k + 1:]
        rows.append(b[:200] + str(rng.random()) + piece + b[-100:])
    rows += ["ab" * 700, "z" * 1000, "z" * 399, prose[0], "", None, "ab" * 300 + "!"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r[1:5]) for r in repeats.remove_repeats(frame).collect()}
    want = repeats_brute([(r or "").encode() for r in rows], 400)
    assert [got[i] for i in range(len(rows))] == want


def test_long_texts_are_cut_in_slices(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    whole = repeats.triggers(data)
    monkeypatch.setattr(repeats, "SLICE", 700)
    first, last, at = repeats.triggers(data)
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    assert set(at.tolist()) == set(whole[2].tolist())


def groups_brute(names, threshold=0.8):
    parent = {i: i for i in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(names)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if orderminhash.similarity(names[a], names[b]) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_similarity_is_ordered_jaccard():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = rng.permutation(1000)[:40].astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 4)):
            b = np.delete(b, rng.integers(0, len(b)))
        if rng.random() < 0.4:
            i = rng.integers(0, len(b) - 1)
            b[i], b[i + 1] = b[i + 1], b[i]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        want = table[-1, -1] / (len(a) + len(b) - table[-1, -1])
        got = orderminhash.similarity(a, b)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_near_duplicate_classes(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(3, 160))] for _ in range(40)]
    rows = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rng.randint(0, 6)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = f"v{rng.randint(0, 9999)}"
            rows.append(" ".join(c))
    rows += [rows[0], rows[0], "", None, "  ", " ".join(reversed(base[0]))]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in orderminhash.classes(frame).collect()}
    names = {i: orderminhash.labelled_shingles(t) for i, t in enumerate(rows)}
    want = groups_brute(names)
    assert got == want
    kept = orderminhash.keep_one(frame.coalesce(1)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_pivots_and_leftovers_give_the_same_groups(spark):
    """A chain in shared buckets: neighbours link, ends do not; no rounds of pivots at all must agree."""
    words = [f"t{i}" for i in range(120)]
    rows = []
    for step in range(14):
        c = list(words)
        for k in range(step):
            c[100 - 6 * k] = f"changed{k}"
        rows.append((step, " ".join(c)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = {i: orderminhash.labelled_shingles(t) for i, t in rows}
    for rounds in (0, 2):
        got = {r["doc_id"]: r["class_id"] for r in orderminhash.classes(frame, rounds=rounds).collect()}
        assert got == groups_brute(names)


def quality_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if count[tuple(words[i:i + 5])] > 1:
            covered |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_quality_counts_and_rules(spark, docs, texts):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.judge_quality(docs, labels).collect()}
    for d, t in texts.items():
        want = quality_brute(t)
        r = got[d]
        assert tuple(r[c] for c in quality.COUNTS[:5]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [got[d]["kept"] for d, q in truth.items() if q == 1]
    bad = [got[d]["kept"] for d, q in truth.items() if q == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.5


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = {f: rng.random(3000) for f in quality.FEATURES}
    bad = ((x["symbol_share"] > 0.8) & (x["mean_word"] <= 0.5)) | (x["capital_share"] > 0.9)
    rules = quality.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality._covers(rule, x)
    assert (hit == bad).mean() > 0.97 and 2 <= len(rules) <= 16


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.select("doc_id", "toxic").distinct()
    got = toxicity.score_toxicity(docs.join(known, "doc_id", "left_semi"), labels).join(known, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    bad, good = held[held["toxic"] == 1], held[held["toxic"] == 0]
    above = (bad["score"].to_numpy()[:, None] > good["score"].to_numpy()).mean()  # area under the curve
    # some 300 toxic rows in four languages teach less than the larger tables do
    assert above > 0.88 and bad["predicted"].mean() > 0.4 and good["predicted"].mean() < 0.05


def test_unseen_spelling_shares_vectors():
    good = [f"the house number {i} stands by a green river" for i in range(80)]
    bad = [f"the house number {i} hides a moronic {w} here" for i, w in enumerate(["idiot", "idiots", "idiotic"] * 27)]
    model = toxicity.train(good + bad, [0] * len(good) + [1] * len(bad))
    assert toxicity.score_text("the house hides an idiottt here", *model) > toxicity.score_text(
        "the house hides an orange here", *model)


def test_url_model_on_withheld_labels(spark):
    """Labels of a third of the URLs are withheld; the trees recover most of them."""
    rows = urls.featured(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url"))
    known = rows.where(F.col("label").isNotNull())
    model = urls.fit_trees(known.where("page_id % 3 <> 0"))
    held = urls.VectorAssembler(inputCols=list(urls.FEATURES), outputCol="__features").transform(
        known.where("page_id % 3 = 0"))
    right = model.transform(held).select(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()["a"]
    assert right > 0.9


def test_url_rules_equal_brute_force(spark):
    def parts(url):
        if "://" not in (url or ""):
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return fold(host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    link = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in urls.filter_urls(pages).collect():
        host, path = parts(link[r["page_id"]])
        best = None
        for rule, said in urls.RULES:
            domain, start = rule.split("/", 1)
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
                best = max(best or ("", ""), (rule, said), key=lambda x: len(x[0]))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] in ("allow", "block") and (best is None or r["verdict"] == best[1])
