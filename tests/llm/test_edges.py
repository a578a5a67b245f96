"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and
clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formatpulse.llm import (
    decontam, licenses, linededup, mixing, orderminhash, quality, repeats, tokens, toxicity, urls,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
         "sixteen seventeen eighteen nineteen twenty")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
ROWS = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, None, None), (None, PROSE, "en", "a"),
    (3, None, "en", "a"), (4, "", "en", "b"), (5, " \n\t\n ", "en", "b"), (6, LONG, "de", "b"),
    (7, "ÀÉ 漢字 \U0001F600 word", "fr", "b"), (8, "x", "fr", "c"), (None, None, None, None),
    (9, "a\u0000b " * 50, "en", "c"), (10, "aaaa" * 500, "en", "c"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edges")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], SCHEMA)
    clash = docs
    for name in ("score", "kept", "words", "n", "key", "topic", "weight", "bucket", "part", "data", "spans"):
        clash = clash.withColumn(name, F.lit("clash"))
    clash.write.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (None, 0, 1), (6, 0, 1), (7, None, None), (8, 0, 1), (8, 0, 1)],
        "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(0, PROSE), (1, None), (2, ""), (3, "two words"), (0, PROSE), (None, PROSE)],
                                  "item_id bigint, text string")
    for sub in ("", "/none"):
        labels.write.parquet(f"{folder}{sub}/labels.parquet")
        items.write.parquet(f"{folder}{sub}/benchmark.parquet")
    return str(folder)


def operators(spark, folder):
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    docs = read("documents")
    return {
        "licenses": lambda: licenses.scan_licenses(docs),
        "mixing": lambda: mixing.mix(docs),
        "tokens": lambda: tokens.count_tokens(docs),
        "repeats": lambda: repeats.remove_repeats(docs),
        "orderminhash": lambda: orderminhash.classes(docs),
        "quality": lambda: quality.judge_quality(docs, read("labels")),
        "toxicity": lambda: toxicity.score_toxicity(docs, read("labels")),
        "linededup": lambda: linededup.dedup_lines(docs),
    }


NAMES = ["licenses", "mixing", "tokens", "repeats", "orderminhash", "quality", "toxicity", "linededup"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_document(spark, tables, name):
    got = operators(spark, tables)[name]().collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, tables, name):
    assert operators(spark, f"{tables}/none")[name]().count() == 0


def test_decontamination_edges(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    got = decontam.contaminated(docs, items).collect()
    want = [(d, i) for d in (1, 1, 2, None) for i in (0, None)]
    assert sorted(map(str, ((r["doc_id"], r["item_id"]) for r in got))) == sorted(map(str, want))
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).count() == len(ROWS)
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 4


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.COM/x"), (5, "HTTP://A.COM/x"),
            (None, "http://www.example.com/en/1"), (7, "http://example.com/en/"), (8, "x://b.net/es/q?a://c/"),
            (9, "http://com"), (10, "http://" + "a" * 5000 + ".org/1?x=1&y=2#z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("score", F.lit("clash"))
    got = {(r["page_id"], r["host"], r["path"], r["rule"]): r["verdict"] for r in urls.filter_urls(pages).collect()}
    assert got[(1, "", "", None)] and got[(3, "", "", None)]
    assert got[(5, "a.com", "/x", "com/")] == "allow"
    assert got[(None, "www.example.com", "/en/1", "www.example.com/en/")] == "allow"
    assert got[(7, "example.com", "/en/", "example.com/en/")] == "block"
    assert got[(8, "b.net", "/es/q", "net/es/")] == "block"
    assert (9, "com", "", None) in got
    assert urls.filter_urls(pages.limit(0)).count() == 0
    assert {r["score"] for r in urls.filter_urls(pages.where("page_id = 3")).collect()} == {0.0}


def test_stages_survive_edges(spark, tables, tmp_path):
    for folder in (tables, f"{tables}/none"):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")])
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{folder[-4:]}-{name}"
            stage(spark, docs, folder).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "mixing":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
