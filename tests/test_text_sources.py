"""Text functions, landed payloads and the registry."""

import hashlib
import json
import math
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from formatpulse.functions import text as X
from formatpulse.functions import arrays as AR
from formatpulse.functions import vectors as V
from formatpulse.operators import filters as P
from formatpulse.operators.enrich import QuotaExhausted, embed_many, enrich, split_deferred
from formatpulse.sources import landed as L
from formatpulse.sources import normalise as N
from formatpulse.sources import registry as R

NOW = "2024-03-01 00:00:00"
NOW_DT = datetime(2024, 3, 1)


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)


def test_tokens_and_bigrams(spark):
    df = texts(spark, "How I tested the AI tool, don't stop! x 7 days", "", "the of")
    got = df.select(X.tokenize(F.col("t")).alias("k")).select("k", X.bigrams(F.col("k")).alias("b")).collect()
    assert got[0]["k"] == ["tested", "ai", "tool", "don't", "stop", "days"]
    assert got[0]["b"] == ["tested_ai", "ai_tool", "tool_don't", "don't_stop", "stop_days"]
    assert [r["k"] for r in got[1:]] == [[], []] and [r["b"] for r in got[1:]] == [[], []]


def plain_embed(tokens, dim):
    """Feature hashing by its definition, one document at a time."""
    out = np.zeros(dim)
    terms = Counter(tokens) + Counter(f"{a}_{b}" for a, b in zip(tokens, tokens[1:]))
    for term, tf in terms.items():
        h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")
        out[h % dim] += (1 if h >= 2**63 else -1) * (1 + math.log(tf))
    n = np.linalg.norm(out)
    return out / n if n else out


def test_hash_embedding_equals_definition(spark):
    docs = ["seven days of screen recording days", "", "a the", "one", "crème brûlée recipe recipe recipe"] * 3
    df = texts(spark, *docs)
    rows = df.select("i", X.tokenize(F.col("t")).alias("k"), X.hash_embed(X.tokenize(F.col("t")), 96).alias("e")).collect()
    for r in rows:
        assert np.allclose(r["e"], plain_embed(r["k"], 96), atol=1e-6)


@pytest.mark.parametrize("text,label", [
    ("i tested this for 7 days tutorial", 0), ("a step by step guide", 1), ("my glow up before", 2),
    ("stop doing this", 3), ("dont do it", 3), ("a day in my life", 4), ("tier list of snacks", 5),
    ("aftermath and guides", None), ("", None)])
def test_format_rules_first_match_wins(spark, text, label):
    want = X.DEFAULT_FORMAT[0] if label is None else X.FORMAT_RULES[label][1]
    name, beats = X.classify_format(F.col("t"))
    got = texts(spark, text).select(name.alias("n"), beats.alias("b")).first()
    assert got["n"] == want
    assert tuple(got["b"]) == (X.DEFAULT_FORMAT[1] if label is None else X.FORMAT_RULES[label][2])


def test_small_text_functions(spark):
    df = texts(spark, "  Héllo wörld. Next", "#Tag1 and #ünï_2 # x", "", "unknown", None)
    t = F.col("t")
    got = df.select(
        X.first_sentence(t, 5).alias("s"), X.extract_hashtags(t).alias("h"), X.useful(t).alias("u"),
        X.slugify(F.coalesce(t, F.lit(""))).alias("g")).collect()
    assert [r["s"] for r in got] == ["Héllo", "#Tag1", "", "unkno", ""]
    assert got[1]["h"] == ["Tag1", "ünï_2"]
    assert [r["u"] for r in got][2:] == ["", "", ""]
    assert [r["g"] for r in got] == ["h-llo-w-rld-next", "tag1-and-n-2-x", "trend", "unknown", "trend"]


def test_signature_recipes(spark):
    df = spark.createDataFrame(
        [("F", ["a", "b"], ["cut"], "unknown", None, "calm", "hook", "msg", "topic", "cap " * 200, ["#x", "y"]),
         ("F", ["a"], [], "unknown", "", "none", "hook", "", "topic", "c" * 500, ["#x", "y"])],
        "f string, n array<string>, e array<string>, v string, s string, m string, h string, mm string, t string, c string, g array<string>")
    sig = X.format_signature(*[F.col(c) for c in ("f", "n", "e", "v", "s", "m", "h", "mm", "t", "c", "g")])
    got = [r[0] for r in df.select(sig).collect()]
    assert got == ["F F a b a b hook cut calm msg topic", f"hook {'c' * 400} x y x y topic F"]


def test_heuristic_row(spark):
    df = spark.createDataFrame(
        [("Before and after! wow", ["GlowUp"], "", 45.0, None), (None, None, "food", 45.5, "song")],
        "caption string, hashtags array<string>, niche string, duration_sec double, sound_name string")
    a, b = X.heuristic_features(df).collect()
    assert (a["hook"], a["topic"], a["production_difficulty"], a["audio_style"]) == (
        "Before and after", "general content", "low", "original audio")
    assert (b["hook"], b["main_message"], b["topic"], b["production_difficulty"], b["audio_style"]) == (
        "(hook not recoverable from metadata)", "", "food content", "medium", "song")
    assert a["is_fallback"] and a["content_format"].startswith("before/after")


def test_parsers_never_fail(spark):
    df = texts(spark, "1700000000", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "soon", None)
    got = [r[0] for r in df.select(L.parse_event_time(F.col("t"), NOW)).collect()]
    assert got == [datetime(2023, 11, 14, 22, 13, 20), datetime(2024, 1, 2, 3, 4, 5),
                   datetime(2024, 1, 2, 1, 4, 5), NOW_DT, NOW_DT]
    nums = texts(spark, "12", "x", None, "-1", "12.5")
    assert [r[0] for r in nums.select(L.safe_int(F.col("t"))).collect()] == [12, 0, 0, -1, 0]
    spans = texts(spark, "PT58S", "PT1M30S", "P0D", "P1DT2H", "PT", "xPT5S", None)
    assert [r[0] for r in spans.select(L.parse_iso8601_duration(F.col("t"))).collect()] == [58, 90, 0, 93600, 0, 0, 0]


def land(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_provider_envelope(spark, tmp_path):
    path = land(tmp_path, "provider.jsonl", [
        {"items": [
            {"id": 1, "caption": "hi #One", "created_at": 1700000000, "views": 5, "duration": 9.5,
             "author": {"handle": "h", "followers": 10, "country": "DE", "language": "de"}},
            {"id": "2", "hashtags": ["x"], "created_at": "bad", "views": "n/a"}]},
        "{broken"])
    raw = L.read_landed(spark, path, "json", L.PROVIDER)
    assert raw.cache().filter("_corrupt_record is not null").count() == 1
    rows = N.normalise_provider(L.well_formed(raw), "tiktok", NOW, "food", "US").orderBy("external_id").collect()
    a, b = rows
    assert (a["external_id"], a["hashtags"], a["language"], a["country"], a["views"]) == ("1", ["One"], "de", "DE", 5)
    assert (b["creator"]["handle"], b["language"], b["country"], b["views"], b["hashtags"]) == ("unknown", "en", "US", 0, ["x"])
    assert b["published_at"] == NOW_DT and a["creator"]["followers"] == 10


def test_search_details_join_and_gate(spark, tmp_path):
    def video(i, length, views, channel="c1", **snippet):
        return {"id": i, "contentDetails": {"duration": length}, "statistics": {"viewCount": views},
                "snippet": {"channelId": channel, "channelTitle": "T", "publishedAt": "2024-02-28T00:00:00Z",
                            "title": "Title #no", "description": "Text #yes ", **snippet}}

    details = L.read_landed(spark, land(tmp_path, "d.jsonl", [
        video("v7", "PT7S", "1000000"), video("v8", "PT8S", "1000000", defaultAudioLanguage="pt-BR"),
        video("v90", "PT1M30S", "200000", "gone"), video("v91", "PT1M31S", "1000000"),
        video("slow", "PT20S", "900"), video("fast", "PT20S", "30000")]), "json", L.VIDEO_DETAILS)
    channels = L.read_landed(spark, land(tmp_path, "c.jsonl", [
        {"id": "c1", "snippet": {"customUrl": "@name", "country": "BR"}, "statistics": {"subscriberCount": "77"}}]),
        "json", L.CHANNELS)
    raw = N.normalise_youtube(L.well_formed(details), L.well_formed(channels), NOW, "ai", "US", "de")
    got = {r["external_id"]: r for r in P.quality_gate(raw, NOW, duration_cap=N.SHORTS_CAP_SECONDS).collect()}
    assert set(got) == {"v8", "v90", "fast"}
    assert (got["v8"]["language"], got["v8"]["creator"]["handle"], got["v8"]["creator"]["followers"]) == ("pt", "name", 77)
    assert (got["v90"]["language"], got["v90"]["creator"]["handle"], got["v90"]["likes"]) == ("de", "gone", 0)
    assert got["v8"]["caption"] == "Title #no\nText #yes" and got["v8"]["hashtags"] == ["yes"]


def test_actor_rows(spark, tmp_path):
    a = L.read_landed(spark, land(tmp_path, "a.jsonl", [
        {"id": "1", "text": "t", "createTimeISO": "2024-02-01T00:00:00Z", "playCount": "x", "diggCount": 3,
         "collectCount": 4, "textLanguage": "pt-BR", "authorMeta": {"uniqueId": "u", "fans": 9},
         "videoMeta": {"duration": 12, "originalCoverUrl": "o"}, "hashtags": [{"name": "n"}, {"name": ""}]},
        {"id": "2", "isSlideshow": True, "authorMeta": {"name": "s"}}, {"id": "3", "authorMeta": {}}]),
        "json", L.SHORT_VIDEO_ACTOR)
    (r,) = N.normalise_tiktok(L.well_formed(a), NOW, "food").collect()
    assert (r["url"], r["views"], r["likes"], r["saves"], r["language"], r["hashtags"], r["thumbnail_url"]) == (
        "https://www.tiktok.com/@u/video/1", 0, 3, 4, "pt", ["n"], "o")
    b = L.read_landed(spark, land(tmp_path, "b.jsonl", [
        {"type": "Image", "shortCode": "i"}, {"type": "Video"},
        {"type": "Video", "shortCode": "p", "caption": "c #t", "videoViewCount": 8, "likesCount": -1},
        {"type": "Video", "shortCode": "q", "videoPlayCount": 9, "videoViewCount": 8, "ownerUsername": "o"}]),
        "json", L.REEL_ACTOR)
    got = {r["external_id"]: r for r in N.normalise_instagram(L.well_formed(b), NOW).collect()}
    assert set(got) == {"p", "q"}
    assert (got["p"]["views"], got["p"]["hashtags"], got["p"]["creator"]["handle"]) == (8, ["t"], "unknown")
    assert (got["q"]["views"], got["q"]["url"]) == (9, "https://www.instagram.com/reel/q/")


def test_union_of_sources_skips_unconfigured(spark, tmp_path):
    path = land(tmp_path, "p.jsonl", [{"items": [{"id": "1", "author": {"handle": "h"}}]}])
    provider = L.well_formed(L.read_landed(spark, path, "json", L.PROVIDER))

    def missing(niche):
        raise R.NotConfigured("no landing folder")

    R.register_source("tiktok", lambda niche: N.normalise_provider(provider, "tiktok", NOW, niche))
    R.register_source("instagram", missing)
    rows, audit = R.multi_source_union(spark, ["tiktok", "instagram"], ["ai", "food"])
    assert sorted(r["niche"] for r in rows.collect()) == ["ai", "food"]
    assert audit.filter("skipped is not null").count() == 2
    ids = N.items_of(rows).select("item_id").distinct().count()
    assert ids == 1 and N.creators_of(rows).select("creator_id").distinct().count() == 1
    with pytest.raises(KeyError):
        R.get_source("nowhere")


def test_array_and_vector_functions(spark):
    df = spark.createDataFrame([(["AI", "Food"], ["food", "x"], [3.0, 4.0], [0.0, 0.0])],
                               "a array<string>, b array<string>, v array<double>, z array<double>")
    got = df.select(
        AR.array_contains_ci(F.col("a"), "ai"), AR.overlap(F.col("a"), F.col("b")),
        V.l2_normalize(F.col("v")), V.l2_normalize(F.col("z")), V.cosine(F.col("v"), F.col("z")),
        V.cosine(F.col("v"), F.col("v")), AR.ordered_distinct(F.array(*map(F.lit, "abac"))),
        AR.from_nested(AR.to_nested(F.col("a")), "array<string>")).first()
    assert list(got) == [True, ["food"], [0.6, 0.8], [0, 0], 0, 1, ["a", "b", "c"], ["AI", "Food"]]


def test_embed_many_falls_back_as_a_whole(spark):
    df = texts(spark, "alpha beta", "gamma", "poison").withColumnsRenamed({"i": "item_id", "t": "signature"})

    def good(batch):
        return [[float(len(t)), 1.0] for t in batch]

    def bad(batch):
        if any("poison" in t for t in batch):
            raise RuntimeError("provider down")
        return good(batch)

    assert [r["embedding"][0] for r in embed_many(df, encoder=good).orderBy("item_id").collect()] == [10, 5, 6]
    local = [r["embedding"] for r in embed_many(df, dim=32).orderBy("item_id").collect()]
    fell = [r["embedding"] for r in embed_many(df, encoder=bad, batch=1, dim=32).orderBy("item_id").collect()]
    assert fell == local and len(fell[0]) == 32


def test_enrichment_ladder(spark):
    df = texts(spark, "video", "meta", "none", "quota")

    def vision(row):
        if row["t"] == "quota":
            raise QuotaExhausted
        if row["t"] != "video":
            raise RuntimeError("cannot see")
        return {"label": "seen"}

    def metadata(row):
        return {"label": "read"} if row["t"] == "meta" else None

    tiers = [("vision", vision), ("metadata", metadata), ("heuristic", lambda row: {"label": "guess"})]
    keep, wait = split_deferred(enrich(df, tiers, "label string"))
    got = {r["t"]: (r["label"], r["tier"], r["fallback_reason"]) for r in keep.collect()}
    assert got == {"video": ("seen", "vision", None), "meta": ("read", "metadata", None),
                   "none": ("guess", "heuristic", "error")}
    assert [r["t"] for r in wait.collect()] == ["quota"]
    only = enrich(df, tiers[-1:], "label string").select("fallback_reason").distinct().collect()
    assert only == [("no_llm",)]


def test_sanitised_words_stay_plain():
    assert len(X.STOPWORDS) == len(set(X.STOPWORDS))
    assert all(re.fullmatch(r"[a-z]+", w) for w in X.STOPWORDS)
