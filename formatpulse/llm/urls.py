"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are fitted by Spark's own GBTClassifier on a bounded sample of labelled URLs: those a
rule decides, and those whose host holds a seed term. Everything runs on DataFrames in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formatpulse.llm.common import LOWER, UPPER

#: (rule, verdict): host, then the start of the path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: Host terms that mark a URL as unwanted in the training labels; the model itself never sees them.
SEEDS = ("ads", "casino", "spam")

FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels",
            "n_hyphens", "suffix_share", "suffix_block", "has_fragment", "https")

#: Documented bound of the training sample, in rows.
SAMPLE_ROWS = 20_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent domain and starts the path, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        out = F.when(fits, rule).otherwise(out)
    return out


def lexical(pages: DataFrame) -> DataFrame:
    """Adds host, path, rule and the features that need no corpus counts; ``pages`` has page_id, url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    one = pages.select("page_id", url.alias("__url"), host_of(url).alias("host"), path_of(url).alias("path"))
    one = one.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    size = F.greatest(F.length("__url"), F.lit(1))
    chars = F.split("__url", "")
    share = F.transform(F.array_distinct(chars), lambda c: (
        F.length("__url") - F.length(F.replace(F.col("__url"), c, F.lit("")))) / size)
    query = F.regexp_extract("__url", r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return one.select(
        "page_id", "host", "path", "rule",
        F.concat_ws(".", F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2),
                    F.get(F.split("path", "/"), F.lit(1))).alias("__suffix"),
        F.length("__url").cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.regexp_count("path", F.lit("[^/]+")).cast("double").alias("depth"),
        (F.regexp_count("__url", F.lit("[0-9]")) / size).alias("digit_ratio"),
        F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
                    ).alias("entropy"),
        F.regexp_count(query, F.lit("[^&]+")).cast("double").alias("n_params"),
        F.size(labels).cast("double").alias("n_labels"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("n_hyphens"),
        F.contains("__url", F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith("__url", F.lit("https:")).cast("double").alias("https"))


def labelled(urls: DataFrame, rules=RULES, seeds=SEEDS) -> Column:
    """1 block, 0 allow, null unknown: seed terms in the host first, then the rule's verdict."""
    verdict = F.lit(None).cast("double")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, float(said == "block")).otherwise(verdict)
    hit = F.lit(False)
    for seed in seeds:
        hit = hit | F.contains("host", F.lit(seed))
    return F.when(hit, 1.0).otherwise(verdict)


def featured(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """Lexical features and label, with the statistics of the suffix (domain and first path part):
    its share of all URLs and its smoothed share of block labels. Counts are reduced per suffix
    before the join, which Spark splits where a suffix is hot."""
    urls = lexical(pages)
    urls = urls.withColumn("label", labelled(urls, rules, seeds))
    stats = urls.groupBy("__suffix").agg(
        F.count("*").alias("__n"), F.count("label").alias("__known"), F.sum("label").alias("__bad"))
    total = stats.agg(F.sum("__n").alias("__all"), F.sum("__known").alias("__known_all"),
                      F.sum("__bad").alias("__bad_all"))
    prior = (F.coalesce("__bad_all", F.lit(0.0)) + 1) / (F.col("__known_all") + 2)
    stats = stats.crossJoin(F.broadcast(total)).select(  # one row of totals
        "__suffix", (F.col("__n") / F.col("__all")).alias("suffix_share"),
        ((F.coalesce("__bad", F.lit(0.0)) + 20 * prior) / (F.col("__known") + 20)).alias("suffix_block"))
    return urls.join(stats, "__suffix")


def fit_trees(known: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = 15, depth: int = 4,
              seed: int = 7):
    """The fitted model, or None where a class is missing. ``known`` has FEATURES and label; of
    more than ``sample_rows`` rows, a hash of the page id and features picks about that many."""
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    buckets = 1 << 20
    keep = min(buckets, int(buckets * sample_rows / sum(n.values())) + 1)
    rows = known.where(F.pmod(F.xxhash64("page_id", *FEATURES), F.lit(buckets)) < keep)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(rows)
    rows = rows.select("__features", "label").coalesce(4)
    return GBTClassifier(featuresCol="__features", labelCol="label", maxIter=trees, maxDepth=depth,
                         stepSize=0.3, maxBins=32, seed=seed).fit(rows)


def filter_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, threshold: float = 0.5,
                sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (probability of block).

    A null url, or one without ://, has empty host and path and goes to the model as it is.
    Repeated rows give repeated results; an empty table gives no rows; where the labels hold
    one class only, every unruled URL is allowed with score 0. Further columns are ignored.
    """
    rows = featured(pages.select("page_id", "url"), rules, seeds)
    model = fit_trees(rows.where(F.col("label").isNotNull()), sample_rows)
    if model is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(rows)
        rows = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
