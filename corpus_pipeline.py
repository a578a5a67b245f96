"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept, and returns a
DataFrame; ``run`` stores each result as Parquet on the shared storage and reads it again.

All stages take nulls in any column, empty and very long texts, repeated rows and empty tables (which give
empty results); columns beyond those of documents, whatever their names, pass through but for line dedup, which keeps
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formatpulse.llm import decontam, linededup, mixing, orderminhash, toxicity
from formatpulse.llm.common import table
from formatpulse.session import work_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go. Null and empty texts get the bias alone; repeated rows fare
    alike; without labels of both classes every score is 0.5 and all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that has no other line goes with them. Null and empty texts
    lose nothing and stay; a repeated row is a later copy of the first."""
    out = linededup.dedup_lines(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    gone = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~gone).drop("n_lines", "n_removed", "n_runs")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least doc_id (null first); of repeated rows one. Texts
    without a word all stay."""
    return orderminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles go, or all words of a shorter item in
    a row. Texts and items without a word match nothing; repeated rows fare alike."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities, with their weights. Documents without a word are not drawn; a null
    source or language is a value of its own; repeated rows draw alike."""
    return mixing.mix(docs).where("kept").drop("kept")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]

#: SQL cannot express the toxicity model, the alignment or the raking.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
