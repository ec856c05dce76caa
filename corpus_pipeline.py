"""A training-data pipeline: five stages, each over all that its predecessor kept.

Rows with bad quality go, then repeated lines, near copies and contaminated documents; what is left is packed. Each stage
is a function of (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import decontamination, line_dedup, near_copies, packing, quality
from tracelode.llm._common import bitmap, bounded_batches, in_bitmap, scratch, stored
from tracelode.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage with bounded batches, whether run() or another caller goes through STAGES."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark, size="8m")
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (operator 3)."""
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, network, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


@bounded
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go (operator 4); n_chars follows the text."""
    return line_dedup.dedup_lines(docs, keep=["lang", "source"]).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near copies hold the same five-word shingles to 4/5 or more: operator 5's trees find most, a prefix filter the rest.
    Documents without an id stay; so do all rows of an id if one of them is its group's smallest. Documents that certainly
    stay do not move: a bitmap of the ids that go tells them from the others.
    """
    groups = near_copies.near_copies(docs)
    gone = stored(groups.groupBy("doc_id").agg(F.max("component_id").alias("kept")).where("kept < doc_id").select("doc_id"), "gone")
    marked, bits = docs.withColumn("id_hash", F.xxhash64("doc_id")), bitmap(gone.select(F.xxhash64("doc_id").alias("h")))
    perhaps = in_bitmap(marked, "id_hash", bits).join(gone.hint("merge"), "doc_id", "left_anti")
    return in_bitmap(marked, "id_hash", bits, "left_anti").select(*COLUMNS).unionByName(perhaps.select(*COLUMNS))


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go (operator 7), by row and text, so null and repeated ids are no exception."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs, benchmark, keep=["text", "lang", "source", "n_chars"])
    return found.where("not contaminated").select(*COLUMNS)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences (operator 10)."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier, fingerprints and a tokenizer are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
