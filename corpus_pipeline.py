"""From raw documents to packed training windows, one written table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from augspark.llm.mixing import apply_mix
from augspark.llm.packing import pack
from augspark.llm.queries import fold, small_batches, tokenizer_path
from augspark.llm.simhash import keep_one_per_group
from augspark.llm.suffix_dedup import without_repeats
from augspark.llm.toxicity import fit_toxicity, score_toxicity
from augspark.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below one half."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = fit_toxicity(docs, labels, usable=fold("_key", 5) != 0)
    # a name that no column of the documents has
    name = "_score" + "_" * max([0, *(len(c) for c in docs.columns)])
    return score_toxicity(docs, machine, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every SimHash component."""
    small_batches(spark)
    return keep_one_per_group(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that occur earlier."""
    small_batches(spark)
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens."""
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", simhash),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]
# Scores of a fitted machine, fingerprint trees and tokenizers are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
