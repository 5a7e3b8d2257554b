"""The corpus pipeline: each stage works on all that its predecessor kept.

The stages are written as Parquet below the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.bpe import digests, encode, public_vocabulary
from lexiloom.llm.common import table
from lexiloom.llm.decontam import clean
from lexiloom.llm.jaccard import one_of_each_class
from lexiloom.llm.pii import replace
from lexiloom.llm.quality import resample
from lexiloom.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones keeps."""
    return resample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents: word 5-grams, Jaccard 0.8."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of private data; n_chars follows the text."""
    return replace(docs, length="n_chars").drop("n_entities")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, and digests of the ids and of the text decoded from them."""
    return digests(encode(docs, public_vocabulary(), decoded=True))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("tokens", tokens),
]

# Gumbel noise, keyed surrogates and byte-pair merges have no SQL form; tests look at the rows of each stage instead, not at all five by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
