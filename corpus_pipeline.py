"""A training-data pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, and works on all that
the stage before kept. ``run`` writes what a stage returns to the shared folder and reads it again for
the next one. Null ids and texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.decontamination import without_contaminated
from clausewright.llm.packing import pack
from clausewright.llm.shared import written
from clausewright.llm.shingles import one_of_each
from clausewright.llm.substrings import without_repeats
from clausewright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network doesn't find toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of five-word shingles, Jaccard similarity 0.8 or more.

    Covering SimHash links what lies within its radius, confirmed by whole sets; an exact join adds what lies beyond.
    """
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their passages of 35 words or more that occur elsewhere; n_chars is counted anew."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express a trained network, nor fingerprints of XXH64; the tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
