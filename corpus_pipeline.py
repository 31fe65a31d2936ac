"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as Parquet
and reread as the next one's ``docs``; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tissuemill.functions.durable import scratch
from tissuemill.llm import mixing, near_copies, packing, pii, quality_rules


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rule and the learned rules keep."""
    return quality_rules.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Candidates come from SimHash fingerprints by deletion variants of their segments and are verified over whole
    shingle sets. At that similarity 64 bits are too few, so fingerprints are longer; the README gives figures.
    """
    return near_copies.drop_near_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned rules, near copies, contexts, tokens and packing are beyond SQL; tests/llm compare each operator with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows, written. Tables in between are deleted."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep_last:
        for name, stage in STAGES:
            with scratch(spark) as keep:
                write = keep_last if name == STAGES[-1][0] else keep
                out = write(stage(spark, out, sf_dir), "stage-" + name.replace(" ", "-"))
    return out
