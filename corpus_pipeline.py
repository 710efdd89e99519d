"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Stages in between are written as Parquet in the shared folder and read again, in files of a sensible size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, language, minhash, mixing, packing
from tessella.llm.storage import sized, small_batches, written

#: Of all tokens that reach the mix, the part that it is given, and the power of their tokens by which domains, languages and
#: sources are weighed: below 1 it takes from the large for the small.
MIX_PART, MIX_POWER = 0.9, 0.7


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sized(language.accepted(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sized(exact_dedup.survivors(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sized(minhash.representatives(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sized(mixing.mixed(docs, MIX_PART, MIX_POWER))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sized(packing.pack(docs))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Language ID learns a model, and packing tokenises: neither is SQL. tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
