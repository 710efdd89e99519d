"""The input tables, by name, from a folder of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name, whether one file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
