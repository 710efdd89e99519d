"""The queries of this subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.storage import sized

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ("sharding", "exact_dedup", "packing", "minhash", "language", "edit_prints", "warc", "chat", "mixing", "secret_scan")


def _in_few_files(query: Query) -> Query:
    """The query's result in no more tasks than it calls for, as whoever writes it gets a file of each."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sized(query(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in _MODULES:
        found |= {k: _in_few_files(q) for k, q in import_module(f"tessella.llm.{name}").QUERIES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _MODULES:
        found |= getattr(import_module(f"tessella.llm.{name}"), "SQL", {})
    return found
