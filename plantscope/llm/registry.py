"""Registry of the corpus queries and of the SQL that some of them must agree with."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "minhash", "token_counts", "quality", "secrets", "suffixes", "packing", "token_files", "warc", "vector_graph", "pieces",
    "collocations", "power_packing", "spelling",
)


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load():
    """This module, with every query module imported."""
    for name in MODULES:
        importlib.import_module(f"plantscope.llm.{name}")
    return sys.modules[__name__]
