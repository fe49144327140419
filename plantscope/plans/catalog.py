"""Registry of named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its equivalent on the same tables."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int] | int, *cols: str) -> DataFrame:
    """Round doubles for comparison; adding 0.0 turns -0.0 into 0.0."""
    wanted = digits if isinstance(digits, dict) else {c: digits for c in cols}
    return df.select(
        *[(F.round(F.col(c).cast("double"), wanted[c]) + 0.0).alias(c) if c in wanted else F.col(c) for c in df.columns]
    )


def r(expr: str, digits: int) -> str:
    """SQL counterpart of :func:`rounded`."""
    return f"round(cast({expr} as double), {digits}) + 0.0"
