"""Ranks of every row in several columns, without a global window.

A column is compressed to one row per distinct value with its count. Distinct
values are cut into buckets, running sums are taken inside a bucket, and the
bucket totals (at most ``MAX_BUCKETS`` rows) are added back. The result is
joined to the rows on the value; values held by very many rows are salted.

One scan over the rows sizes everything; a second, only for columns with very
many values, finds cut points and hot values of all columns together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 2048
BROADCAST_ROWS = 2_000_000  # over all columns together, some 100 bytes a row
HOT_SHARE = 0.01
SALTS = 64


@dataclass(frozen=True)
class ColumnSizes:
    """What one aggregate over the rows tells about the columns."""

    n: int
    filled: dict[str, int]
    mean: dict[str, float]
    total: dict[str, float]
    distinct: dict[str, int]

    @property
    def missing(self) -> bool:
        return any(k < self.n for k in self.filled.values())


def column_sizes(df: DataFrame, cols: Sequence[str]) -> ColumnSizes:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        aggs += [
            F.count(col).alias(f"f{i}"), F.avg(col).alias(f"m{i}"), F.sum(col).alias(f"t{i}"),
            F.approx_count_distinct(col, 0.05).alias(f"d{i}"),
        ]
    row = df.agg(*aggs).first()

    def read(letter: str, default=0):
        return {c: row[f"{letter}{i}"] if row[f"{letter}{i}"] is not None else default for i, c in enumerate(cols)}

    # The sketch may fall short by some percent; the margin keeps it an upper bound in practice.
    distinct = {c: min(int(d * 1.2) + 1, row["n"]) for c, d in read("d").items()}
    return ColumnSizes(row["n"], read("f"), read("m", 0.0), read("t", 0.0), distinct)


def _cut_points(
    df: DataFrame, cols: Sequence[str], sizes: ColumnSizes, rows_per_bucket: int
) -> dict[str, list[float]]:
    wide = [c for c in cols if sizes.distinct[c] > rows_per_bucket]
    if not wide:
        return {}
    pieces = min(MAX_BUCKETS, max(-(-sizes.distinct[c] // rows_per_bucket) for c in wide))
    found = df.approxQuantile(wide, [i / pieces for i in range(1, pieces)], 0.2 / pieces)
    return {c: sorted(set(cuts)) for c, cuts in zip(wide, found)}


def _hot_values(df: DataFrame, cols: Sequence[str], floor: int) -> dict[str, list[float]]:
    """Values held by at least ``floor`` rows, all columns in one pre-aggregated pass."""
    if not cols:
        return {}
    tagged = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    rows = (
        df.select(F.inline(tagged))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("ties"))
        .where(F.col("ties") >= floor)
        .collect()  # at most n / floor values per column
    )
    out: dict[str, list[float]] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append(r["value"])
    return out


def value_ladder(df: DataFrame, col: str, cuts: Sequence[float] = ()) -> DataFrame:
    """One row per distinct value: ``value, ties, below, sum_below`` (rows and sum of smaller values)."""
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    if not cuts:
        order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            "value", "ties",
            F.coalesce(F.sum("ties").over(order), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.col("ties") * F.col("value")).over(order), F.lit(0.0)).alias("sum_below"),
        )
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="value", outputCol="bucket").transform(counts)
    totals = bucketed.groupBy("bucket").agg(F.sum("ties").alias("n"), F.sum(F.col("ties") * F.col("value")).alias("s"))
    # One row per bucket, at most MAX_BUCKETS of them.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s0"),
    )
    inside = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return bucketed.join(F.broadcast(offsets), "bucket").select(
        "value",
        "ties",
        (F.col("n0") + F.coalesce(F.sum("ties").over(inside), F.lit(0))).alias("below"),
        (F.col("s0") + F.coalesce(F.sum(F.col("ties") * F.col("value")).over(inside), F.lit(0.0))).alias("sum_below"),
    )


def _join_by_value(df: DataFrame, table: DataFrame, col: str, small: bool, hot: Sequence[float]) -> DataFrame:
    """Join a one-row-per-value table on ``col``.

    A table of checked size is broadcast. Otherwise hot values are spread over
    salts, and their table rows repeated once per salt.
    """
    if small:
        return df.join(F.broadcast(table), F.col(col) == F.col("value"), "left").drop("value")
    if not hot:
        return df.join(table, F.col(col) == F.col("value"), "left").drop("value")
    every_salt = F.sequence(F.lit(0), F.lit(SALTS - 1))
    spread = table.withColumn(
        "_salt", F.explode(F.when(F.col("value").isin(list(hot)), every_salt).otherwise(F.array(F.lit(0))))
    )
    own_salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int")
    salted = df.withColumn("_own", F.when(F.col(col).isin(list(hot)), own_salt).otherwise(0))
    return salted.join(
        spread, (F.col(col) == F.col("value")) & (F.col("_own") == F.col("_salt")), "left"
    ).drop("value", "_salt", "_own")


def with_order_statistics(
    df: DataFrame, cols: Sequence[str], sizes: ColumnSizes | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
    broadcast_rows: int = BROADCAST_ROWS, hot_rows: int | None = None,
) -> DataFrame:
    """Adds per column ``<c>_rank`` (average rank) and ``<c>_spread`` (sum of distances to all rows).

    The columns must be complete (no NULL).
    """
    sizes = sizes or column_sizes(df, cols)
    n = sizes.n
    cuts = _cut_points(df, cols, sizes, rows_per_bucket)
    large, room = [], broadcast_rows
    for c in sorted(cols, key=sizes.distinct.get):
        room -= sizes.distinct[c]
        if room < 0:
            large.append(c)
    # At most 1 / HOT_SHARE values can reach the floor.
    hot = _hot_values(df, large, hot_rows or max(1000, int(n * HOT_SHARE)))
    out = df
    for c in cols:
        ladder = value_ladder(df, c, cuts.get(c, ()))
        out = _join_by_value(out, ladder, c, c not in large, hot.get(c, ()))
        below, ties, value = F.col("below"), F.col("ties"), F.col(c)
        above = F.lit(n) - below - ties
        sum_above = F.lit(float(sizes.total[c])) - F.col("sum_below") - ties * value
        out = (
            out.withColumn(f"{c}_rank", below + (ties + 1) / 2)
            .withColumn(f"{c}_spread", value * below - F.col("sum_below") + sum_above - value * above)
            .drop("below", "ties", "sum_below")
        )
    return out
