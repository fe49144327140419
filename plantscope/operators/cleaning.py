"""Roles, row filters, missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.functions import tokens
from plantscope.functions.numeric import all_of, any_of, clean
from plantscope.session import local_table, materialize


@dataclass(frozen=True)
class Roles:
    """One target and the variables that may explain it."""

    y: str
    x_numeric: tuple[str, ...] = ()
    x_categorical: tuple[str, ...] = ()

    @property
    def x(self) -> tuple[str, ...]:
        return self.x_categorical + self.x_numeric


@dataclass(frozen=True)
class HeaderRoles:
    roles: Roles
    renamed: Mapping[str, str] = field(default_factory=dict)


def numeric_columns(df: DataFrame, among: Sequence[str] | None = None) -> list[str]:
    wanted = list(among) if among is not None else df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in wanted if isinstance(kinds[c], T.NumericType)]


def gate_numeric(df: DataFrame, x: Sequence[str], at_least: int = 1) -> list[str]:
    """The numeric ones among ``x``; an error when too few are left."""
    kept = numeric_columns(df, x)
    if len(kept) < at_least:
        raise ValueError(f"{len(kept)} numeric explanatory columns, {at_least} needed")
    return kept


def select_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Keep the target and the chosen variables, target first."""
    if not roles.x:
        raise ValueError("choose at least one explanatory column")
    if roles.y in roles.x:
        raise ValueError("the target cannot explain itself")
    if roles.y not in numeric_columns(df):
        raise ValueError("the target must be numeric")
    return df.select(roles.y, *roles.x)


def roles_from_header(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> HeaderRoles | None:
    """Roles written into the header as ``(varY)`` and ``(varX)``; None when no target is marked."""
    targets = [c for c in df.columns if "(varY)" in c]
    if not targets:
        return None
    if len(targets) > 1:
        raise ValueError("only one column may be marked (varY)")
    if targets[0] not in numeric:
        raise ValueError("the (varY) column must be numeric")
    marked = [c for c in df.columns if "(varX)" in c]
    names = {targets[0]: targets[0].replace("(varY)", "").strip()}
    names.update({c: c.replace("(varX)", "").strip() for c in marked})
    return HeaderRoles(
        Roles(
            names[targets[0]],
            tuple(names[c] for c in marked if c in numeric),
            tuple(names[c] for c in marked if c in categorical),
        ),
        names,
    )


def apply_header_roles(df: DataFrame, found: HeaderRoles) -> DataFrame:
    return df.select(*[F.col(f"`{raw}`").alias(name) for raw, name in found.renamed.items()])


def normalize_boolean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rewrite to '0'/'1' the columns that hold nothing but yes/no marks; one pass decides for all."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    marks = {c: tokens.boolean_mark(F.col(f"`{c}`"), kinds[c]) for c in cols}
    verdict = df.agg(*[F.bool_and(tokens.is_boolean_mark(marks[c])).alias(c) for c in cols]).first()
    yes = {c for c in cols if verdict[c]}
    return df.select(
        *[tokens.boolean_digit(marks[c]).alias(c) if c in yes else F.col(f"`{c}`") for c in df.columns]
    )


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(cols) if cols else None)


def dropped_share(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows in, rows kept, percent removed, in one pass."""
    chosen = list(cols) if cols else df.columns
    whole = all_of([F.col(f"`{c}`").isNotNull() for c in chosen])
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(whole).alias("n_kept"))
    return counts.withColumn(
        "pct_removed", F.try_divide((F.col("n_rows") - F.col("n_kept")) * 100.0, F.col("n_rows"))
    )


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None, whole_numbers: bool = False) -> DataFrame:
    """Numeric NULLs to the column mean. One aggregate gives every mean.

    ``whole_numbers`` keeps integer columns integer by rounding the mean half to even.
    """
    chosen = numeric_columns(df, cols)
    if not chosen:
        return df
    means = df.agg(*[F.avg(clean(F.col(f"`{c}`"))).alias(c) for c in chosen]).first()
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def fill(name: str) -> Column:
        col = F.col(f"`{name}`")
        if name not in chosen or means[name] is None:
            return col
        if isinstance(kinds[name], T.IntegralType) and whole_numbers:
            return F.coalesce(col, F.lit(round(means[name])).cast(kinds[name])).alias(name)
        return F.coalesce(clean(col), F.lit(float(means[name]))).alias(name)

    return df.select(*[fill(c) for c in df.columns])


def complete_cases(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    """Target and numeric variables as doubles, rows with any of them missing dropped."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def number(name: str) -> Column:
        col = F.col(f"`{name}`")
        out = tokens.to_number(col) if isinstance(kinds[name], T.StringType) else clean(col)
        return out.alias(name)

    others = [c for c in df.columns if c != y and c not in x]
    out = df.select(*[F.col(f"`{c}`") for c in others], number(y), *[number(c) for c in x])
    return out.na.drop(subset=[y, *x])


def filter_categories(df: DataFrame, chosen: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Keep the listed values per column, all columns at once; None or an empty list means no limit."""
    return df.where(all_of([F.col(f"`{c}`").isin(list(v)) for c, v in chosen.items() if v]))


def category_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(f"`{col}`").alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def missing_report(df: DataFrame, y: str) -> DataFrame:
    """Per column: role, missing count, total, percent. One aggregate, then one row per column."""
    order = [y] + [c for c in df.columns if c != y]
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(order)]
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit("Y" if c == y else "X").alias("role"),
            F.col(f"m{i}").alias("n_missing"),
            F.col("_n").alias("n_rows"),
            F.try_divide(F.col(f"m{i}") * 100.0, F.col("_n")).alias("pct_missing"),
        )
        for i, c in enumerate(order)
    ]
    return wide.select(F.inline(F.array(*rows)))


def missing_stages(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cells per column and missingness stage; counts of zero included."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in cols]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column", tokens.missing_stage(F.col("cell")).alias("stage"))
        .agg(F.count(F.lit(1)).alias("n_cells"))
    )
    every = local_table(df.sparkSession, [(c, s) for c in cols for s in (1, 2, 3)], "column string, stage int")
    return every.join(counts, ["column", "stage"], "left").select(
        "column", "stage", F.coalesce("n_cells", F.lit(0)).alias("n_cells")
    )


def stage_mask(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The missingness stage of every cell, as one column per input column."""
    return df.select("*", *[tokens.missing_stage(F.col(f"`{c}`")).alias(f"{c}_stage") for c in cols])


def any_missing(cols: Sequence[str]) -> Column:
    return any_of([F.col(f"`{c}`").isNull() for c in cols])


def fill_forward(
    df: DataFrame, value: str, order_by: str, tie_break: Sequence[str] = (), default: float = 0.0,
    rows_per_bucket: int = 500_000,
) -> DataFrame:
    """Carry the last known value forward along ``order_by``; before the first one, ``default``.

    The rows are range-sorted by the key itself, of whatever type, into parts of bounded size, and written
    once; rows that agree in the key and in ``tie_break`` are ordered by their hash, so one key may fill several
    parts. The last value of each part is carried over a table with one row per part, and the rest happens inside parts.
    """
    parts = max(1, -(-df.count() // rows_per_bucket))
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    keys = [F.col(f"`{c}`") for c in (order_by, *tie_break)]
    ranged = df.withColumn("_hash", F.xxhash64(*hashed)).repartitionByRange(parts, *keys, "_hash").sortWithinPartitions(*keys, "_hash")
    placed = materialize(ranged.drop("_hash").withColumn("_place", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    known = F.col(f"`{value}`").isNotNull()
    last = placed.groupBy("_part").agg(F.max_by(F.when(known, F.col(f"`{value}`")), F.when(known, F.col("_place"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    carried = last.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_seen", F.last(F.col(f"`{value}`"), ignorenulls=True).over(inside))
        .join(carried, "_part", "left")
        .withColumn(value, F.coalesce("_seen", "_carry", F.lit(default)))
        .drop("_place", "_part", "_seen", "_carry")
    )
