"""Column classes from evidence gathered in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.functions import tokens
from plantscope.session import local_table

# Every non-null cell must match one of these in full.
DATE_PATTERNS = [
    r"^\d{4}-\d{1,2}-\d{1,2}$",
    r"^\d{4}/\d{1,2}/\d{1,2}$",
    r"^\d{4}\.\d{1,2}\.\d{1,2}$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$",
    r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}$",
]

# Prefixes that mark looser dates.
LOOSE_DATE_PATTERNS = [
    r"^\d{4}년\d{1,2}월\d{1,2}일",
    r"^\d{4}.\d{1,2}.\d{1,2}",
    r"^\d{1,2}/\d{1,2}/\d{2,4}",
]

# Spreadsheet day numbers taken for dates.
SERIAL_RANGE = (42000, 48000)
TIME_WORDS = ["time", "date", "timestamp", "datetime"]
CATEGORY_SHARE = 0.1
NUMERIC_SHARE = 0.90


def physical_class(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "real"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.StringType):
        return "text"
    return "other"


def evidence(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column with the counts and tests the class rules read; one pass over the data.

    Cells become (column, text, mark) rows that are aggregated where they are;
    a few rows per task and column reach the shuffle. This keeps the generated
    code small however many columns there are.
    """
    chosen = list(cols) if cols else df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells, names = [], []
    for i, name in enumerate(chosen):
        col, shape = F.col(f"`{name}`"), physical_class(kinds[name])
        marked = shape in ("integer", "real", "text")
        mark = tokens.boolean_mark(col, shape != "text") if marked else F.lit(None)
        cells.append(
            F.struct(
                F.lit(i).alias("position"), col.isNotNull().alias("filled"),
                (col if shape == "text" else F.lit(None)).cast("string").alias("text"),
                mark.cast("string").alias("mark"),
            )
        )
        names.append(F.struct(F.lit(name).alias("column"), F.lit(shape).alias("physical")))
    text, number = F.col("text"), tokens.to_number(F.col("text"))
    digits = text.rlike(r"^\d+$")

    def every(test: Column) -> Column:
        return F.coalesce(F.bool_and(test), F.lit(False))

    def one_of(patterns: Sequence[str]) -> Column:
        return F.greatest(*[every(text.rlike(p)) for p in patterns])

    known = F.element_at(F.array(*names), F.col("position") + 1)
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("filled").alias("n_filled"),
            every(tokens.is_boolean_mark(F.col("mark"))).alias("all_marks"),
            F.count(number).alias("n_numbers"),
            F.coalesce(F.bool_or(number % 1 != 0), F.lit(False)).alias("any_fraction"),
            one_of(DATE_PATTERNS).alias("one_date_pattern"),
            one_of(LOOSE_DATE_PATTERNS).alias("one_loose_pattern"),
            every(digits).alias("all_digits"),
            every(digits & F.coalesce(text.try_cast("double").between(*SERIAL_RANGE), F.lit(False))).alias("all_serial"),
            F.approx_count_distinct(text, 0.02).alias("about_distinct"),
        )
        .select("position", known["column"].alias("column"), known["physical"].alias("physical"), "*")
        .drop("position")
        .withColumn("position", F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col("column")).cast("int") - 1)
    )


def exact_distinct(df: DataFrame, col: str) -> int:
    """Distinct non-null values, counted through a pre-aggregated shuffle."""
    return df.where(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`")).agg(F.lit(1)).count()


def column_classes(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    category_share: float = CATEGORY_SHARE,
    serial_dates_first: bool = False,
    identifiers_first: bool = False,
) -> DataFrame:
    """Class of every column: main and sub class, and whether it counts as numeric.

    All-digit text is numeric unless one of the two options moves the day-number
    or identifier test ahead of the numeric test. Distinct counts are sketched in
    the shared pass; only a column whose distinct share comes within a fifth of
    the limit is counted again exactly.
    """
    found = [r.asDict() for r in evidence(df, cols).collect()]  # one row per column
    for row in found:
        share = row["about_distinct"] / row["n_filled"] if row["n_filled"] else 0.0
        text = row["physical"] == "text" and row["n_filled"] > 0
        near = text and abs(share - category_share) < 0.2 * category_share
        row["n_distinct"] = exact_distinct(df, row["column"]) if near else row["about_distinct"]
    schema = (
        "position int, column string, physical string, n long, n_filled long, all_marks boolean, n_numbers long,"
        "any_fraction boolean, one_date_pattern boolean, one_loose_pattern boolean, all_digits boolean,"
        "all_serial boolean, about_distinct long, n_distinct long"
    )
    names = [part.split()[0] for part in schema.split(",")]
    table = local_table(df.sparkSession, [tuple(r[k] for k in names) for r in found], schema)
    return classify(table, category_share, serial_dates_first, identifiers_first)


def classify(
    table: DataFrame, category_share: float = CATEGORY_SHARE, serial_dates_first: bool = False,
    identifiers_first: bool = False,
) -> DataFrame:
    text = F.col("physical") == "text"
    filled = F.col("n_filled")
    sub = F.when(filled == 0, "empty").when(F.col("all_marks"), "boolean").when(~text, F.col("physical"))
    if serial_dates_first:
        sub = sub.when(F.col("all_serial"), "date")
    if identifiers_first:
        sub = sub.when(F.col("all_digits"), "identifier")
    sub = (
        sub.when(
            F.try_divide(F.col("n_numbers"), filled) >= NUMERIC_SHARE,
            F.when(F.col("any_fraction"), "real").otherwise("integer"),
        )
        .when(F.col("one_date_pattern") | F.col("all_serial") | F.col("one_loose_pattern"), "date")
        .when(F.try_divide(F.col("n_distinct"), filled) < category_share, "category")
        .when(F.col("all_digits"), "identifier")
        .otherwise("text")
    )
    main = (
        F.when(F.col("sub_category") == "empty", "empty")
        .when(F.col("sub_category").isin("integer", "real"), "numeric")
        .when(F.col("sub_category").isin("date", "datetime"), "date")
        .when(F.col("sub_category") == "other", "other")
        .otherwise("categorical")
    )
    return table.withColumn("sub_category", sub).select(
        "position",
        "column",
        main.alias("main_category"),
        "sub_category",
        main.eqNullSafe("numeric").alias("is_numeric"),
        "n",
        (F.col("n") - F.col("n_filled")).alias("n_null"),
    )


def class_summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("main_category").agg(F.count(F.lit(1)).alias("n_columns"))


def cast_by_class(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Cast numeric-labelled text once, so label and physical type agree."""
    labels = {r["column"]: r for r in classes.collect()}  # one row per column
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def typed(name: str) -> Column:
        col, label = F.col(f"`{name}`"), labels.get(name)
        if label is None:
            return col
        if isinstance(kinds[name], T.StringType) and label["is_numeric"]:
            number = tokens.to_number(col)
            if label["sub_category"] == "integer":  # digits beyond what a double holds stay exact
                number = F.coalesce(tokens.plain_text(col).try_cast("bigint"), number.try_cast("bigint"))
            return number.alias(name)
        if label["sub_category"] == "boolean" and not isinstance(kinds[name], T.BooleanType):
            return tokens.boolean_digit(
                tokens.boolean_mark(col, isinstance(kinds[name], T.NumericType))
            ).alias(name)
        return col

    return df.select(*[typed(c) for c in df.columns])


def serial_to_date(col: Column) -> Column:
    """Spreadsheet day number to a date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), col.try_cast("int"))


def pick_time_column(df: DataFrame) -> str | None:
    """First datetime column, else the first column named like a time when at least half of it parses."""
    for f in df.schema.fields:
        if physical_class(f.dataType) == "datetime":
            return f.name
    named = [c for c in df.columns if any(w in c.lower() for w in TIME_WORDS)]
    if not named:
        return None
    first = named[0]
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.try_to_timestamp(F.col(f"`{first}`").cast("string"))).alias("parsed")
    ).first()
    return first if counts["parsed"] >= max(3, int(0.5 * counts["n"])) else None


def narrowing_candidates(df: DataFrame, used: Sequence[str], top: int = 5, most: int = 30) -> DataFrame:
    """Unused non-numeric columns with 2 to ``most`` distinct values, fewest first.

    A sketch rules out the clearly large ones in one pass; the rest, at most a
    few dozen values each, are counted exactly.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in df.schema.fields}
    open_cols = [c for c in df.columns if c not in set(used) and not isinstance(kinds[c], T.NumericType)]
    rows: list[tuple[str, int, int]] = []
    if open_cols:
        sketch = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias(f"a{i}") for i, c in enumerate(open_cols)]).first()
        for i, c in enumerate(open_cols):
            if sketch[i] > most * 2:
                continue
            exact = exact_distinct(df, c)
            if 2 <= exact <= most:
                rows.append((c, exact, i))
    table = local_table(spark, rows, "column string, n_distinct long, position int")
    return table.orderBy("n_distinct", "position").limit(top).select("column", "n_distinct")
