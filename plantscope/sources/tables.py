"""Readers and writers: delimited text with spreadsheet habits, cleaned output, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.functions import tokens

# Encodings tried in turn; the last one can decode any byte.
ENCODINGS = ["utf-8", "cp949", "euc-kr", "latin1"]
_REPLACEMENT = "�"


def _reader(spark: SparkSession, encoding: str, multi_line: bool = True):
    if encoding not in ("utf-8", "latin1"):
        # Spark 4 accepts charsets beyond the Unicode ones only with this switch.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    charset = {"latin1": "ISO-8859-1", "cp949": "x-windows-949"}.get(encoding, encoding)
    return (
        spark.read.option("header", True)
        .option("encoding", charset)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", False)
        # as spreadsheets write it: doubled quotes and, with multi_line, line breaks inside quoted cells; a file is then read by
        # one task. Without it, large files are split across tasks and a quoted cell must stay on its line.
        .option("escape", '"')
        .option("multiLine", multi_line)
    )


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", multi_line: bool = True) -> DataFrame:
    """Header CSV as all-text columns with trimmed names; types are decided later, once.

    ``multi_line=False`` lets Spark split each file across tasks, for large files whose quoted cells hold no line breaks.
    """
    return trim_column_names(_reader(spark, encoding, multi_line).csv(path))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that decodes the whole file without a bad byte.

    Each candidate costs one scan that stops at the first bad cell. Header
    names are checked from the schema.
    """
    for encoding in ENCODINGS[:-1]:
        df = read_csv(spark, path, encoding)
        if any(_REPLACEMENT in c for c in df.columns):
            continue
        bad = F.array_contains(
            F.transform(F.array(*[F.col(f"`{c}`") for c in df.columns]), lambda v: F.contains(v, F.lit(_REPLACEMENT))),
            True,
        )
        if df.where(bad).isEmpty():
            return encoding
    return ENCODINGS[-1]


def read_csv_any_encoding(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    encoding = detect_encoding(spark, path)
    return read_csv(spark, path, encoding), encoding


def apply_parse_nulls(df: DataFrame) -> DataFrame:
    """Missing words of the CSV parser to NULL in every text column."""
    return df.select(
        *[
            tokens.parse_nulls(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def apply_null_tokens(df: DataFrame) -> DataFrame:
    """Trim every text column and turn null words into NULL."""
    return df.select(
        *[
            tokens.null_tokens(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def cleaned_name(source_name: str) -> str:
    """Output name of the cleaned table: spreadsheet suffix dropped, ``_cleaned.csv`` added."""
    base = source_name.rsplit(".", 1)[0] if source_name.endswith((".csv", ".xlsx")) else source_name
    return f"{base}_cleaned.csv"


def write_cleaned(df: DataFrame, folder: str, source_name: str, mode: str = "errorifexists") -> str:
    """Write the cleaned table as UTF-8 CSV part files with a header; returns the path."""
    path = f"{folder.rstrip('/')}/{cleaned_name(source_name)}"
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive signature of the rows: decimal sum of row hashes, and the row count."""
    chosen = [F.col(f"`{c}`") for c in (cols or df.columns)]
    row_hash = F.xxhash64(*chosen).cast("decimal(38,0)")
    return df.agg(F.sum(row_hash).cast("string").alias("signature"), F.count(F.lit(1)).alias("n_rows"))


def preview(df: DataFrame, date_columns: Sequence[str], n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows in a named order, date columns in front."""
    rest = [c for c in df.columns if c not in date_columns]
    return df.orderBy(*order_by).limit(n).select(*date_columns, *rest)
