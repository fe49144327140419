"""Input views shared by the registered queries, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.operators.cleaning import Roles
from plantscope.plans.catalog import table
from plantscope.session import local_table

Y = "charge"
X = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
CATS = ["l_returnflag", "l_linestatus"]
NUMERIC = [Y, *X]
ROLES = Roles(Y, tuple(X), tuple(CATS))
KEYS = ["l_orderkey", "l_linenumber"]

CHARGE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
PROCESS_SQL = f"select l_orderkey, l_linenumber, {CHARGE} as charge, {', '.join(X)}, {', '.join(CATS)} from lineitem"


def process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a process table: what is charged, and what may explain it."""
    return table(spark, sf_dir, "lineitem").select(*KEYS, F.expr(CHARGE).alias(Y), *X, *CATS)


_DIRT = ["#DIV/0!", "#N/A", " - ", "", "1,234.5"]
DIRTY = ["l_extendedprice", "l_quantity", "l_discount"]


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, with spreadsheet dirt by the order key."""
    place = F.col("l_orderkey") % 17

    def spoil(c: str):
        text = F.col(c).cast("string")
        out = F.when(place == 0, _DIRT[0])
        for i, word in enumerate(_DIRT[1:], start=1):
            out = out.when(place == i, word)
        return (
            out.when(place == 5, F.concat(F.lit("−"), text))
            .when(place == 6, F.concat(F.lit(" "), text, F.lit(" ")))
            .when(place == 7, "#SPILL!")
            .otherwise(text)
            .alias(c)
        )

    return process(spark, sf_dir).select(*KEYS, *[spoil(c) for c in DIRTY], "l_returnflag")


def _spoil_sql(c: str) -> str:
    cases = " ".join(f"when {i} then '{w}'" for i, w in enumerate(_DIRT))
    text = f"cast({c} as varchar)"
    return (
        f"case l_orderkey % 17 {cases} when 5 then chr(8722) || {text} when 6 then chr(160) || {text} || chr(160) "
        f"when 7 then '#SPILL!' else {text} end as {c}"
    )


DIRTY_SQL = f"select l_orderkey, l_linenumber, {', '.join(_spoil_sql(c) for c in DIRTY)}, l_returnflag from lineitem"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process table with missing taxes and quantities."""
    return (
        process(spark, sf_dir)
        .withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))
        .withColumn("l_quantity", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity")))
    )


GAPPY_SQL = (
    f"select l_orderkey, l_linenumber, {CHARGE} as charge, l_extendedprice, "
    "case when l_orderkey % 11 <> 0 then l_quantity end as l_quantity, l_discount, "
    f"case when l_orderkey % 7 <> 0 then l_tax end as l_tax, {', '.join(CATS)} from lineitem"
)

SHAPES = ["blend", "two_groups", "three_groups", "sparse_price", "l_discount", "right_tail"]
_SHAPE_EXPRS = {
    "blend": "l_quantity + l_discount * 500 + l_tax * 625",
    "two_groups": "l_quantity + l_discount * 500 + l_tax * 625 + 300 * (l_orderkey % 2)",
    "three_groups": "l_quantity + l_discount * 500 + l_tax * 625 + 300 * (l_orderkey % 3)",
    "sparse_price": "case when l_linenumber > 2 then 0.0 else l_extendedprice end",
    "l_discount": "l_discount",
    "right_tail": "1000000.0 / (l_quantity * l_quantity + 10)",
}
SHAPES_SQL = "select l_orderkey, " + ", ".join(f"{e} as {n}" for n, e in _SHAPE_EXPRS.items()) + " from lineitem"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of different shape: bell-like, two and three groups, mostly zero, discrete, long tail."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *[F.expr(e).cast("double").alias(n) for n, e in _SHAPE_EXPRS.items()]
    )


BANDED = ["charge_band", "price_band", "l_quantity", "l_discount", "l_tax"]
BANDED_SQL = (
    f"select floor({CHARGE} / 4000) as charge_band, floor(l_extendedprice / 4000) as price_band, "
    "l_quantity, l_discount, l_tax from lineitem"
)


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process table with the money columns in bands, so that few distinct pairs remain."""
    return process(spark, sf_dir).select(
        F.floor(F.col(Y) / 4000).cast("double").alias("charge_band"),
        F.floor(F.col("l_extendedprice") / 4000).cast("double").alias("price_band"),
        "l_quantity", "l_discount", "l_tax",
    )


TYPED = [
    "nothing", "yes_no", "whole_text", "real_text", "iso_date", "slash_time", "korean_date", "day_number", "event_type",
    "mostly_number", "note",
]
TYPED_SQL = """
select event_id, user_id, ts, value, cast(null as varchar) as nothing,
  case when event_id % 3 = 0 then 'O' when event_id % 3 = 1 then 'x' else ' 1 ' end as yes_no,
  cast(event_id * 7 as varchar) as whole_text, cast(value as varchar) as real_text,
  strftime(ts, '%Y-%m-%d') as iso_date, strftime(ts, '%Y/%m/%d %H:%M') as slash_time,
  strftime(ts, '%Y') || '년' || strftime(ts, '%m') || '월' || strftime(ts, '%d') || '일' as korean_date,
  cast(date_diff('day', date '1899-12-30', cast(ts as date)) as varchar) as day_number, event_type,
  case when event_id % 20 = 0 then 'broken' else cast(event_id as varchar) end as mostly_number,
  'note ' || cast(event_id as varchar) as note
from events"""


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a table of text columns, one per column class."""
    k = F.col("event_id")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1899-12-30").cast("date"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "value",
        F.lit(None).cast("string").alias("nothing"),
        F.when(k % 3 == 0, "O").when(k % 3 == 1, "x").otherwise(" 1 ").alias("yes_no"),
        (k * 7).cast("string").alias("whole_text"),
        F.col("value").cast("string").alias("real_text"),
        F.date_format("ts", "yyyy-MM-dd").alias("iso_date"),
        F.date_format("ts", "yyyy/MM/dd HH:mm").alias("slash_time"),
        F.date_format("ts", "yyyy'년'MM'월'dd'일'").alias("korean_date"),
        day.cast("string").alias("day_number"),
        "event_type",
        F.when(k % 20 == 0, "broken").otherwise(k.cast("string")).alias("mostly_number"),
        F.concat(F.lit("note "), k.cast("string")).alias("note"),
    )


SCENARIO_SCHEMA = (
    "scenario_id int, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string"
)
SCENARIO_ROWS = [
    (1, 30000.0, 25.0, 0.05, 0.04, "A"),
    (2, 90000.0, 49.0, 0.0, 0.08, "N"),
    (3, 1000.0, 1.0, 0.1, 0.0, "R"),
    (4, 55000.0, None, 0.02, 0.02, "N"),
    (5, 55000.0, 10.0, 0.07, None, None),
]


def _literal(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


SCENARIOS_SQL = (
    "select * from (values " + ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in SCENARIO_ROWS)
    + ") as s(scenario_id, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag)"
)


def scenarios(spark: SparkSession) -> DataFrame:
    """What-if inputs; an empty cell leaves that column out of the question."""
    return local_table(spark, SCENARIO_ROWS, SCENARIO_SCHEMA)
