"""Queries: reading, cleaning, column classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.functions import tokens
from plantscope.operators import cleaning, profile
from plantscope.plans import views
from plantscope.plans.catalog import query, r, rounded, table
from plantscope.plans.views import CATS, DIRTY, DIRTY_SQL, GAPPY_SQL, KEYS, NUMERIC, PROCESS_SQL, ROLES, TYPED, TYPED_SQL, X, Y
from plantscope.session import scratch_path
from plantscope.sources import tables

# --- SQL fragments -----------------------------------------------------------------------------


def _words(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"


def _null_tokens(c: str) -> str:
    words = _words([w.lower() for w in tokens.NULL_WORDS])
    return f"case when {_trim(c)} = '' or lower({_trim(c)}) in ({words}) then null else {_trim(c)} end"


def _number(c: str) -> str:
    text = f"replace(replace({_trim(c)}, ',', ''), chr(8722), '-')"
    return (
        f"case when regexp_full_match({text}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
        f"then try_cast({text} as double) end"
    )


def _lenient(c: str) -> str:
    text = f"replace(replace(replace({_trim(c)}, ',', ''), ' ', ''), chr(160), '')"
    one = f"case when length({text}) - length(replace({text}, '.', '')) > 1 then replace({text}, '.', '') else {text} end"
    digits = f"regexp_replace({one}, '[^0-9.\\-]', '', 'g')"
    return f"case when regexp_full_match({digits}, '-?(\\d+\\.?\\d*|\\.\\d+)') then try_cast({digits} as double) end"


def _stage(c: str) -> str:
    cases = " ".join(f"when lower({_trim(c)}) in ({_words(w)}) then {s}" for s, w in tokens.STAGE_WORDS.items())
    return f"case when {c} is null then 1 {cases} else 0 end"


_CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# --- sources -------------------------------------------------------------------------------------


@query(
    "csv_scan",
    "select o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice, o_orderpriority from orders",
)
def csv_scan(spark, sf):
    path = scratch_path(spark, "orders-csv")
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    table(spark, sf, "orders").select(*cols).write.options(**_CSV).csv(path)
    return tables.read_csv(spark, path).select(
        F.col("o_orderkey").try_cast("bigint").alias("o_orderkey"), "o_orderstatus",
        F.round(F.col("o_totalprice").try_cast("double"), 2).alias("o_totalprice"), "o_orderpriority",
    )


@query(
    "csv_encoding_fallback",
    "select 'cp949' as encoding, count(*) as n_rows, sum(case when o_orderpriority like '%URGENT%' then 1 else 0 end)::bigint "
    "as n_urgent from orders",
)
def csv_encoding_fallback(spark, sf):
    path = scratch_path(spark, "orders-korean")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    korean = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("번호"), F.concat(F.lit("공정 "), F.col("o_orderpriority")).alias("우선순위")
    )
    korean.write.options(**_CSV, encoding="EUC-KR").csv(path)
    df, encoding = tables.read_csv_any_encoding(spark, path)
    urgent = F.col("우선순위").startswith("공정") & F.col("우선순위").contains("URGENT")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(urgent).alias("n_urgent")).select(
        F.lit(encoding).alias("encoding"), "n_rows", "n_urgent"
    )


@query("csv_thousands_and_space", "select o_orderkey, round(o_totalprice, 2) as o_totalprice from orders")
def csv_thousands_and_space(spark, sf):
    path = scratch_path(spark, "orders-marks")
    table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.lit("  "), F.format_number("o_totalprice", 2)).alias("o_totalprice"),
    ).write.options(**_CSV).csv(path)
    return tables.read_csv(spark, path).select(
        F.col("o_orderkey").try_cast("bigint").alias("o_orderkey"),
        F.round(tokens.to_number(F.col("o_totalprice")), 2).alias("o_totalprice"),
    )


@query(
    "parse_time_nulls",
    f"with d as ({DIRTY_SQL}) select l_orderkey, l_linenumber, "
    + ", ".join(
        f"case when ltrim({c}, ' ') in ({_words(tokens.PARSE_WORDS)}) then null else ltrim({c}, ' ') end as {c}" for c in DIRTY
    )
    + " from d",
)
def parse_time_nulls(spark, sf):
    path = scratch_path(spark, "dirty-csv")
    views.dirty(spark, sf).select(*KEYS, *DIRTY).write.options(**_CSV).csv(path)
    read = tables.apply_parse_nulls(tables.read_csv(spark, path))
    return read.select(
        F.col("l_orderkey").try_cast("bigint").alias("l_orderkey"), F.col("l_linenumber").try_cast("int").alias("l_linenumber"), *DIRTY
    )


@query("trim_column_names", "select n_nationkey as \"nation key\", n_name as name from nation")
def trim_column_names(spark, sf):
    raw = table(spark, sf, "nation").select(F.col("n_nationkey").alias("  nation key "), F.col("n_name").alias("name\t"))
    return tables.trim_column_names(raw)


@query("cleaned_csv_sink", f"with g as ({GAPPY_SQL}) select l_orderkey, round(l_tax, 2) as l_tax from g where l_tax is not null")
def cleaned_csv_sink(spark, sf):
    clean = cleaning.drop_null_rows(views.gappy(spark, sf).select("l_orderkey", "l_tax"))
    path = tables.write_cleaned(clean, scratch_path(spark, "sink"), "plant.xlsx")
    return tables.read_csv(spark, path).select(
        F.col("l_orderkey").try_cast("bigint").alias("l_orderkey"), F.round(F.col("l_tax").try_cast("double"), 2).alias("l_tax")
    )


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf):
    return tables.fingerprint(views.process(spark, sf), NUMERIC)


@query(
    "schema_and_preview",
    "select l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_returnflag from lineitem "
    "order by l_orderkey, l_linenumber, l_extendedprice, l_shipdate limit 20",
)
def schema_and_preview(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    return tables.preview(df, ["l_shipdate"], 20, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"])


# --- cleaning ------------------------------------------------------------------------------------


@query(
    "normalize_null_tokens",
    f"with d as ({DIRTY_SQL}) select l_orderkey, l_linenumber, "
    + ", ".join(f"{_null_tokens(c)} as {c}" for c in DIRTY) + ", l_returnflag from d",
)
def normalize_null_tokens(spark, sf):
    return tables.apply_null_tokens(views.dirty(spark, sf))


@query(
    "classify_missing_stages",
    f"with d as ({DIRTY_SQL}), s as ("
    + " union all ".join(f"select '{c}' as \"column\", {_stage(c)} as stage from d" for c in DIRTY)
    + '), w as (select * from (values ' + ", ".join(f"('{c}')" for c in DIRTY)
    + ') a("column"), (values (1), (2), (3)) b(stage)) '
    'select w."column", w.stage, count(s.stage) as n_cells from w left join s using ("column", stage) group by all',
)
def classify_missing_stages(spark, sf):
    return cleaning.missing_stages(views.dirty(spark, sf), DIRTY)


@query(
    "missing_stage_mask",
    f"with d as ({DIRTY_SQL}) select l_orderkey, l_linenumber, " + ", ".join(f"{_stage(c)} as {c}_stage" for c in DIRTY) + " from d",
)
def missing_stage_mask(spark, sf):
    return cleaning.stage_mask(views.dirty(spark, sf), DIRTY).select(*KEYS, *[f"{c}_stage" for c in DIRTY])


@query(
    "coerce_numeric",
    f"with d as ({DIRTY_SQL}) select l_orderkey, l_linenumber, " + ", ".join(f"{_number(c)} as {c}" for c in DIRTY) + " from d",
)
def coerce_numeric(spark, sf):
    return views.dirty(spark, sf).select(*KEYS, *[tokens.to_number(F.col(c)).alias(c) for c in DIRTY])


_MESSY = "case when l_orderkey % 4 = 0 then '1.234.567' when l_orderkey % 4 = 1 then {c} || ' kg' else {c} end"


@query(
    "coerce_numeric_lenient",
    f"with d as ({DIRTY_SQL}), m as (select l_orderkey, l_linenumber, {_MESSY.format(c='l_extendedprice')} as raw from d) "
    f"select l_orderkey, l_linenumber, {_lenient('raw')} as number from m",
)
def coerce_numeric_lenient(spark, sf):
    place, c = F.col("l_orderkey") % 4, F.col("l_extendedprice")
    raw = F.when(place == 0, "1.234.567").when(place == 1, F.concat(c, F.lit(" kg"))).otherwise(c)
    return views.dirty(spark, sf).select(*KEYS, tokens.to_number_lenient(raw).alias("number"))


@query(
    "normalize_boolean",
    f"with t as ({TYPED_SQL}) select event_id, case when upper(trim(yes_no)) in ('O', '1') then '1' else '0' end as yes_no, "
    "event_type from t",
)
def normalize_boolean(spark, sf):
    df = views.typed(spark, sf).select("event_id", "yes_no", "event_type")
    return cleaning.normalize_boolean(df, ["yes_no", "event_type"])


@query("select_roles", f"select charge, l_returnflag, l_linestatus, {', '.join(X)} from ({PROCESS_SQL})")
def select_roles(spark, sf):
    return cleaning.select_roles(views.process(spark, sf), ROLES)


@query("infer_roles_from_header", f'select charge as "Charge", l_extendedprice as "Price", l_returnflag as "Flag" from ({PROCESS_SQL})')
def infer_roles_from_header(spark, sf):
    df = views.process(spark, sf).select(
        F.col("charge").alias("Charge (varY)"), F.col("l_extendedprice").alias("Price (varX)"),
        F.col("l_returnflag").alias(" Flag (varX) "), F.col("l_tax").alias("unused"),
    )
    df = tables.trim_column_names(df)
    numeric = cleaning.numeric_columns(df)
    found = cleaning.roles_from_header(df, numeric, [c for c in df.columns if c not in numeric])
    return cleaning.apply_header_roles(df, found)


@query("gate_numeric_columns", f"select {', '.join(X)} from ({PROCESS_SQL})")
def gate_numeric_columns(spark, sf):
    df = views.process(spark, sf)
    return df.select(*cleaning.gate_numeric(df, [*X, *CATS], at_least=2))


@query("drop_null_rows", f"select * from ({GAPPY_SQL}) where l_tax is not null and l_quantity is not null")
def drop_null_rows(spark, sf):
    return cleaning.drop_null_rows(views.gappy(spark, sf))


@query(
    "dropped_share",
    "select count(*) as n_rows, count(*) filter (where l_tax is not null and l_quantity is not null) as n_kept, "
    + r("(count(*) - count(*) filter (where l_tax is not null and l_quantity is not null)) * 100.0 / count(*)", 8)
    + f" as pct_removed from ({GAPPY_SQL})",
)
def dropped_share(spark, sf):
    return rounded(cleaning.dropped_share(views.gappy(spark, sf)), 8, "pct_removed")


@query(
    "impute_mean",
    f"with g as ({GAPPY_SQL}) select l_orderkey, l_linenumber, "
    + r("coalesce(l_quantity, (select avg(l_quantity) from g))", 8) + " as l_quantity, "
    + r("coalesce(l_tax, (select avg(l_tax) from g))", 8) + " as l_tax from g",
)
def impute_mean(spark, sf):
    filled = cleaning.impute_mean(views.gappy(spark, sf), ["l_quantity", "l_tax"])
    return rounded(filled.select(*KEYS, "l_quantity", "l_tax"), 8, "l_quantity", "l_tax")


@query(
    "complete_cases_xy",
    f"with d as ({DIRTY_SQL}), n as (select l_orderkey, l_linenumber, {_number('l_extendedprice')} as l_extendedprice, "
    f"{_number('l_quantity')} as l_quantity, {_number('l_discount')} as l_discount from d) "
    "select * from n where l_extendedprice is not null and l_quantity is not null and l_discount is not null",
)
def complete_cases_xy(spark, sf):
    df = views.dirty(spark, sf).drop("l_returnflag")
    return cleaning.complete_cases(df, "l_extendedprice", ["l_quantity", "l_discount"])


@query("filter_categories", f"select * from ({PROCESS_SQL}) where l_returnflag in ('A', 'R')")
def filter_categories(spark, sf):
    return cleaning.filter_categories(views.process(spark, sf), {"l_returnflag": ["A", "R"], "l_linestatus": None})


@query("category_values", f"select distinct l_returnflag as value from ({PROCESS_SQL})")
def category_values(spark, sf):
    return cleaning.category_values(views.process(spark, sf), "l_returnflag")


@query(
    "missing_report",
    f"with g as ({GAPPY_SQL}) "
    + " union all ".join(
        f"select {i} as position, '{c}' as \"column\", '{'Y' if c == Y else 'X'}' as role, count(*) - count({c}) as n_missing, "
        f"count(*) as n_rows, {r(f'(count(*) - count({c})) * 100.0 / count(*)', 8)} as pct_missing from g"
        for i, c in enumerate(NUMERIC)
    ),
)
def missing_report(spark, sf):
    df = views.gappy(spark, sf).select(*NUMERIC)
    return rounded(cleaning.missing_report(df, Y), 8, "pct_missing")


@query(
    "fill_forward",
    "with e as (select event_id, case when event_id % 5 in (1, 2) then null else value end as value from events) "
    "select event_id, coalesce(last_value(value ignore nulls) over "
    "(order by event_id rows between unbounded preceding and current row), 0.0) as value from e",
)
def fill_forward(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.when(~(F.col("event_id") % 5).isin(1, 2), F.col("value")).alias("value")
    )
    return cleaning.fill_forward(df, "value", "event_id", rows_per_bucket=50_000).select("event_id", "value")


# --- column classes -----------------------------------------------------------------------------


def _long(cols, expr) -> str:
    """One aggregate row per column of the typed view."""
    return f"with t as ({TYPED_SQL}) " + " union all ".join(f"select '{c}' as \"column\", {expr(c)} from t" for c in cols)


def _fact(name: str, cols, column):
    def run(spark, sf):
        return profile.evidence(views.typed(spark, sf), cols).select("column", column().alias(name))

    return run


query("type_empty", _long(TYPED, lambda c: f"count({c}) = 0 as is_empty"))(
    _fact("is_empty", TYPED, lambda: F.col("n_filled") == 0)
)
query(
    "type_boolean_values",
    _long(TYPED[1:], lambda c: f"bool_and(upper({_trim(c)}) in ('', '0', '-', 'X', '1', 'O')) as is_boolean"),
)(_fact("is_boolean", TYPED[1:], lambda: F.col("all_marks")))


@query(
    "type_physical",
    " union all ".join(
        f"select '{c}' as \"column\", case typeof(any_value({c})) when 'VARCHAR' then 'text' when 'DOUBLE' then 'real' "
        f"when 'TIMESTAMP' then 'datetime' else 'integer' end as physical, count({c}) as n_filled from lineitem"
        for c in ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    ),
)
def type_physical(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    return profile.evidence(table(spark, sf, "lineitem"), cols).select("column", "physical", "n_filled")


query(
    "type_numeric_text",
    _long(
        TYPED[1:],
        lambda c: f"case when count({_number(c)}) >= 0.9 * count({c}) then case when bool_or(({_number(c)}) % 1 <> 0) "
        "then 'real' else 'integer' end else 'no' end as number_class",
    ),
)(
    _fact(
        "number_class", TYPED[1:],
        lambda: F.when(F.col("n_numbers") >= 0.9 * F.col("n_filled"), F.when(F.col("any_fraction"), "real").otherwise("integer")).otherwise("no"),
    )
)
query(
    "type_date_pattern",
    _long(TYPED[1:], lambda c: "("
          + " or ".join(f"bool_and(regexp_full_match({c}, '{p.strip('^$')}'))" for p in profile.DATE_PATTERNS)
          + ") as is_date"),
)(_fact("is_date", TYPED[1:], lambda: F.col("one_date_pattern")))
query(
    "type_excel_serial",
    _long(TYPED[1:], lambda c: f"bool_and(regexp_full_match({c}, '\\d+') and coalesce(try_cast({c} as double) between 42000 and 48000, false)) "
          "as is_day_number"),
)(_fact("is_day_number", TYPED[1:], lambda: F.col("all_serial")))
query(
    "type_date_flexible",
    _long(TYPED[1:], lambda c: "("
          + " or ".join(f"bool_and(regexp_matches({c}, '{p}'))" for p in profile.LOOSE_DATE_PATTERNS)
          + ") as is_loose_date"),
)(_fact("is_loose_date", TYPED[1:], lambda: F.col("one_loose_pattern")))


@query(
    "type_category",
    _long(TYPED[1:], lambda c: f"count(distinct {c}) as n_distinct, count(distinct {c}) < 0.1 * count({c}) as is_category"),
)
def type_category(spark, sf):
    df = views.typed(spark, sf)
    marks = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in TYPED[1:]]
    counts = df.select(F.inline(F.array(*marks))).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), (F.count(F.lit(1)) < profile.CATEGORY_SHARE * F.sum("n")).alias("is_category")
    )


query("type_identifier", _long(TYPED[1:], lambda c: f"bool_and(regexp_full_match({c}, '\\d+')) as all_digits"))(
    _fact("all_digits", TYPED[1:], lambda: F.col("all_digits"))
)
query(
    "type_text",
    _long(
        TYPED[1:],
        lambda c: f"(count({_number(c)}) < 0.9 * count({c}) and not bool_and(upper({_trim(c)}) in ('', '0', '-', 'X', '1', 'O')) and not ("
        + " or ".join(f"bool_and(regexp_matches({c}, '{p}'))" for p in [*profile.DATE_PATTERNS, *profile.LOOSE_DATE_PATTERNS])
        + f") and count(distinct {c}) >= 0.1 * count({c})) as is_text",
    ),
)(
    lambda spark, sf: profile.column_classes(views.typed(spark, sf), TYPED[1:]).select(
        "column", (F.col("sub_category") == "text").alias("is_text")
    )
)

_CLASSES = {
    "nothing": ("empty", "empty"), "yes_no": ("categorical", "boolean"), "whole_text": ("numeric", "integer"),
    "real_text": ("numeric", "real"), "iso_date": ("date", "date"), "slash_time": ("date", "date"),
    "korean_date": ("date", "date"), "day_number": ("numeric", "integer"), "event_type": ("categorical", "category"),
    "mostly_number": ("numeric", "integer"), "note": ("categorical", "text"),
}
_CLASS_SQL = " union all ".join(
    f"select '{c}' as \"column\", '{m}' as main_category, '{s}' as sub_category, count(*) as n, count(*) - count({c}) as n_null from t"
    for c, (m, s) in _CLASSES.items()
)


@query("type_columns", f"with t as ({TYPED_SQL}) {_CLASS_SQL}")
def type_columns(spark, sf):
    return profile.column_classes(views.typed(spark, sf), TYPED).select("column", "main_category", "sub_category", "n", "n_null")


@query(
    "type_summary",
    f"with t as ({TYPED_SQL}), c as ({_CLASS_SQL}) select main_category, count(*) as n_columns from c group by 1",
)
def type_summary(spark, sf):
    return profile.class_summary(profile.column_classes(views.typed(spark, sf), TYPED))


@query(
    "cast_by_class",
    f"with t as ({TYPED_SQL}) select event_id, cast(whole_text as bigint) as whole_text, cast(real_text as double) as real_text, "
    "cast(try_cast(mostly_number as double) as bigint) as mostly_number from t",
)
def cast_by_class(spark, sf):
    df = views.typed(spark, sf).select("event_id", "whole_text", "real_text", "mostly_number")
    return profile.cast_by_class(df, profile.column_classes(df, ["whole_text", "real_text", "mostly_number"]))


@query(
    "pick_time_column",
    "select 'updated_date' as picked, count(*) as n, count(try_cast(d as timestamp)) as n_parsed from "
    "(select case when event_id % 3 = 0 then 'n/a' else strftime(ts, '%Y-%m-%d') end as d from events)",
)
def pick_time_column(spark, sf):
    df = views.typed(spark, sf).select(
        "value", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("iso_date")).alias("updated_date")
    )
    name = profile.pick_time_column(df)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.try_to_timestamp(F.col(name))).alias("n_parsed")).select(
        F.lit(name).alias("picked"), "n", "n_parsed"
    )


@query(
    "narrowing_candidates",
    'select * from (select \'l_returnflag\' as "column", count(distinct l_returnflag) as n_distinct from lineitem union all '
    "select 'l_linestatus', count(distinct l_linestatus) from lineitem union all "
    "select 'quarter_text', count(distinct cast(quarter(l_shipdate) as varchar)) from lineitem) "
    "where n_distinct between 2 and 30 order by n_distinct limit 5",
)
def narrowing_candidates(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("quarter_text", F.quarter("l_shipdate").cast("string"))
    return profile.narrowing_candidates(df.withColumn("order_text", F.col("l_orderkey").cast("string")), used=["l_shipdate"])
