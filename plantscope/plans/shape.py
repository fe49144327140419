"""Queries: distribution of numeric and categorical columns."""

from __future__ import annotations

from math import exp

from pyspark.sql import functions as F

from plantscope.functions.numeric import band
from plantscope.operators import distribution as dist
from plantscope.plans import views
from plantscope.plans.catalog import query, r, rounded, table
from plantscope.plans.views import NUMERIC, PROCESS_SQL, SHAPES, SHAPES_SQL

# --- SQL fragments: a chain of common table expressions over one row per column and value -------

_Q = {p: dist.quantile_name(p) for p in dist.PROBS}


def _stats(source: str, cols) -> str:
    values = " union all ".join(f"select '{c}' as col, cast({c} as double) as x from src" for c in cols)
    quantiles = ", ".join(f"quantile_cont(x, {p}) as {n}" for p, n in _Q.items())
    return (
        f"with src as materialized ({source}), v as materialized ({values}), st as materialized (select col, count(x) as n, "
        "avg(x) as mean, stddev_samp(x) as sd, min(x) as mn, max(x) as mx, skewness(x) as skew, kurtosis(x) as kurt, "
        f"{quantiles} from v group by col)"
    )


_TESTS = {
    "le20": "x <= q20", "ge80": "x >= q80", "le25": "x <= q25", "ge75": "x >= q75", "mid": "x > q25 and x < q75",
    "zero5": "x <= (mx - mn) * 0.05", "ge70": "x >= q70", "le30": "x <= q30", "zero10": "x <= (mx - mn) * 0.1",
    "ge90": "x >= q90", "in2575": "x between q25 and q75", "in1090": "x between q10 and q90", "in0595": "x between q05 and q95",
    "out15": "not (x between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25))",
    "out3": "not (x between q25 - 3 * (q75 - q25) and q75 + 3 * (q75 - q25))",
}
_PARTS = {
    "mean_above_zero5": "x > (mx - mn) * 0.05", "mean_le20": "x <= q20", "mean_gt20": "x > q20", "mean_ge80": "x >= q80",
    "mean_lt80": "x < q80",
}
_SHARES = (
    ", sh as materialized (select st.*, s.* exclude (col) from st join (select v.col, "
    + ", ".join(f"avg(case when {t} then 1.0 else 0.0 end) as {k}" for k, t in _TESTS.items())
    + ", "
    + ", ".join(f"avg(x) filter (where {t}) as {k}" for k, t in _PARTS.items())
    + " from v join st using (col) group by v.col) s using (col))"
)


def _bins(name: str, bins: int) -> str:
    """Counts of every bin, empty ones too, as table ``name`` and as one list per column."""
    return (
        f", {name}e as (select col, n, mn, mx, case when mn = mx then mn - 0.5 else mn end as lo, "
        f"case when mn = mx then mx + 0.5 else mx end as hi from st), "
        f"{name}g as (select v.col, x, lo, (hi - lo) / {bins} as step, least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) as g "
        f"from v join {name}e e on v.col = e.col), "
        f"{name}c as (select col, case when x < lo + g * step then g - 1 when x >= lo + (g + 1) * step and g < {bins - 1} then g + 1 "
        f"else g end as bin, count(*) as cnt from {name}g group by 1, 2), "
        f"{name} as materialized (select e.col, b.bin, lo, (hi - lo) / {bins} as step, n, mn, mx, coalesce(c.cnt, 0) as cnt "
        f"from {name}e e cross join (select unnest(range({bins})) as bin) b "
        f"left join {name}c c on c.col = e.col and c.bin = b.bin)"
    )


_RAW = [exp(-(k**2) / 2) for k in range(-4, 5)]
_KERNEL = [w / sum(_RAW) for w in _RAW]


def _mirrored(k: int) -> str:
    return f"(case when bin + ({k}) < 0 then -(bin + ({k})) - 1 when bin + ({k}) >= 30 then 59 - (bin + ({k})) else bin + ({k}) end)"


_SMOOTH = _bins("h", 30) + (
    ", hl as materialized (select col, list(cnt order by bin) as counts, max(cnt) as top from h group by col), "
    "sm as materialized (select h.col, bin, lo, step, mn, mx, n, top, "
    + " + ".join(f"cast({w!r} as double) * counts[{_mirrored(k)} + 1]" for k, w in zip(range(-4, 5), _KERNEL))
    + " as s from h join hl using (col))"
)
_PEAKS = _SMOOTH + (
    ", nb as (select *, lag(s) over (partition by col order by bin) as l, lead(s) over (partition by col order by bin) as rt from sm), "
    "pk as (select col, list(cast(bin as integer) order by bin) as peaks from nb where s > l and s > rt and s >= greatest(0.25 * top, 3.0) "
    "and s - least(l, rt) >= top * 0.05 group by col), "
    "pl as materialized (select e.col, e.n, e.mn, e.mx, e.lo, (e.hi - e.lo) / 30 as step, counts, coalesce(peaks, []) as peaks "
    "from he e join hl using (col) left join pk using (col)), "
    "th as materialized (select *, case when len(peaks) = 0 then peaks else list_reduce(list_transform(peaks, lambda p: [p]), "
    "lambda a, e: case when (e[1] - a[-1]) * step >= (mx - mn) * 0.05 then list_concat(a, e) else a end) end as thinned from pl)"
)
_VALID = _PEAKS + (
    ", tp as (select col, n, mn, mx, lo, step, unnest(thinned) as bin from th), "
    "nr as (select tp.col, tp.bin, count(*) filter (where x >= lo + bin * step - (mx - mn) * 0.1 and x <= lo + bin * step + (mx - mn) * 0.1) "
    "* 1.0 / any_value(n) as near from tp join v on v.col = tp.col group by 1, 2), "
    "kp as (select col, list(bin order by bin) filter (where near >= 0.05) as kept from nr group by col), "
    "va as materialized (select th.*, case when len(thinned) >= 2 and len(kept) >= 2 then kept else thinned end as validated "
    "from th left join kp using (col))"
)


def _valley(places: str) -> str:
    return (
        f"case when len({places}) >= 2 then list_min(counts[{places}[1] + 1 : {places}[2] + 1]) * 1.0 / "
        f"nullif(greatest(counts[{places}[1] + 1], counts[{places}[2] + 1]), 0) end"
    )


_MODAL = _VALID + (
    f", md as materialized (select *, {_valley('thinned')} as valley_ratio, coalesce({_valley('thinned')} < 0.3, false) and len(thinned) = 2 as bimodal, "
    f"coalesce({_valley('thinned')} < 0.3, false) and len(thinned) > 2 as multimodal, "
    f"case when {_valley('validated')} < 0.3 then 1 else 0 end as bimodal_score from va)"
)
_EXTREME = _bins("x50", 50) + (
    ", xn as (select *, lag(cnt) over (partition by col order by bin) as l, lead(cnt) over (partition by col order by bin) as rt, "
    "max(cnt) over (partition by col) as top from x50), "
    "xp as (select col, list(cast(bin as integer) order by cnt desc, bin) as ranked from xn where cnt > l and cnt > rt "
    "and cnt >= greatest(top * 0.15, 2.0) group by col), "
    "xl as (select col, list(cnt order by bin) as c50 from x50 group by col), "
    "xa as (select sh.*, c50, len(ranked) >= 2 as two, c50[ranked[1] + 1] * 1.0 / n as high, c50[ranked[2] + 1] * 1.0 / n as other, "
    "list_min(c50[least(ranked[1], ranked[2]) + 1 : greatest(ranked[1], ranked[2]) + 1]) * 1.0 / n as dip, "
    "case when skew > 2 then ge75 when skew < -2 then le25 end as tail from sh join xl using (col) left join xp using (col)), "
    "ex as materialized (select *, case when tail >= 0.4 then 'tail' when greatest(zero10, ge90) >= 0.5 then 'end' "
    "when two then 'peaks' else 'none' end as way from xa), "
    "ed as materialized (select *, case way when 'tail' then true when 'end' then true when 'peaks' then high >= 0.5 and other >= 0.15 "
    "and dip < least(high, other) * 0.4 else false end as is_extreme, "
    "case way when 'tail' then tail when 'end' then greatest(zero10, ge90) when 'peaks' then high else 0.0 end as max_ratio, "
    "case way when 'tail' then 1 - tail when 'end' then 1 - greatest(zero10, ge90) when 'peaks' then other else 0.0 end as second_ratio, "
    "case way when 'tail' then 0.1 when 'end' then 0.1 when 'peaks' then dip else 0.0 end as valley_ratio from ex)"
)


def _ladder(expr: str, cuts, labels, inclusive: bool = False) -> str:
    cases = " ".join(f"when {expr} {'<=' if inclusive else '<'} {c} then '{lb}'" for c, lb in zip(cuts, labels))
    return f"case when ({expr}) is null then null {cases} else '{labels[-1]}' end"


_GAP = "case when mean = 0 then 0.0 else abs(mean - q50) / abs(mean) * 100 end"
_CV = "case when mean = 0 then 0.0 else sd / abs(mean) end"
_SHAPE_STATS = _stats(SHAPES_SQL, SHAPES)


def _places(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda b: cast(b as varchar)), ',')"


def _text(col: str):
    return F.array_join(F.col(col).cast("array<string>"), ",")


def _shapes(spark, sf):
    return dist.shape_table(views.shapes(spark, sf), SHAPES)


def _peaked(spark, sf):
    df = views.shapes(spark, sf)
    return df, dist.with_modality(dist.with_peaks(dist.shape_table(df, SHAPES)))


# --- statistics ------------------------------------------------------------------------------------


@query(
    "describe_moments",
    _stats(PROCESS_SQL, NUMERIC) + f' select col as "column", n, {r("mean", 4)} as mean, {r("sd", 4)} as sd, {r("mn", 4)} as min, '
    f"{r('mx', 4)} as max, {r('skew', 6)} as skew, {r('kurt', 6)} as kurtosis from st",
)
def describe_moments(spark, sf):
    out = dist.describe_moments(views.process(spark, sf), NUMERIC).drop("position")
    return rounded(out, {"mean": 4, "sd": 4, "min": 4, "max": 4, "skew": 6, "kurtosis": 6})


@query(
    "quantiles",
    _stats(PROCESS_SQL, NUMERIC) + " "
    + " union all ".join(f'select col as "column", cast({p} as double) as prob, {r(n, 6)} as value from st' for p, n in _Q.items()),
)
def quantiles(spark, sf):
    return rounded(dist.quantile_table(views.process(spark, sf), NUMERIC), 6, "value")


@query(
    "histogram",
    _stats(PROCESS_SQL, NUMERIC) + _bins("h", 30)
    + f' select col as "column", cast(bin as integer) as bin, {r("lo + bin * step", 4)} as low, cnt as count, {r("cnt * 100.0 / n", 8)} as pct from h',
)
def histogram(spark, sf):
    return rounded(dist.histogram(views.process(spark, sf), NUMERIC, 30), {"low": 4, "pct": 8})


@query(
    "summary_table",
    _stats(PROCESS_SQL, NUMERIC) + f' select col as "column", n, {r("mean", 4)} as mean, {r("sd", 4)} as sd, {r("mn", 4)} as min, '
    f"{r('q25', 4)} as q1, {r('q50', 4)} as median, {r('q75', 4)} as q3, {r('mx', 4)} as max, {r('skew', 6)} as skew, "
    f"{r('kurt', 6)} as kurtosis from st",
)
def summary_table(spark, sf):
    digits = {k: 4 for k in ("mean", "sd", "min", "q1", "median", "q3", "max")} | {"skew": 6, "kurtosis": 6}
    return rounded(dist.summary_table(views.process(spark, sf), NUMERIC), digits)


# --- peaks -------------------------------------------------------------------------------------------


@query("smooth_histogram", _SHAPE_STATS + _SMOOTH + f' select col as "column", cast(bin as integer) as bin, {r("s", 5)} as smooth from sm')
def smooth_histogram(spark, sf):
    _, peaked = _peaked(spark, sf)
    return rounded(peaked.select("column", F.posexplode("smooth").alias("bin", "smooth")), 5, "smooth")


def _peak_sql(places: str) -> str:
    return f' select col as "column", {_places(places)} as bins, {r(f"lo + {places}[1] * step", 6)} as first_at from '


def _peak_rows(peaked, places: str):
    first = F.when(F.size(places) > 0, F.col("low") + F.get(F.col(places), F.lit(0)) * F.col("step"))
    return rounded(peaked.select("column", _text(places).alias("bins"), first.alias("first_at")), 6, "first_at")


@query("find_peaks", _SHAPE_STATS + _PEAKS + _peak_sql("peaks") + "pl")
def find_peaks(spark, sf):
    return _peak_rows(_peaked(spark, sf)[1], "peaks")


@query("thin_peaks", _SHAPE_STATS + _PEAKS + _peak_sql("thinned") + "th")
def thin_peaks(spark, sf):
    return _peak_rows(_peaked(spark, sf)[1], "thinned")


@query("validate_peaks", _SHAPE_STATS + _VALID + _peak_sql("validated") + "va")
def validate_peaks(spark, sf):
    return _peak_rows(dist.validated_peaks(*_peaked(spark, sf)), "validated")


@query(
    "valley_bimodality",
    _SHAPE_STATS + _MODAL + f' select col as "column", {r("valley_ratio", 8)} as valley_ratio, bimodal, multimodal, bimodal_score from md',
)
def valley_bimodality(spark, sf):
    out = dist.validated_peaks(*_peaked(spark, sf)).select("column", "valley_ratio", "bimodal", "multimodal", "bimodal_score")
    return rounded(out, 8, "valley_ratio")


# --- judgements --------------------------------------------------------------------------------------

_TAIL = ["le20", "ge80", "le25", "ge75", "mid", "zero5"]


@query(
    "tail_concentration",
    _SHAPE_STATS + _SHARES + ' select col as "column", ' + ", ".join(f"{r(k, 8)} as {k}" for k in _TAIL)
    + ", le20 >= 0.5 or ge80 >= 0.5 or zero5 >= 0.5 as concentrated from sh",
)
def tail_concentration(spark, sf):
    out = dist.with_flags(_shapes(spark, sf)).select("column", *_TAIL, "concentrated")
    return rounded(out, 8, *_TAIL)


_FLAG_SQL = "coalesce(case when skew > 1.5 then ge70 >= 0.4 when skew < -1.5 then le30 >= 0.4 end, false)"


@query(
    "skew_extreme_flag",
    _SHAPE_STATS + _SHARES + f' select col as "column", {r("skew", 6)} as skew, {r("ge70", 8)} as ge70, {r("le30", 8)} as le30, '
    f"{_FLAG_SQL} as skew_extreme from sh",
)
def skew_extreme_flag(spark, sf):
    out = dist.with_flags(_shapes(spark, sf)).select("column", "skew", "ge70", "le30", "skew_extreme")
    return rounded(out, {"skew": 6, "ge70": 8, "le30": 8})


@query(
    "detect_extreme_distribution",
    _SHAPE_STATS + _SHARES + _EXTREME + ' select col as "column", is_extreme, '
    + ", ".join(f"{r(k, 8)} as {k}" for k in ("max_ratio", "second_ratio", "valley_ratio")) + " from ed",
)
def detect_extreme_distribution(spark, sf):
    out = dist.extreme_check(_shapes(spark, sf)).select("column", "extreme.*")
    return rounded(out, 8, "max_ratio", "second_ratio", "valley_ratio")


_ENDS = "(le25 >= 0.5 or ge75 >= 0.5 or zero5 >= 0.5 or mid < 0.3)"


@query(
    "classify_shape",
    _SHAPE_STATS + _SHARES + _MODAL + ' select col as "column", case '
    f"when abs(skew) < 0.3 and abs(kurt) < 0.5 and {_GAP} < 5 and not bimodal and not multimodal and not {_ENDS} "
    "then case when abs(skew) < 0.1 then 'near_normal' else 'normal_like' end when bimodal then 'bimodal' "
    f"when multimodal then 'multimodal' when {_ENDS} then case when zero5 >= 0.5 then 'zero_concentrated' "
    "when le25 >= 0.5 then 'low_concentrated' when ge75 >= 0.5 then 'high_concentrated' else 'two_ended' end "
    f"else {_ladder('abs(skew)', dist.SKEW_CUTS, dist.SKEW_LABELS)} end as shape, len(thinned) as n_peaks "
    "from sh join (select col, bimodal, multimodal, thinned from md) using (col)",
)
def classify_shape(spark, sf):
    _, peaked = _peaked(spark, sf)
    return dist.with_shape_class(peaked).select("column", "shape", F.size("thinned").cast("long").alias("n_peaks"))


@query(
    "skew_direction",
    _SHAPE_STATS + _SHARES + ' select col as "column", case when mid < 0.3 then case when le25 > ge75 * 1.5 then \'toward_low\' '
    "when ge75 > le25 * 1.5 then 'toward_high' else 'both_ends' end when skew > 0.1 then 'right_tail' when skew < -0.1 then 'left_tail' "
    "else 'symmetric' end as direction from sh",
)
def skew_direction(spark, sf):
    return _shapes(spark, sf).select("column", dist.skew_direction().alias("direction"))


@query(
    "kurtosis_band",
    _SHAPE_STATS + f' select col as "column", {r("kurt", 4)} as kurtosis, {_ladder("kurt", dist.KURTOSIS_CUTS, dist.KURTOSIS_LABELS)} as band from st',
)
def kurtosis_band(spark, sf):
    out = dist.describe_moments(views.shapes(spark, sf), SHAPES).select("column", "kurtosis", dist.kurtosis_band().alias("band"))
    return rounded(out, 4, "kurtosis")


_CENTRE = ["in2575", "in1090", "in0595"]


@query(
    "central_concentration",
    _SHAPE_STATS + _SHARES + ' select col as "column", ' + ", ".join(f"{r(k + ' * 100', 6)} as {k}" for k in _CENTRE) + ", "
    + _ladder("in2575 * 100", (50, 60, 70), ("spread", "medium", "concentrated", "very_concentrated"), True) + " as band from sh",
)
def central_concentration(spark, sf):
    out = _shapes(spark, sf).select("column", *[(F.col(k) * 100).alias(k) for k in _CENTRE], dist.concentration_band().alias("band"))
    return rounded(out, 6, *_CENTRE)


@query(
    "iqr_outliers",
    _SHAPE_STATS + _SHARES + f' select col as "column", {r("out15 * 100", 6)} as outlier_pct, {r("out3 * 100", 6)} as far_pct, '
    f"{_ladder('out15 * 100', dist.OUTLIER_CUTS, dist.OUTLIER_LABELS)} as band from sh",
)
def iqr_outliers(spark, sf):
    out = _shapes(spark, sf).select(
        "column", (F.col("out15") * 100).alias("outlier_pct"), (F.col("out3") * 100).alias("far_pct"), dist.outlier_band().alias("band")
    )
    return rounded(out, 6, "outlier_pct", "far_pct")


@query(
    "cv_band",
    _SHAPE_STATS + f' select col as "column", {r(_CV, 8)} as cv, {_ladder(_CV, dist.RANGE_CUTS, dist.RANGE_LABELS)} as range_band, '
    f"{_ladder(_CV, dist.SPREAD_CUTS, dist.SPREAD_LABELS)} as spread_band from st",
)
def cv_band(spark, sf):
    cv = dist.variation()
    out = dist.describe_moments(views.shapes(spark, sf), SHAPES).select(
        "column", cv.alias("cv"), band(cv, dist.RANGE_CUTS, dist.RANGE_LABELS).alias("range_band"),
        band(cv, dist.SPREAD_CUTS, dist.SPREAD_LABELS).alias("spread_band"),
    )
    return rounded(out, 8, "cv")


@query(
    "symmetry_band",
    _SHAPE_STATS + f' select col as "column", {r(_GAP, 6)} as gap_pct, {_ladder(_GAP, dist.SYMMETRY_CUTS, dist.SYMMETRY_LABELS)} as band from st',
)
def symmetry_band(spark, sf):
    gap = dist.mean_median_gap()
    known = dist.summary_table(views.shapes(spark, sf), SHAPES).withColumnRenamed("median", "q50")
    out = known.select("column", gap.alias("gap_pct"), band(gap, dist.SYMMETRY_CUTS, dist.SYMMETRY_LABELS).alias("band"))
    return rounded(out, 6, "gap_pct")


@query(
    "group_representatives",
    _SHAPE_STATS + _SHARES + _MODAL
    + f", fl as (select sh.*, validated, bimodal_score, lo, step, (le20 >= 0.5 or ge80 >= 0.5 or zero5 >= 0.5) or {_FLAG_SQL} as odd "
    "from sh join (select col, validated, bimodal_score, lo, step from md) using (col)), "
    "rl as (select *, case when len(validated) >= 3 or (len(validated) = 2 and (bimodal_score = 1 or odd)) then 'peaks' "
    "when odd and zero5 >= 0.5 then 'zero_and_rest' when odd and le20 >= 0.5 then 'low_end_and_rest' "
    "when odd and ge80 >= 0.5 then 'high_end_and_rest' end as rule from fl), "
    "gv as (select col, rule, case rule when 'peaks' then list_transform(validated, lambda b: lo + b * step) "
    "when 'zero_and_rest' then [0.0, mean_above_zero5] when 'low_end_and_rest' then [mean_le20, mean_gt20] "
    "else [mean_lt80, mean_ge80] end as vals from rl where rule is not null), "
    "un as (select col, rule, unnest(vals) as value, generate_subscripts(vals, 1) - 1 as grp from gv) "
    f'select col as "column", rule, cast(grp as integer) as "group", {r("value", 4)} as value from un where value is not null',
)
def group_representatives(spark, sf):
    flagged = dist.with_flags(dist.validated_peaks(*_peaked(spark, sf)))
    return rounded(dist.group_representatives(flagged), 4, "value")



@query(
    "group_counts",
    _SHAPE_STATS + _SHARES + _MODAL
    + ", fl as (select sh.*, validated, bimodal_score, lo, step, (le20 >= 0.5 or ge80 >= 0.5 or zero5 >= 0.5) or " + _FLAG_SQL + " as odd "
    "from sh join (select col, validated, bimodal_score, lo, step from md) using (col)), "
    "pv as (select col, n, mn, mx, list_transform(validated, lambda b: lo + b * step) as vals from fl "
    "where len(validated) >= 3 or (len(validated) = 2 and (bimodal_score = 1 or odd))), "
    "un as (select col, n, unnest(vals) as value, generate_subscripts(vals, 1) - 1 as grp, (mx - mn) * 0.1 as half from pv), "
    "wn as (select col, n, grp, value, value - half as low, value + half as high from un), "
    "gc as (select wn.col, wn.grp, wn.value, wn.low, wn.high, wn.n, count(v.x) as n_rows from wn left join v "
    "on v.col = wn.col and v.x between wn.low and wn.high group by all) "
    f'select col as "column", cast(grp as integer) as "group", {r("value", 4)} as value, {r("low", 4)} as low, {r("high", 4)} as high, '
    f"n_rows, {r('n_rows / n', 8)} as share from gc",
)
def group_counts(spark, sf):
    df, shaped = _peaked(spark, sf)
    found = dist.group_counts(df, dist.with_flags(dist.validated_peaks(df, shaped)))
    return rounded(rounded(found, 4, "value", "low", "high"), 8, "share")

_PENALTIES = (
    ", pn as (select *, case when abs(skew) > 1.5 then 'skew_strong' when abs(skew) > 0.8 then 'skew_some' end as p1, "
    "case when out15 * 100 > 30 then 'outliers_very_many' when out15 * 100 > 15 then 'outliers_many' when out15 * 100 > 8 then 'outliers_some' end as p2, "
    f"case when {_CV} < 0.02 then 'variation_too_small' when {_CV} < 0.05 then 'variation_small' when {_CV} > 3 then 'variation_too_large' end as p3, "
    "case when is_extreme then 'extreme_split' end as p4 from ed), "
    "pp(code, points, action) as (values ('skew_strong', 15, 'normalize_distribution'), ('skew_some', 10, 'normalize_distribution'), "
    "('outliers_very_many', 20, 'treat_outliers'), ('outliers_many', 15, 'treat_outliers'), ('outliers_some', 5, 'treat_outliers'), "
    "('variation_too_small', 15, 'rescale'), ('variation_small', 10, 'rescale'), ('variation_too_large', 15, 'rescale'), "
    "('extreme_split', 25, 'analyze_groups')), "
    "pu as (select col, unnest([p1, p2, p3, p4]) as code from pn), "
    "pj as (select pu.col, pu.code, pp.points, pp.action from pu join pp using (code)), "
    "sc as (select ed.col, 100 - coalesce(sum(points), 0) as score from ed left join pj using (col) group by ed.col)"
)


@query(
    "suitability_score",
    _SHAPE_STATS + _SHARES + _EXTREME + _PENALTIES + ' select col as "column", cast(score as integer) as score, '
    f"{_ladder('score', dist.GRADE_CUTS, dist.GRADE_LABELS)} as grade from sc",
)
def suitability_score(spark, sf):
    return dist.suitability(dist.extreme_check(_shapes(spark, sf))).select("column", "score", "grade")


@query(
    "improvement_plan",
    _SHAPE_STATS + _SHARES + _EXTREME + _PENALTIES + ' select col as "column", code, action, points, '
    f"{_ladder('score', dist.GRADE_CUTS, dist.HINT_LABELS)} as hint from pj join sc using (col)",
)
def improvement_plan(spark, sf):
    return dist.improvement_plan(dist.suitability(dist.extreme_check(_shapes(spark, sf))))


# --- categories -----------------------------------------------------------------------------------------

_FREQ_COLS = ["l_returnflag", "l_linestatus", "ship_month"]
_FREQ_SOURCE = "select l_returnflag, l_linestatus, cast(month(l_shipdate) as varchar) as ship_month from lineitem"
_FREQ = (
    f"with src as ({_FREQ_SOURCE}), v as ("
    + " union all ".join(f"select '{c}' as col, {c} as value from src where {c} is not null" for c in _FREQ_COLS)
    + "), f as (select col, value, count(*) as cnt, count(*) * 100.0 / sum(count(*)) over (partition by col) as pct from v group by 1, 2)"
)


def _frequency(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.month("l_shipdate").cast("string").alias("ship_month"))
    return dist.category_frequency(df, _FREQ_COLS)


@query("category_frequency", _FREQ + f' select col as "column", value, cnt as count, {r("pct", 8)} as pct from f')
def category_frequency(spark, sf):
    return rounded(_frequency(spark, sf), 8, "pct").orderBy("column", "value")


@query(
    "category_concentration",
    _FREQ + ", rk as (select *, row_number() over (partition by col order by cnt desc, value) as k from f), "
    "w as (select col, " + ", ".join(f"max(value) filter (where k = {k}) as top{k}, max(pct) filter (where k = {k}) as pct{k}" for k in (1, 2, 3))
    + " from rk group by col), t as (select *, pct1 + coalesce(pct2, 0) + coalesce(pct3, 0) as together from w) "
    'select col as "column", top1, top2, top3, ' + ", ".join(f"{r(f'pct{k}', 8)} as pct{k}" for k in (1, 2, 3))
    + f", {r('together', 8)} as top3_pct, case when pct1 >= 70 then 'extremely_concentrated' when pct1 >= 50 then 'very_concentrated' "
    "when together >= 80 and pct3 is not null then 'top_three' when pct1 >= 30 then 'slightly_skewed' else 'even' end as concentration from t",
)
def category_concentration(spark, sf):
    return rounded(dist.category_concentration(_frequency(spark, sf)), 8, "pct1", "pct2", "pct3", "top3_pct")


@query(
    "sparse_categories",
    _FREQ + ' select col as "column", count(*) as n_values, count(*) filter (where pct < 5) as n_sparse, '
    + r("count(*) filter (where pct < 5) * 100.0 / count(*)", 8) + " as sparse_pct from f group by col",
)
def sparse_categories(spark, sf):
    return rounded(dist.category_counts(_frequency(spark, sf)).drop("diversity"), 8, "sparse_pct")


@query(
    "category_diversity",
    _FREQ + ', g as (select col, count(*) as n_values from f group by col) select col as "column", n_values, '
    + _ladder("n_values", (3, 7, 15), ("simple", "fair", "many", "very_many"), True) + " as diversity from g",
)
def category_diversity(spark, sf):
    return dist.category_counts(_frequency(spark, sf)).select("column", "n_values", "diversity")


