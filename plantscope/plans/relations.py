"""Queries: correlation and association."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from plantscope.operators import association as assoc
from plantscope.operators import linear
from plantscope.plans import views
from plantscope.plans.catalog import query, r, rounded
from plantscope.plans.least_squares_sql import least_squares
from plantscope.plans.views import BANDED, BANDED_SQL, GAPPY_SQL, NUMERIC, PROCESS_SQL, X, Y

CELLS = ["l_quantity", "l_discount", "l_tax"]
BANDED_X = BANDED[1:]


def _pearson_sql(source: str, pairs) -> str:
    return f"with src as materialized ({source}), pe as (" + " union all ".join(
        f"select '{a}' as x, '{b}' as y, 'pearson' as method, corr({a}, {b}) as value, "
        f"count(*) filter (where {a} is not null and {b} is not null) as n from src"
        for a, b in pairs
    ) + ")"


def _ranks_sql(cols) -> str:
    return ", rk as materialized (select " + ", ".join(
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in cols
    ) + " from src)"


def _spearman_sql(pairs) -> str:
    return ", sp as (" + " union all ".join(
        f"select '{a}' as x, '{b}' as y, 'spearman' as method, corr({a}, {b}) as value, count(*) as n from rk" for a, b in pairs
    ) + ")"


def _cells_sql(pairs) -> str:
    """Every pair of cells of each column pair: tau-b and distance correlation by definition."""
    out = ", cl as materialized (" + " union all ".join(
        f"select '{a}' as p, '{b}' as q, cast({a} as double) as a, cast({b} as double) as b, cast(count(*) as double) as w "
        f"from src group by {a}, {b}" for a, b in pairs
    ) + ")"
    out += (
        ", cc as materialized (select i.p, i.q, sum(i.w * j.w * sign(i.a - j.a) * sign(i.b - j.b)) as s, "
        "sum(i.w * j.w) filter (where i.a <> j.a) as ua, sum(i.w * j.w) filter (where i.b <> j.b) as ub, "
        "sum(i.w * j.w * abs(i.a - j.a) * abs(i.b - j.b)) as sab, sum(i.w * j.w * (i.a - j.a) * (i.a - j.a)) as saa, "
        "sum(i.w * j.w * (i.b - j.b) * (i.b - j.b)) as sbb from cl i join cl j on i.p = j.p and i.q = j.q group by 1, 2), "
        "rs as (select i.p, i.q, i.a, i.b, any_value(i.w) as w, sum(j.w * abs(i.a - j.a)) as ra, sum(j.w * abs(i.b - j.b)) as rb "
        "from cl i join cl j on i.p = j.p and i.q = j.q group by 1, 2, 3, 4), "
        "rt as (select p, q, sum(w) as n, sum(w * ra * rb) as ab, sum(w * ra * ra) as aa, sum(w * rb * rb) as bb, "
        "sum(w * ra) as ta, sum(w * rb) as tb from rs group by 1, 2), "
        "dc as (select cc.p, cc.q, n, s / sqrt(ua * ub) as tau, sab / n**2 - 2 * ab / n**3 + ta * tb / n**4 as cov, "
        "saa / n**2 - 2 * aa / n**3 + ta * ta / n**4 as va, sbb / n**2 - 2 * bb / n**3 + tb * tb / n**4 as vb "
        "from cc join rt using (p, q)), "
        "ke as (select p as x, q as y, 'kendall' as method, tau as value, cast(n as bigint) as n from dc), "
        "di as (select p as x, q as y, 'dcor' as method, sqrt(greatest(cov, 0)) / sqrt(sqrt(va * vb)) as value, cast(n as bigint) as n from dc)"
    )
    return out


def _pairs(cols):
    return list(combinations(cols, 2))


def _show(df, digits: int = 8):
    return rounded(df, digits, "value")


_LONG = f"select x, y, method, {r('value', 8)} as value, n from "


@query("pearson_matrix", _pearson_sql(GAPPY_SQL, _pairs(NUMERIC)) + " " + _LONG + "pe")
def pearson_matrix(spark, sf):
    return _show(assoc.pearson_pairs(views.gappy(spark, sf), _pairs(NUMERIC)))


@query(
    "mirrored_matrix",
    _pearson_sql(PROCESS_SQL, _pairs(NUMERIC)) + ", fm as (select * from pe union all select y, x, method, value, n from pe union all "
    + " union all ".join(f"select '{c}', '{c}', 'pearson', 1.0, (select count(*) from src)" for c in NUMERIC) + ") " + _LONG + "fm",
)
def mirrored_matrix(spark, sf):
    return _show(assoc.mirrored(assoc.pearson_pairs(views.process(spark, sf), _pairs(NUMERIC))))


@query(
    "spearman_matrix",
    f"with src as materialized ({PROCESS_SQL})" + _ranks_sql(NUMERIC) + _spearman_sql(_pairs(NUMERIC)) + " " + _LONG + "sp",
)
def spearman_matrix(spark, sf):
    return _show(assoc.association_pairs(views.process(spark, sf), _pairs(NUMERIC), ["spearman"]))


@query("kendall_matrix", f"with src as materialized ({PROCESS_SQL})" + _cells_sql(_pairs(CELLS)) + " " + _LONG + "ke")
def kendall_matrix(spark, sf):
    return _show(assoc.association_pairs(views.process(spark, sf), _pairs(CELLS), ["kendall"]))


@query("distance_correlation_matrix", f"with src as materialized ({PROCESS_SQL})" + _cells_sql(_pairs(CELLS)) + " " + _LONG + "di")
def distance_correlation_matrix(spark, sf):
    return _show(assoc.association_pairs(views.process(spark, sf), _pairs(CELLS), ["dcor"]))


@query("kendall_continuous")
def kendall_continuous(spark, sf):
    return _show(assoc.association_pairs(views.process(spark, sf), _pairs(NUMERIC), ["kendall"]))


@query("distance_correlation_continuous")
def distance_correlation_continuous(spark, sf):
    return _show(assoc.association_pairs(views.process(spark, sf), _pairs(NUMERIC), ["dcor"]))


# --- all four against the target -------------------------------------------------------------------

_TARGET_PAIRS = [(BANDED[0], c) for c in BANDED_X]
_ALL = (
    _pearson_sql(BANDED_SQL, _TARGET_PAIRS) + _ranks_sql(BANDED) + _spearman_sql(_TARGET_PAIRS) + _cells_sql(_TARGET_PAIRS)
    + ", al as materialized (select * from pe union all select * from sp union all select * from ke union all select * from di), "
    "ta as materialized (select y as variable, " + ", ".join(f"max(value) filter (where method = '{m}') as {m}" for m in assoc.METHODS)
    + " from al group by 1), "
    "co as materialized (select *, case when 0.5 * coalesce(pearson, 0) + 0.3 * coalesce(spearman, 0) + 0.2 * coalesce(kendall, 0) > 0 "
    "then 1 else -1 end as sign, 0.4 * abs(coalesce(pearson, 0)) + 0.2 * abs(coalesce(spearman, 0)) + 0.1 * abs(coalesce(kendall, 0)) "
    "+ 0.3 * coalesce(dcor, 0) as strength from ta)"
)


def _target(spark, sf):
    long = assoc.association_pairs(views.banded(spark, sf), _TARGET_PAIRS)
    return assoc.target_association(long, BANDED[0])


_FOUR = ", ".join(f"{r(m, 8)} as {m}" for m in assoc.METHODS)


@query("target_association", _ALL + f" select variable, {_FOUR} from ta")
def target_association(spark, sf):
    return rounded(_target(spark, sf), 8, *assoc.METHODS)


@query("association_consensus", _ALL + f" select variable, sign, {r('strength', 8)} as strength, {r('sign * strength', 8)} as consensus from co")
def association_consensus(spark, sf):
    out = assoc.consensus(_target(spark, sf)).select("variable", "sign", "strength", "consensus")
    return rounded(out, 8, "strength", "consensus")


_TERMS = (
    least_squares("ls", "select * from src", BANDED[0], BANDED_X)
    + ", tm as (select '(intercept)' as variable, b0 as c from ls union all "
    + " union all ".join(f"select '{c}', b{i + 1} * (select avg({c}) from src) from ls" for i, c in enumerate(BANDED_X))
    + "), tr as (select variable, c * 100 / (select sum(c) from tm) as ratio from tm), "
    "cj as (select co.*, sign * strength as consensus, ratio, abs(ratio) as ca, abs(sign * strength * 100) as sa from co join tr using (variable)), "
    "cv as (select *, case when ca <= 2 or sa <= 2 then 'unclear' when sign(ratio) <> sign(consensus) then 'direction_conflict' "
    "when (ca <= 5 and sa > 10) or (sa <= 5 and ca > 10) then 'strength_conflict' else 'agree' end as verdict from cj)"
)


def _compared(spark, sf):
    df = views.banded(spark, sf)
    grams = linear.gram_by(df, BANDED)
    terms = linear.term_contributions(spark, [linear.solve_least_squares(grams[()], BANDED[0])], grams[()])
    return assoc.compare_with_regression(assoc.consensus(_target(spark, sf)), terms)


@query(
    "compare_regression_vs_association",
    _ALL + _TERMS + f" select variable, {r('ratio', 5)} as ratio, {r('consensus', 8)} as consensus, verdict from cv",
)
def compare_regression_vs_association(spark, sf):
    return rounded(_compared(spark, sf).select("variable", "ratio", "consensus", "verdict"), {"ratio": 5, "consensus": 8})


@query(
    "association_notes",
    _ALL + _TERMS + " select variable, verdict, concat_ws(',', case when dcor >= 0.3 then 'maybe_nonlinear' end, "
    "case when verdict = 'unclear' and ca <= 2 and sa <= 2 then 'both_weak' end, "
    "case when verdict = 'unclear' and ca <= 2 and sa > 2 then 'contribution_weak' end, "
    "case when verdict = 'unclear' and ca > 2 then 'association_weak' end, "
    "case when verdict = 'strength_conflict' and ca > sa then 'contribution_larger' end, "
    "case when verdict = 'strength_conflict' and ca <= sa then 'association_larger' end, "
    "case when verdict = 'direction_conflict' then 'directions_differ' end) as notes from cv",
)
def association_notes(spark, sf):
    noted = assoc.association_notes(_compared(spark, sf)).orderBy(F.desc(F.abs("ratio")))
    return noted.select("variable", "verdict", F.array_join("notes", ",").alias("notes"))


_PAIR_SQL = _pearson_sql(PROCESS_SQL, _pairs(NUMERIC))
_BAND = "case when abs(value) >= 0.7 then 'strong' else 'moderate' end"
_SIDE = "case when value > 0 then 'positive' else 'negative' end"


@query("strong_pairs", _PAIR_SQL + f" select x, y, {r('value', 8)} as value, {_SIDE} as direction, {_BAND} as band from pe where abs(value) >= 0.4")
def strong_pairs(spark, sf):
    return _show(assoc.strong_pairs(assoc.pearson_pairs(views.process(spark, sf), _pairs(NUMERIC))))


@query(
    "strong_pair_counts",
    _PAIR_SQL + f" select {_SIDE} as direction, {_BAND} as band, count(*) as n_pairs from pe where abs(value) >= 0.4 group by 1, 2",
)
def strong_pair_counts(spark, sf):
    return assoc.strong_pair_counts(assoc.strong_pairs(assoc.pearson_pairs(views.process(spark, sf), _pairs(NUMERIC))))


@query(
    "pair_severity",
    _PAIR_SQL + f" select x, y, {r('value', 8)} as value, case when abs(value) < 0.4 then 'weak' when abs(value) < 0.6 then 'moderate' "
    "when abs(value) < 0.8 then 'strong' when abs(value) < 0.95 then 'very_strong' else 'collinear' end as severity from pe",
)
def pair_severity(spark, sf):
    return _show(assoc.pair_severity(assoc.pearson_pairs(views.process(spark, sf), _pairs(NUMERIC))))


@query(
    "low_correlation_candidates",
    _ALL + f" select variable, {r('pearson', 8)} as pearson, {r('dcor', 8)} as dcor, dcor >= 0.3 as maybe_nonlinear from ta where abs(pearson) < 0.4",
)
def low_correlation_candidates(spark, sf):
    return rounded(assoc.low_correlation_candidates(_target(spark, sf)), 8, "pearson", "dcor")


@query(
    "driver_ranking",
    _pearson_sql(PROCESS_SQL, [(Y, c) for c in X]) + ", sl as (" + " union all ".join(
        f"select '{c}' as variable, regr_slope(charge, {c}) as slope from src" for c in X
    ) + f") select y as variable, {r('value', 8)} as pearson, {r('slope', 5)} as slope, abs(value) >= 0.4 as is_strong "
    "from pe join sl on pe.y = sl.variable",
)
def driver_ranking(spark, sf):
    df = views.process(spark, sf)
    long = assoc.pearson_pairs(df, [(Y, c) for c in X])
    slopes = assoc.slope_table(df, Y, X)
    ranked = long.select(F.col("y").alias("variable"), F.col("value").alias("pearson")).join(F.broadcast(slopes), "variable")
    out = rounded(ranked, {"pearson": 8, "slope": 5})
    return out.withColumn("is_strong", F.abs("pearson") >= 0.4).orderBy(F.desc(F.abs("pearson")), "variable")
