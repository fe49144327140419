"""Queries: similar cases, coverage, projections, maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.operators import cases
from plantscope.plans import views
from plantscope.plans.catalog import query, r, rounded
from plantscope.plans.regression import split
from plantscope.plans.views import KEYS, NUMERIC, PROCESS_SQL, SCENARIOS_SQL, X, Y

FLAG = ["l_returnflag"]
ORDER = [*KEYS, *NUMERIC, "l_returnflag"]
PAIR = ["l_extendedprice", "l_quantity"]
_SRC = f"with src as materialized ({PROCESS_SQL})"


def _distance_sql(metric: str = "L2") -> str:
    gaps = []
    for c in X:
        gap = f"({c} - s.q_{c}) / d_{c}"
        gaps.append(f"case when s.q_{c} is null then 0.0 else {'abs(' + gap + ')' if metric == 'L1' else f'({gap}) * ({gap})'} end")
    total = " + ".join(gaps)
    if metric == "L2":
        total = f"sqrt({total})"
    return f"{total} + case when s.q_l_returnflag is null or l_returnflag = s.q_l_returnflag then 0.0 else 1.0 end"


_ASKED = (
    ", sd as (select " + ", ".join(f"stddev_pop({c}) as d_{c}" for c in X) + " from src), s as (select scenario_id, "
    + ", ".join(f"{c} as q_{c}" for c in [*X, *FLAG]) + f" from ({SCENARIOS_SQL}))"
)


def _near_sql(preset: str) -> str:
    p = cases.PRESETS[preset]
    return _SRC + _ASKED + (
        f", ds as materialized (select s.scenario_id, src.*, round({_distance_sql()}, 12) as distance from src, sd, s), "
        "bs as (select scenario_id, min(distance) as d_best from ds group by 1), "
        f"nr as materialized (select * from (select *, row_number() over (partition by scenario_id order by distance, {', '.join(ORDER)}) as rank "
        f"from ds join bs using (scenario_id) where distance <= d_best * (1 + {p['alpha']})) where rank <= {min(p['k_max'], p['k_cap'])})"
    )


def _nearest(spark, sf, preset: str):
    return cases.nearest_cases(
        views.process(spark, sf).drop("l_linestatus"), views.scenarios(spark), X, FLAG, order=ORDER, **cases.exploration_preset(preset)
    )


@query("case_distance", _SRC + _ASKED + f" select l_orderkey, l_linenumber, scenario_id, {r(_distance_sql(), 5)} as distance from src, sd, s")
def case_distance(spark, sf):
    out = cases.case_distances(views.process(spark, sf), views.scenarios(spark), X, FLAG, keep=KEYS)
    return rounded(out, 5, "distance")


@query(
    "case_distance_l1",
    _SRC + _ASKED + f" select scenario_id, {r(f'min({_distance_sql('L1')})', 8)} as nearest, {r(f'avg({_distance_sql('L1')})', 8)} as average "
    "from src, sd, s group by 1",
)
def case_distance_l1(spark, sf):
    far = cases.case_distances(views.process(spark, sf), views.scenarios(spark), X, FLAG, metric="L1")
    out = far.groupBy("scenario_id").agg(F.min("distance").alias("nearest"), F.avg("distance").alias("average"))
    return rounded(out, 8, "nearest", "average")


_HIT = f"select scenario_id, cast(rank as integer) as rank, l_orderkey, l_linenumber, {r('distance', 8)} as distance"


@query("nearest_cases", _near_sql("balanced") + f" {_HIT} from nr")
def nearest_cases(spark, sf):
    return rounded(_nearest(spark, sf, "balanced").select("scenario_id", "rank", *KEYS, "distance"), 8, "distance")


@query("similarity_score", _near_sql("balanced") + f" select scenario_id, cast(rank as integer) as rank, {r('(1 + d_best) / (1 + distance)', 8)} as similarity from nr")
def similarity_score(spark, sf):
    return rounded(_nearest(spark, sf, "balanced").select("scenario_id", "rank", "similarity"), 8, "similarity")


def _counts(name: str) -> str:
    return _near_sql(name) + f" select '{name}' as preset, scenario_id, count(*) as n, {r('max(distance)', 8)} as reach from nr group by 2"


@query("exploration_presets", " union all ".join(f"({_counts(p)})" for p in cases.PRESETS))
def exploration_presets(spark, sf):
    df, out = views.process(spark, sf).drop("l_linestatus"), None
    for name, found in cases.nearest_by_preset(df, views.scenarios(spark), X, FLAG, order=ORDER).items():
        near = found.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("reach"))
        near = near.select(F.lit(name).alias("preset"), "scenario_id", "n", "reach")
        out = near if out is None else out.unionByName(near)
    return rounded(out, 8, "reach")


def _flag_sql(c: str) -> str:
    gap = f"abs({c} - q_{c}) / greatest(abs(q_{c}), 1e-6)"
    return (
        f"select scenario_id, cast(rank as integer) as rank, '{c}' as \"column\", case when {gap} > 0.05 then 'large' when {gap} > 0.01 then 'small' "
        f"when {gap} is not null then 'same' else 'unknown' end as flag from nr join s using (scenario_id) where rank <= 20"
    )


@query(
    "case_difference_flags",
    _near_sql("balanced") + " " + " union all ".join(_flag_sql(c) for c in X)
    + " union all select scenario_id, cast(rank as integer), 'l_returnflag', case when l_returnflag is not distinct from q_l_returnflag then 'same' "
    "else 'differs' end from nr join s using (scenario_id) where rank <= 20",
)
def case_difference_flags(spark, sf):
    return cases.difference_flags(_nearest(spark, sf, "balanced"), views.scenarios(spark), X, FLAG)


# --- coverage ------------------------------------------------------------------------------------------

_A, _B = PAIR
_COVER = _SRC + (
    ", tn as materialized (select * from src where l_orderkey % 5 <> 0), "
    f"cv as (select avg({_A}) as ma, avg({_B}) as mb, var_samp({_A}) as va, var_samp({_B}) as vb, covar_samp({_A}, {_B}) as cab from tn), "
    "iv as materialized (select ma, mb, vb / (va * vb - cab * cab) as i11, va / (va * vb - cab * cab) as i22, -cab / (va * vb - cab * cab) as i12 from cv), "
)
_D2 = f"i11 * ({_A} - ma) * ({_A} - ma) + 2 * i12 * ({_A} - ma) * ({_B} - mb) + i22 * ({_B} - mb) * ({_B} - mb)"
_COVER += (
    f"fit as materialized (select quantile_cont({_D2}, 0.9) as p90, quantile_cont({_D2}, 0.975) as p975, "
    f"quantile_cont({_A}, 0.01) as la, quantile_cont({_A}, 0.99) as ua, quantile_cont({_B}, 0.01) as lb, quantile_cont({_B}, 0.99) as ub from tn, iv)"
)


def _coverage(spark, sf):
    df = split(spark, sf)
    return cases.coverage_fit(df.where("not is_test"), PAIR), df.where("is_test")


@query(
    "coverage_fit",
    _COVER + f" select {r('ma', 4)} as mean_1, {r('mb', 6)} as mean_2, {r('i11 * 1e9', 4)} as inv_11, {r('i12 * 1e9', 4)} as inv_12, {r('i22 * 1e3', 6)} as inv_22, "
    f"{r('p90', 6)} as p90, {r('p975', 6)} as p975, {r('la', 4)} as lower_1, {r('ua', 4)} as upper_1, {r('lb', 4)} as lower_2, {r('ub', 4)} as upper_2 from iv, fit",
)
def coverage_fit(spark, sf):
    fit = _coverage(spark, sf)[0].table(spark)
    out = fit.select(
        F.col("mean")[0].alias("mean_1"), F.col("mean")[1].alias("mean_2"), (F.col("inverse")[0][0] * 1e9).alias("inv_11"),
        (F.col("inverse")[0][1] * 1e9).alias("inv_12"), (F.col("inverse")[1][1] * 1e3).alias("inv_22"), "p90", "p975",
        F.col("lower")[0].alias("lower_1"), F.col("upper")[0].alias("upper_1"), F.col("lower")[1].alias("lower_2"), F.col("upper")[1].alias("upper_2"),
    )
    digits = {"mean_1": 4, "mean_2": 6, "inv_11": 4, "inv_12": 4, "inv_22": 6, "p90": 6, "p975": 6}
    return rounded(out, digits | {f"{k}_{i}": 4 for k in ("lower", "upper") for i in (1, 2)})


@query(
    "coverage_level",
    _COVER + f" select l_orderkey, l_linenumber, {r(_D2, 5)} as d2, case when {_D2} <= p90 then 'high' when {_D2} <= p975 then 'medium' else 'low' end as coverage "
    "from src, iv, fit where l_orderkey % 5 = 0",
)
def coverage_level(spark, sf):
    fit, test = _coverage(spark, sf)
    return rounded(cases.with_coverage(test, fit).select(*KEYS, "d2", "coverage"), 5, "d2")


@query(
    "extreme_variables",
    _COVER + f" select l_orderkey, l_linenumber, concat_ws(',', case when {_A} < la or {_A} > ua then '{_A}' end, case when {_B} < lb or {_B} > ub then '{_B}' end) "
    "as extreme_variables from src, fit where l_orderkey % 5 = 0",
)
def extreme_variables(spark, sf):
    fit, test = _coverage(spark, sf)
    out = cases.with_extreme_variables(test, fit)
    return out.select(*KEYS, F.array_join("extreme_variables", ",").alias("extreme_variables"))


# --- projections and maps --------------------------------------------------------------------------------

AXES = ["l_quantity", "blend"]
_BLENDED = "select *, l_quantity + l_discount * 500 + l_tax * 625 as blend from src"
_PCA = (
    f", bl as materialized ({_BLENDED}), pm as (select avg(l_quantity) as m1, avg(blend) as m2, "
    "0.5 * atan2(2 * covar_samp(l_quantity, blend), var_samp(l_quantity) - var_samp(blend)) as t from bl), "
    "ax as materialized (select m1, m2, "
    "case when (abs(cos(t)) >= abs(sin(t)) and cos(t) < 0) or (abs(cos(t)) < abs(sin(t)) and sin(t) < 0) then -1 else 1 end as g1, "
    "case when (abs(sin(t)) >= abs(cos(t)) and -sin(t) < 0) or (abs(sin(t)) < abs(cos(t)) and cos(t) < 0) then -1 else 1 end as g2, t from pm)"
)
_PC1 = "g1 * (cos(t) * (l_quantity - m1) + sin(t) * (blend - m2))"
_PC2 = "g2 * (-sin(t) * (l_quantity - m1) + cos(t) * (blend - m2))"


def _blended(spark, sf):
    return views.process(spark, sf).withColumn("blend", F.expr("l_quantity + l_discount * 500 + l_tax * 625"))


@query("pca_projection", _SRC + _PCA + f" select l_orderkey, l_linenumber, {r(_PC1, 5)} as pc1, {r(_PC2, 5)} as pc2 from bl, ax")
def pca_projection(spark, sf):
    df = _blended(spark, sf)
    out = cases.project(df, cases.pca_fit(df, AXES)).select(*KEYS, "pc1", "pc2")
    return rounded(out, 5, "pc1", "pc2")


@query(
    "projection_neighbors",
    _near_sql("balanced") + _PCA + f", nb as (select *, l_quantity + l_discount * 500 + l_tax * 625 as blend from nr) "
    f"select scenario_id, cast(rank as integer) as rank, {r(_PC1, 5)} as pc1, {r(_PC2, 5)} as pc2 from nb, ax",
)
def projection_neighbors(spark, sf):
    df = _blended(spark, sf)
    fit = cases.pca_fit(df, AXES)
    near = _nearest(spark, sf, "balanced").withColumn("blend", F.expr("l_quantity + l_discount * 500 + l_tax * 625"))
    return rounded(cases.project(near, fit).select("scenario_id", "rank", "pc1", "pc2"), 5, "pc1", "pc2")


def _cell_sql(c: str, lo: str, hi: str, bins: int = 60) -> str:
    step = f"(({hi} - {lo}) / {bins})"
    g = f"least(floor(({c} - {lo}) / ({hi} - {lo}) * {bins}), {bins - 1})"
    return f"cast(case when {c} < {lo} + {g} * {step} then {g} - 1 when {c} >= {lo} + ({g} + 1) * {step} and {g} < {bins - 1} then {g} + 1 else {g} end as integer)"


@query(
    "grid_mean_map",
    _SRC + f", e as (select min({_A}) as a0, max({_A}) as a1, min({_B}) as b0, max({_B}) as b1 from src) "
    f"select {_cell_sql(_A, 'a0', 'a1')} as cx, {_cell_sql(_B, 'b0', 'b1')} as cy, {r('avg(charge)', 1)} as mean_y, count(*) as n from src, e group by 1, 2",
)
def grid_mean_map(spark, sf):
    return rounded(cases.grid_mean_map(views.process(spark, sf), _A, _B, Y), 1, "mean_y")


@query(
    "variable_ranges",
    _SRC + " " + " union all ".join(
        f"select '{c}' as \"column\", min({c}) as min, max({c}) as max, {r(f'quantile_cont({c}, 0.5)', 6)} as median, "
        f"{r(f'case when max({c}) > min({c}) then (max({c}) - min({c})) / 100 else 0.01 end', 8)} as step from src" for c in X
    ),
)
def variable_ranges(spark, sf):
    return rounded(cases.variable_ranges(views.process(spark, sf), X), {"median": 6, "step": 8})


