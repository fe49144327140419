"""Queries: linear models, terms, variable review."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.operators import huber, linear, models, review, tree_shap
from plantscope.operators.cleaning import complete_cases
from plantscope.operators.gram import gram_by
from plantscope.plans import views
from plantscope.plans.catalog import query, r, rounded
from plantscope.plans.least_squares_sql import least_squares
from plantscope.plans.views import KEYS, NUMERIC, PROCESS_SQL, X, Y

TRAIN = "select * from src where l_orderkey % 5 <> 0"
TEST = "select * from src where l_orderkey % 5 = 0"
_SRC = f"with src as materialized ({PROCESS_SQL})"
_OLS = _SRC + least_squares("ls", TRAIN, Y, X)
_PREDICT = "b0 + " + " + ".join(f"b{i} * {c}" for i, c in enumerate(X, 1))
_TESTED = f", pr as materialized (select l_orderkey, l_linenumber, charge as actual, {_PREDICT} as predicted from ({TEST}), ls)"
_COEF = (
    ", cf as (select '(intercept)' as term, b0 as coef from ls union all "
    + " union all ".join(f"select '{c}', b{i} from ls" for i, c in enumerate(X, 1)) + ")"
)
_TERMS = _COEF + (
    ", te as (" + TEST + "), ac as (select 'ols' as model, term, coef, case term when '(intercept)' then coef "
    + " ".join(f"when '{c}' then coef * (select avg({c}) from te)" for c in X)
    + " end as avg_contribution from cf), "
    "tm as (select *, avg_contribution * 100 / (select sum(avg_contribution) from ac) as ratio from ac), "
    "rk as materialized (select *, row_number() over (order by abs(ratio) desc, term) as rank from tm)"
)


def split(spark, sf):
    return linear.with_holdout(views.process(spark, sf), "l_orderkey")


def _ols(spark, sf):
    parts = linear.split_grams(split(spark, sf), Y, X)
    return parts, linear.solve_least_squares(parts.train, Y)


@query(
    "holdout_split",
    f"select l_orderkey % 5 = 0 as is_test, cast((l_orderkey % 25 - l_orderkey % 5) / 5 as integer) as fold, count(*) as n, "
    f"{r('sum(charge)', 2)} as total from ({PROCESS_SQL}) group by 1, 2",
)
def holdout_split(spark, sf):
    out = split(spark, sf).groupBy("is_test", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(Y).alias("total"))
    return rounded(out, 2, "total")


@query(
    "standardize",
    _SRC + ", m as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in X) + " from src) select l_orderkey, l_linenumber, "
    + ", ".join(f"{r(f'({c} - m_{c}) / s_{c}', 6)} as {c}" for c in X) + " from src, m",
)
def standardize(spark, sf):
    out = linear.standardize(views.process(spark, sf).select(*KEYS, *X), X)
    return rounded(out, 6, *X)


@query("ols_fit", _OLS + _COEF + f" select 'ols' as model, term, {r('coef', 4)} as coef from cf")
def ols_fit(spark, sf):
    return rounded(linear.coefficient_table(spark, [_ols(spark, sf)[1]]), 4, "coef")


@query(
    "regression_metrics",
    _OLS + _TESTED + ", mt as (select count(*) as n, 1 - avg((actual - predicted) ** 2) / var_pop(actual) as r2, "
    "avg(abs(actual - predicted)) as mae, sqrt(avg((actual - predicted) ** 2)) as rmse from pr) "
    f"select n, {r('r2', 8)} as r2, {r('mae', 4)} as mae, {r('rmse', 4)} as rmse, "
    "case when r2 < 0.5 then 'low' when r2 < 0.8 then 'medium' else 'good' end as grade from mt",
)
def regression_metrics(spark, sf):
    model = _ols(spark, sf)[1]
    predicted = linear.predict_table(split(spark, sf).where("is_test"), model)
    return rounded(linear.regression_metrics(predicted), {"r2": 8, "mae": 4, "rmse": 4})


@query("predict_table", _OLS + _TESTED + f" select l_orderkey, l_linenumber, {r('actual', 7)} as actual, {r('predicted', 3)} as predicted from pr")
def predict_table(spark, sf):
    out = linear.predict_table(split(spark, sf).where("is_test"), _ols(spark, sf)[1], KEYS)
    return rounded(out, {"actual": 7, "predicted": 3})


@query(
    "prediction_range",
    _OLS + _TESTED + f" select {r('least(min(actual), min(predicted))', 3)} as low, {r('greatest(max(actual), max(predicted))', 3)} as high, count(*) as n from pr",
)
def prediction_range(spark, sf):
    predicted = linear.predict_table(split(spark, sf).where("is_test"), _ols(spark, sf)[1])
    return rounded(linear.prediction_range(predicted), 3, "low", "high")


def _contributions(spark, sf):
    parts, model = _ols(spark, sf)
    return linear.term_contributions(spark, [model], parts.test)


@query(
    "term_contributions",
    _OLS + _TERMS + f" select model, term, {r('coef', 4)} as coef, {r('avg_contribution', 3)} as avg_contribution, {r('ratio', 6)} as ratio, "
    "cast(rank as integer) as rank from rk",
)
def term_contributions(spark, sf):
    return rounded(_contributions(spark, sf), {"coef": 4, "avg_contribution": 3, "ratio": 6})


@query(
    "term_contributions_compat",
    _OLS + _COEF + f", te as ({TEST}), tn as ({TRAIN}), ac as (select term, case term when '(intercept)' then coef "
    + " ".join(
        f"when '{c}' then coef * (select stddev_pop({c}) from tn) * ((select avg({c}) from te) + (select avg({c}) from tn))" for c in X
    )
    + f" end as a from cf) select term, {r('a * 100 / (select sum(a) from ac)', 6)} as ratio from ac",
)
def term_contributions_compat(spark, sf):
    parts, model = _ols(spark, sf)
    terms = linear.term_contributions(spark, [model], parts.test, parts.train, compat="ols")
    return rounded(terms.select("term", "ratio"), 6, "ratio")


@query(
    "equation_text",
    _OLS + _TERMS + ", tx as (select rank, case when coef >= 0 then '+ ' else '- ' end || case when abs(coef) >= 1e-3 then printf('%.3f', abs(coef)) "
    "when abs(coef) >= 1e-4 then printf('%.4f', abs(coef)) else printf('%.2e', abs(coef)) end || "
    "case when term = '(intercept)' then '' else ' * ' || term end || printf(' (%+.1f%%)', ratio) as part from rk) "
    "select 'ols' as model, 'charge = ' || string_agg(part, ' ' order by rank) as equation from tx",
)
def equation_text(spark, sf):
    return linear.equation_text(_contributions(spark, sf), Y)


@query(
    "waterfall_table",
    _OLS + _TERMS + f" select model, cast(rank as integer) as rank, term, {r('ratio', 6)} as ratio, "
    + r("coalesce(sum(ratio) over (order by rank rows between unbounded preceding and 1 preceding), 0)", 6)
    + f" as start from rk union all select 'ols', cast(max(rank) + 1 as integer), 'charge', {r('sum(ratio)', 6)}, 0.0 from rk",
)
def waterfall_table(spark, sf):
    return rounded(linear.waterfall(_contributions(spark, sf), Y), 6, "ratio", "start")


def _fits(spark, sf):
    parts = linear.split_grams(split(spark, sf), Y, X)
    fits = [linear.solve_least_squares(parts.train, Y), linear.elastic_net_cv(parts), linear.ridge_cv(parts), linear.lasso_cv(parts)]
    return parts, fits


@query("elastic_net_cv")
def elastic_net_cv(spark, sf):
    parts = linear.split_grams(split(spark, sf), Y, X)
    fit = linear.elastic_net_cv(parts)
    table = linear.coefficient_table(spark, [fit])
    return table.withColumn("alpha", F.lit(fit.settings["alpha"])).withColumn("l1_ratio", F.lit(fit.settings["l1_ratio"]))


@query("ridge_cv")
def ridge_cv(spark, sf):
    fit = linear.ridge_cv(linear.split_grams(split(spark, sf), Y, X))
    return linear.coefficient_table(spark, [fit]).withColumn("alpha", F.lit(fit.settings["alpha"]))


@query("lasso_cv")
def lasso_cv(spark, sf):
    fit = linear.lasso_cv(linear.split_grams(split(spark, sf), Y, X))
    return linear.coefficient_table(spark, [fit]).withColumn("alpha", F.lit(fit.settings["alpha"]))


@query("huber_fit")
def huber_fit(spark, sf):
    fit = huber.huber_search(split(spark, sf), Y, X)
    return linear.coefficient_table(spark, [fit]).select(
        "*", *[F.lit(float(fit.settings[k])).alias(k) for k in ("alpha", "epsilon", "scale", "cv_r2")])


@query("best_linear_model")
def best_linear_model(spark, sf):
    parts, fits = _fits(spark, sf)
    return linear.best_model(linear.model_scores(spark, fits, parts.test))


@query("model_comparison_tables")
def model_comparison_tables(spark, sf):
    parts, fits = _fits(spark, sf)
    terms = linear.term_contributions(spark, fits, parts.test)
    names = [m.name for m in fits]
    coef = linear.model_comparison(terms, names, "coef").withColumn("table", F.lit("coef"))
    ratio = linear.model_comparison(terms, names, "ratio").withColumn("table", F.lit("ratio"))
    scores = linear.model_scores(spark, fits, parts.test).select("model", "r2", F.lit("r2").alias("term"))
    r2 = linear.model_comparison(scores, names, "r2").withColumn("table", F.lit("r2"))
    return coef.unionByName(ratio).unionByName(r2)


# --- variable review ---------------------------------------------------------------------------------

BLENDED = ["blend", "l_quantity", "l_discount"]
_BLEND = "select l_quantity + l_discount * 500 + l_tax * 625 as blend, l_quantity, l_discount from lineitem"


@query(
    "vif",
    f"with src as materialized ({_BLEND})"
    + "".join(least_squares(f"l{i}", "select * from src", c, [o for o in BLENDED if o != c]) for i, c in enumerate(BLENDED))
    + " select variable, " + r("vif", 6) + " as vif, case when vif < 5 then 'fine' when vif < 10 then 'caution' else 'severe' end as band from ("
    + " union all ".join(f"select '{c}' as variable, tot / res as vif from l{i}" for i, c in enumerate(BLENDED)) + ")",
)
def vif(spark, sf):
    df = views.process(spark, sf).select(F.expr("l_quantity + l_discount * 500 + l_tax * 625").alias("blend"), "l_quantity", "l_discount")
    return rounded(linear.vif(spark, gram_by(df, BLENDED)[()]), 6, "vif")


@query("lasso_select")
def lasso_select(spark, sf):
    return linear.lasso_select(spark, gram_by(views.process(spark, sf), NUMERIC)[()], Y)


def _forest_shapley(spark, sf, trees: int):
    df = complete_cases(views.process(spark, sf).select(*NUMERIC), Y, X)
    if df.limit(11).count() <= 10:
        raise ValueError("more than 10 rows are needed")
    fit = models.fit(models.random_forest(trees, depth=8, seed=42), models.assemble(df, X, Y))
    # exact tree Shapley values of every row, worked out once for rows on the same side of every split
    values = tree_shap.tree_shapley(tree_shap.rows_alike(df, X, fit), X, fit, keep=["rows"])
    return models.shapley_importance(values, X, "rows")


@query("shap_select")
def shap_select(spark, sf):
    return _forest_shapley(spark, sf, 50).orderBy(F.desc("importance")).limit(3)


@query("variable_review")
def variable_review(spark, sf):
    g = gram_by(views.process(spark, sf), NUMERIC)[()]
    return review.variable_review(
        linear.vif(spark, g.pick(X)), linear.lasso_select(spark, g, Y), _forest_shapley(spark, sf, 50)
    )
