"""Queries: model benchmark, ranking, consensus, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.operators import cases, linear, models, tree_shap
from plantscope.operators.cleaning import complete_cases
from plantscope.plans import views
from plantscope.plans.catalog import query, r, rounded
from plantscope.plans.least_squares_sql import least_squares
from plantscope.plans.regression import TEST, TRAIN, split
from plantscope.plans.views import KEYS, NUMERIC, PROCESS_SQL, SCENARIOS_SQL, X, Y
from plantscope.session import local_table

# A roster that SQL can fit too: one straight line per variable, and one on the line number.
LINES = [*X, "l_linenumber"]
_SRC = f"with src as materialized ({PROCESS_SQL})"
_LINES = _SRC + f", tn as materialized ({TRAIN}), te as materialized ({TEST}), " + (
    "sc as materialized (" + " union all ".join(
        f"select '{c}' as model, s as slope, i as intercept, 1 - avg((charge - i - s * {c}) ** 2) / var_pop(charge) as r2, "
        f"avg(i + s * {c}) as mean_prediction from te, (select regr_slope(charge, {c}) as s, regr_intercept(charge, {c}) as i from tn) "
        f"group by s, i" for c in LINES
    ) + ")"
)
_RANKED = ", rk as materialized (select *, row_number() over (order by r2 desc, model) as rank, count(*) over () as k from sc)"
_WEIGHTS = _RANKED + (
    ", wt as materialized (select model, r2, mean_prediction, case when sum(greatest(r2, 0)) over () = 0 then 1.0 / count(*) over () "
    "else greatest(r2, 0) / sum(greatest(r2, 0)) over () end as weight from rk where rank <= 4)"
)
_PREDICTED = (
    f", sn as ({SCENARIOS_SQL}), pl as (" + " union all ".join(
        f"select scenario_id, '{c}' as model, intercept + slope * {'3' if c == 'l_linenumber' else c} as predicted from sn, sc where model = '{c}'"
        for c in LINES
    ) + "), pw as materialized (select scenario_id, model, coalesce(predicted, mean_prediction) as predicted, weight from pl join wt using (model))"
)


def _line_models(spark, sf):
    """Straight lines on single variables, all from one set of cross-products."""
    df = split(spark, sf)
    df = df.withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    parts = linear.split_grams(df, Y, LINES)
    train, test = parts.train, parts.test
    fits = [linear.solve_least_squares(train.pick([Y, c]), Y, c) for c in LINES]
    rows = []
    for f, c in zip(fits, LINES):
        s = linear.score(f, test.pick([Y, c]))
        mean = f.intercept + f.coef[c] * float(test.pick([c]).mean[0])
        rows.append((c, float(s["r2"]), mean, s["n"]))
    return fits, local_table(spark, rows, "model string, r2 double, mean_prediction double, n long")


def _line_predictions(spark, fits):
    rows = views.scenarios(spark).withColumn("l_linenumber", F.lit(3.0))
    marks = [F.struct(F.lit(f.name).alias("model"), f.predict().alias("predicted")) for f in fits]
    return rows.select("scenario_id", F.inline(F.array(*marks)))


@query("floor_negative_r2", _LINES + f" select model, {r('r2', 8)} as r2, {r('greatest(r2, 0)', 8)} as r2_floored, r2 < 0 as floored from sc")
def floor_negative_r2(spark, sf):
    out = models.floor_negative(_line_models(spark, sf)[1]).select("model", "r2", "r2_floored", "floored")
    return rounded(out, 8, "r2", "r2_floored")


@query(
    "rank_models",
    _LINES + _RANKED + f" select model, {r('r2', 8)} as r2, cast(rank as integer) as rank, rank = 1 as is_best, rank <= 4 as in_top, "
    "rank > k - 2 as in_bottom from rk",
)
def rank_models(spark, sf):
    return rounded(models.rank_models(_line_models(spark, sf)[1].select("model", "r2")), 8, "r2")


@query(
    "improvement_over_baseline",
    _LINES + _RANKED + f", bs as (select r2 as b from sc where model = 'l_quantity') select model as best_model, {r('r2', 8)} as best_r2, "
    f"{r('b', 8)} as baseline_r2, {r('(r2 - b) * 100', 6)} as points, case when r2 < 0.8 then 'improvable' when r2 < 0.9 then 'good' "
    "else 'excellent' end as grade from rk, bs where rank = 1",
)
def improvement_over_baseline(spark, sf):
    scores = _line_models(spark, sf)[1]
    baseline = scores.where("model = 'l_quantity'").first()["r2"]
    return rounded(models.improvement(scores, baseline), {"best_r2": 8, "baseline_r2": 8, "points": 6})


@query("consensus_weights", _LINES + _WEIGHTS + f" select model, {r('r2', 8)} as r2, {r('weight', 8)} as weight from wt")
def consensus_weights(spark, sf):
    return rounded(models.consensus_weights(_line_models(spark, sf)[1]).drop("mean_prediction"), 8, "r2", "weight")


@query(
    "consensus_prediction",
    _LINES + _WEIGHTS + _PREDICTED + f" select scenario_id, {r('sum(weight * predicted)', 3)} as consensus from pw group by 1",
)
def consensus_prediction(spark, sf):
    fits, scores = _line_models(spark, sf)
    out = models.consensus_prediction(_line_predictions(spark, fits), models.consensus_weights(scores))
    return rounded(out, 3, "consensus")


@query(
    "consensus_spread",
    _LINES + _WEIGHTS + _PREDICTED + ", cs as (select *, sum(weight * predicted) over (partition by scenario_id) as consensus from pw) "
    f"select scenario_id, model, {r('predicted', 3)} as predicted, {r('consensus', 3)} as consensus, {r('abs(predicted - consensus)', 3)} as gap, "
    "cast(row_number() over (partition by scenario_id order by abs(predicted - consensus), model) as integer) as nearness from cs",
)
def consensus_spread(spark, sf):
    fits, scores = _line_models(spark, sf)
    out = models.consensus_spread(_line_predictions(spark, fits), models.consensus_weights(scores))
    return rounded(out, 3, "predicted", "consensus", "gap")


@query(
    "linear_fit_scaled",
    _SRC + least_squares("ls", TRAIN, Y, X) + f", te as ({TEST}), pr as (select charge as actual, b0 + "
    + " + ".join(f"b{i} * {c}" for i, c in enumerate(X, 1)) + " as predicted from te, ls) select 'linear_regression' as model, "
    + r("1 - avg((actual - predicted) ** 2) / var_pop(actual)", 7) + " as r2, count(*) as n from pr",
)
def linear_fit_scaled(spark, sf):
    done = _train(spark, sf, {models.LINEAR: models.default_roster()[models.LINEAR]})[0]
    return rounded(done.scores.select("model", "r2", "n"), 7, "r2")


# --- MLlib learners ------------------------------------------------------------------------------------


def _train(spark, sf, roster):
    """Every learner of the roster on the complete training rows, as the regressions take them; a learner that cannot be trained is an error."""
    df = split(spark, sf)
    train = models.assemble(complete_cases(df.where("not is_test"), Y, X), X, Y)
    test = models.assemble(df.where("is_test"), X, Y)
    done = models.benchmark(train, test, roster)
    if failed := [name for name, model in done.models.items() if model is None]:
        raise models.NotTrained(f"not trained, so nothing is compared: {', '.join(failed)}")
    return done, df


@query("rf_fit")
def rf_fit(spark, sf):
    return _train(spark, sf, {"random_forest": models.random_forest(200, depth=8)})[0].scores


@query("gbt_fit")
def gbt_fit(spark, sf):
    return _train(spark, sf, {"boosted_trees": models.boosted_trees(100)})[0].scores


@query("benchmark_models")
def benchmark_models(spark, sf):
    return models.rank_models(_train(spark, sf, models.default_roster())[0].scores)


@query("benchmark_summary")
def benchmark_summary(spark, sf):
    done, df = _train(spark, sf, models.default_roster())
    parts = linear.split_grams(df, Y, X)
    baseline = linear.score(linear.solve_least_squares(parts.train, Y), parts.test)["r2"]
    return models.benchmark_summary(models.floor_negative(done.scores).withColumn("r2", F.col("r2_floored")), baseline)


@query("permutation_importance")
def permutation_importance(spark, sf):
    done, df = _train(spark, sf, {"permutation_base": models.random_forest(150, depth=6, seed=123)})
    test = complete_cases(df.where("is_test"), Y, X)
    return models.permutation_importance(test, X, Y, done.models["permutation_base"], repeats=10)


@query("shapley_importance")
def shapley_importance(spark, sf):
    done, df = _train(spark, sf, {"shapley_base": models.boosted_trees(100, seed=7)})
    # exact tree Shapley values of every test row
    values = tree_shap.tree_shapley(df.where("is_test"), X, done.models["shapley_base"])
    return models.shapley_importance(values, X)


@query(
    "linear_shapley",
    _SRC + least_squares("ls", TRAIN, Y, X) + f", te as ({TEST}), tn as ({TRAIN}), " + "mn as (select "
    + ", ".join(f"avg({c}) as m{i}" for i, c in enumerate(X, 1)) + " from tn) "
    + " union all ".join(f"select '{c}' as variable, {r(f'avg(abs(b{i} * ({c} - m{i})))', 3)} as importance from te, ls, mn" for i, c in enumerate(X, 1)),
)
def linear_shapley(spark, sf):
    df = split(spark, sf)
    train = linear.split_grams(df, Y, X).train
    fit = linear.solve_least_squares(train, Y)
    values = models.linear_shapley(df.where("is_test").select(*X), fit.coef, dict(zip(train.columns, map(float, train.mean))))
    return rounded(models.shapley_importance(values, X), 3, "importance")


@query("score_scenarios")
def score_scenarios(spark, sf):
    """What-if rows: predictions of every model, their consensus, coverage, and the closest past case."""
    done, df = _train(spark, sf, models.default_roster())
    train = df.where("not is_test")
    asked = views.scenarios(spark)
    # An open input takes the mean of the other scenarios, as a model needs every number.
    means = asked.agg(*[F.avg(c).alias(c) for c in X]).first()
    filled = asked.na.fill({c: means[c] for c in X})
    predictions = models.predict_long(models.assemble(filled, X, keep=["scenario_id"]), done.models)
    weights = models.consensus_weights(models.floor_negative(done.scores.where(F.col("model") != models.LINEAR)))
    fitted = cases.coverage_fit(train, X)
    coverage = cases.with_extreme_variables(cases.with_coverage(filled, fitted), fitted)
    nearest = cases.nearest_cases(
        df.select(*KEYS, *NUMERIC, "l_returnflag"), asked, X, ["l_returnflag"], order=[*KEYS, *NUMERIC], **cases.exploration_preset("balanced")
    )
    found = nearest.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_similar"), F.min("distance").alias("d_best"), F.avg(Y).alias("similar_y"))
    return (
        models.consensus_prediction(predictions, weights)
        .join(coverage.select("scenario_id", "coverage", "extreme_variables"), "scenario_id")
        .join(found, "scenario_id", "left")
    )
