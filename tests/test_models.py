import numpy as np
import pytest
from pyspark.sql import functions as F

from plantscope.operators import cases, linear, models, review
from plantscope.operators.gram import gram_by
from plantscope.session import local_table

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3)) * [1, 10, 0.1] + [1000, -5, 3]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=600)
    return np.column_stack([y, x])


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [(i, *map(float, r)) for i, r in enumerate(data)]
    return linear.with_holdout(local_table(spark, rows, "id long, y double, a double, b double, c double"), "id").persist()


def train_rows(data):
    return data[np.arange(len(data)) % 5 != 0]


def test_grams_add_subtract_and_agree_on_both_paths(df, data):
    parts = gram_by(df, ["y", *X], ["is_test", "fold"])
    wide = gram_by(df, ["y", *X], ["is_test", "fold"], narrow=1)
    assert parts.keys() == wide.keys()
    for k in parts:
        assert parts[k].n == wide[k].n
        np.testing.assert_allclose(parts[k].cross, wide[k].cross, rtol=1e-9, atol=1e-9)
    total = gram_by(df, ["y", *X])[()]
    one = parts[(True, 0)]
    rest = total - one
    np.testing.assert_allclose((rest + one).cross, total.cross, rtol=1e-9)
    centred = data - data.mean(0)
    np.testing.assert_allclose(total.cross, centred.T @ centred, rtol=1e-9)


def test_least_squares_and_scores(df, data):
    parts = linear.split_grams(df, "y", X)
    model = linear.solve_least_squares(parts.train, "y")
    t = train_rows(data)
    want = np.linalg.lstsq(np.column_stack([np.ones(len(t)), t[:, 1:]]), t[:, 0], rcond=None)[0]
    np.testing.assert_allclose([model.intercept, *model.coef.values()], want, rtol=1e-6)
    from_rows = linear.regression_metrics(linear.predict_table(df.where("is_test"), model)).first()
    from_sums = linear.score(model, parts.test)
    assert from_rows["r2"] == pytest.approx(from_sums["r2"], abs=1e-9)
    assert from_rows["rmse"] == pytest.approx(from_sums["rmse"], rel=1e-9)


def test_elastic_net_meets_its_optimality_conditions(df, data):
    parts = linear.split_grams(df, "y", X)
    g = parts.train.standardized("y")
    t = train_rows(data)
    z = (t[:, 1:] - t[:, 1:].mean(0)) / t[:, 1:].std(0)
    y = t[:, 0] - t[:, 0].mean()
    for alpha, l1 in [(0.1, 1.0), (1.0, 0.5), (0.01, 0.1)]:
        w = linear.descend(g, "y", alpha, l1)
        slope = z.T @ (y - z @ w) / len(y) - alpha * (1 - l1) * w
        for j in range(3):
            if w[j]:
                assert slope[j] == pytest.approx(alpha * l1 * np.sign(w[j]), abs=1e-7)
            else:
                assert abs(slope[j]) <= alpha * l1 + 1e-9


def test_grid_search_picks_the_smallest_fold_error(df, data):
    parts = linear.split_grams(df, "y", X)
    chosen = linear.elastic_net_cv(parts)
    t = train_rows(data)
    fold = (np.arange(len(data)) % 25 // 5)[np.arange(len(data)) % 5 != 0]
    z = (t[:, 1:] - t[:, 1:].mean(0)) / t[:, 1:].std(0)
    errors = {}
    for l1 in linear.L1_RATIOS:
        for alpha in linear.ALPHAS:
            per_fold = []
            for k in range(5):
                fit = fold != k
                g = parts.train.standardized("y") - parts.folds[k].standardized("y", parts.train)
                w = linear.descend(g, "y", alpha, l1)
                b = t[fit, 0].mean() - z[fit].mean(0) @ w
                per_fold.append(((t[~fit, 0] - b - z[~fit] @ w) ** 2).mean())
            errors[(alpha, l1)] = np.mean(per_fold)
    best = min(errors.values())
    assert chosen.settings["cv_mse"] == pytest.approx(best, rel=1e-6)


def test_contributions_add_up(spark, df):
    parts = linear.split_grams(df, "y", X)
    fits = [linear.solve_least_squares(parts.train, "y"), linear.ridge_cv(parts), linear.lasso_cv(parts)]
    for options in ({}, {"train": parts.train, "compat": "ols"}, {"train": parts.train, "compat": "elastic_net"}):
        terms = linear.term_contributions(spark, fits, parts.test, **options)
        for r in terms.groupBy("model").agg(F.sum("ratio").alias("s")).collect():
            assert r["s"] == pytest.approx(100.0)
    falls = linear.waterfall(linear.term_contributions(spark, fits[:1], parts.test), "y").orderBy("rank").collect()
    assert falls[-1]["term"] == "y" and falls[0]["start"] == 0.0
    assert falls[1]["start"] == pytest.approx(falls[0]["ratio"])


def test_number_text(spark):
    df = local_table(spark, [(1.23456,), (0.00012345,), (0.0000123,)], "v double")
    assert [r[0] for r in df.select(linear.number_text(F.col("v"))).collect()] == ["1.235", "0.0001", "1.23e-05"]


def test_vif(spark, data):
    rows = [(float(r[1]), float(r[2]), float(r[1] + r[2] + r[3]), float(2 * r[3])) for r in data]
    df = local_table(spark, rows, "p double, q double, s double, t double")
    three = linear.vif(spark, gram_by(df, ["p", "q", "s"])[()]).collect()
    corr = np.corrcoef(np.array(rows)[:, :3].T)
    np.testing.assert_allclose([r["vif"] for r in three], np.diag(np.linalg.inv(corr)), rtol=1e-6)
    four = {r["variable"]: r for r in linear.vif(spark, gram_by(df, ["p", "q", "s", "t"])[()]).collect()}
    assert all(r["vif"] == float("inf") and r["band"] == "severe" for r in four.values())


def test_review_codes(spark):
    vif = local_table(spark, [("a", 12.0, "severe"), ("b", 1.0, "fine")], "variable string, vif double, band string")
    lasso = local_table(spark, [("a", 0.5, True, True), ("b", 0.01, True, False)], "variable string, coef double, kept boolean, important boolean")
    shap = local_table(spark, [("a", 2.0), ("b", 1.0)], "variable string, importance double")
    got = {r["variable"]: r["advice"] for r in review.variable_review(vif, lasso, shap).collect()}
    assert got["a"] == ["remove_collinear", "lasso_important", "top_contribution", "build_around"]
    assert got["b"] == ["top_contribution", "build_around"]


def test_shapley_values_add_up_to_the_prediction(spark, df):
    fit = models.random_forest(5, depth=4).fit(models.assemble(df, X, "y"))
    sample, background = models.hash_sample(df, X, 12, 1), models.hash_sample(df, X, 9, 2)
    predict = models.model_predictor(fit, X)
    values = models.shapley_values(sample, background, X, predict)
    base = predict(background).agg(F.avg("prediction")).first()[0]
    rows = predict(values).collect()
    assert len(rows) == 12
    for r in rows:
        assert sum(r[f"phi_{c}"] for c in X) == pytest.approx(r["prediction"] - base, abs=1e-8)


def test_sampled_orders_stay_efficient():
    weights = models.coalition_weights(10, permutations=20)
    total = np.zeros(10)
    for mask, w in weights.items():
        total += np.array(w) * bin(mask).count("1")
    np.testing.assert_allclose(total, 1.0)


def test_permutation_importance_finds_the_driver(df):
    fit = models.random_forest(10, depth=5).fit(models.assemble(df, X, "y"))
    got = {r["variable"]: r["importance"] for r in models.permutation_importance(df, X, "y", fit, repeats=3, block=100).collect()}
    assert got["a"] > 0.3 and abs(got["c"]) < 0.05


def test_failing_learner_falls_back_to_the_mean(df):
    class Broken:
        def fit(self, rows):
            raise RuntimeError("no")

    train, test = models.assemble(df.where("not is_test"), X, "y"), models.assemble(df.where("is_test"), X, "y")
    with pytest.warns(UserWarning):
        done = models.benchmark(train, test, {"broken": Broken()})
    row = done.scores.first()
    assert row["failed"] and row["r2"] <= 0


def test_consensus(spark):
    scores = local_table(
        spark, [("m1", 0.6, 1.0), ("m2", 0.2, 2.0), ("m3", -1.0, 3.0), ("m4", 0.0, 4.0), ("m5", -2.0, 5.0)],
        "model string, r2 double, mean_prediction double",
    )
    weights = models.consensus_weights(scores)
    assert {r["model"]: r["weight"] for r in weights.collect()} == pytest.approx({"m1": 0.75, "m2": 0.25, "m4": 0.0, "m3": 0.0})
    predictions = local_table(spark, [(1, "m1", 10.0), (1, "m2", float("nan")), (1, "m3", 99.0)], "scenario_id int, model string, predicted double")
    assert models.consensus_prediction(predictions, weights).first()["consensus"] == pytest.approx(0.75 * 10 + 0.25 * 2)
    bad = models.consensus_weights(scores.withColumn("r2", F.lit(-1.0)))
    assert {r["weight"] for r in bad.collect()} == {0.25}


def scenario(spark, *rows):
    return local_table(spark, list(rows), "scenario_id int, a double, k string")


def test_nearest_cases_follow_the_threshold(spark):
    rows = [(i, float(i), "u" if i % 2 else "v") for i in range(20)] + [(20, None, "u")]
    df = local_table(spark, rows, "id int, a double, k string")
    sd = np.std(np.arange(20.0))
    got = cases.nearest_cases(df, scenario(spark, (1, 5.25, "u")), ["a"], ["k"], order=["id"], alpha=None, delta=None, k_max=7, k_cap=5).orderBy("rank").collect()
    want = sorted((abs(i - 5.25) / sd + (0 if i % 2 else 1), i) for i in range(20))[:5]
    assert [r["id"] for r in got] == [i for _, i in want]
    assert got[0]["similarity"] == 1.0
    near = cases.nearest_cases(df, scenario(spark, (1, 5.25, None)), ["a"], ["k"], order=["id"], alpha=2.5, delta=None).collect()
    assert {r["id"] for r in near} == {5, 6}
    exact = cases.nearest_cases(df, scenario(spark, (1, 5.0, None)), ["a"], order=["id"], alpha=0.5).collect()
    assert [r["id"] for r in exact] == [5]


def test_many_scenarios_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(cases, "SCENARIOS_AT_ONCE", 3)
    df = local_table(spark, [(i, 1.0, "u") for i in range(300)] + [(999, 2.0, "v")], "id int, a double, k string")
    asked = scenario(spark, *[(s, 1.0, None) for s in range(7)])
    got = cases.nearest_cases(df, asked, ["a"], order=["id"], k_cap=10).groupBy("scenario_id").agg(F.collect_set("id").alias("ids")).collect()
    assert len(got) == 7 and all(sorted(r["ids"]) == list(range(10)) for r in got)


def test_presets():
    assert cases.exploration_preset("Narrow band")["k_cap"] == 20
    assert cases.exploration_preset(None) == cases.PRESETS["balanced"]


def test_coverage_against_numpy(df, data):
    fit = cases.coverage_fit(df, X)
    x = data[:, 1:]
    gap = x - x.mean(0)
    d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.pinv(np.cov(gap, rowvar=False)), gap)
    assert (fit.p90, fit.p975) == pytest.approx(tuple(np.percentile(d2, [90, 97.5])), rel=1e-8)
    levels = {r["coverage"]: r["count"] for r in cases.with_coverage(df, fit).groupBy("coverage").count().collect()}
    assert levels == {"high": 540, "medium": 45, "low": 15}


def test_projection_against_numpy(df, data):
    fit = cases.pca_fit(df, X)
    x = data[:, 1:] - data[:, 1:].mean(0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    got = np.array([[r["pc1"], r["pc2"]] for r in cases.project(df, fit).orderBy("id").collect()])
    want = x @ v[:2].T
    np.testing.assert_allclose(np.abs(got), np.abs(want), rtol=1e-6, atol=1e-7)
    assert fit.explained[0] == pytest.approx((s**2)[0] / (s**2).sum())


def test_importance_on_repeated_rows(spark):
    df = spark.range(6000).selectExpr("cast(id % 2 as double) a", "cast(id % 3 as double) b").selectExpr("a", "b", "5 * a + b as y")
    fitted = models.LinearRegression(featuresCol=models.FEATURES, labelCol=models.LABEL, predictionCol=models.PREDICTION).fit(models.assemble(df, ["a", "b"], "y"))
    got = {r["variable"]: r["importance"] for r in models.permutation_importance(df, ["a", "b"], "y", fitted, repeats=3).collect()}
    assert got["a"] > 1.0 and 0.05 < got["b"] < got["a"]
    assert models.hash_sample(df, ["a", "b"], 200, seed=1).distinct().count() == 6


def test_gram_leaves_incomplete_rows_out(spark):
    df = spark.range(200).selectExpr("cast(id as double) x", "if(id % 4 = 0, null, cast(id * id % 37 as double)) z", "cast(3 * id + id % 5 as double) y")
    whole_rows = df.dropna()
    for narrow in (0, 12):
        got, want = gram_by(df, ["x", "z", "y"], narrow=narrow)[()], gram_by(whole_rows, ["x", "z", "y"], narrow=12)[()]
        assert got.n == want.n == 150 and abs(got.cross - want.cross).max() < 1e-6 * abs(want.cross).max()


@pytest.mark.parametrize("name", ["benchmark_models", "benchmark_summary", "score_scenarios"])
def test_registered_comparisons_train_full_ensembles(spark, sf_dir, monkeypatch, name):
    from plantscope.plans import learning

    class Seen(Exception):
        pass

    def stop(spark, sf, roster):
        raise Seen(roster)

    monkeypatch.setattr(learning, "_train", stop)
    with pytest.raises(Seen) as seen:
        getattr(learning, name)(spark, sf_dir)
    roster = seen.value.args[0]
    assert [(roster[k].getNumTrees(), roster[k].getMaxDepth()) for k in ("random_forest", "permutation_base")] == [(200, 12), (150, 12)]
    assert [roster[k].getMaxIter() for k in ("boosted_trees", "shapley_base")] == [100, 100]
