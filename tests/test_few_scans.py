"""Learners and scores that pass over the rows a few times, against those that pass over them for every round and every model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantscope.operators import machine_sums, models, tree_cells, tree_shap
from plantscope.session import local_table

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(900, 3)) * [3.0, 1.0, 100.0] + [0.0, 5.0, 1000.0]
    y = x[:, 0] * x[:, 2] / 50 + x[:, 1] + r.normal(size=900)
    return local_table(spark, [(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double").persist()


def predictions(model, rows):
    return np.array([r[0] for r in model.transform(rows).select(models.PREDICTION).collect()])


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("rounds", [2, 10, 100])
def test_a_machine_trained_on_sums_is_that_of_mllib(spark, df, rounds):
    train = models.assemble(df, X, "y")
    learner = models.default_roster(rounds / 100)["factorization_machine"]
    assert machine_sums.sums_learner(learner, 3) and not machine_sums.sums_learner(learner, machine_sums.MOST_COLUMNS + 1)
    by_sums, by_rows = models.fit(learner, train), learner.fit(train)
    np.testing.assert_allclose(predictions(by_sums, train), predictions(by_rows, train), rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(by_sums.stages[1].factors.toArray(), by_rows.stages[1].factors.toArray(), rtol=1e-7, atol=1e-9)


def test_rounds_of_training_do_not_pass_over_the_rows(spark, df):
    train = models.assemble(df, X, "y")
    for name, most in (("factorization_machine", 12), ("boosted_trees", 40)):
        model, jobs = jobs_of(spark, f"fit {name}", lambda name=name: models.fit(models.default_roster()[name], train))
        assert jobs <= most, name  # 100 rounds
        assert np.isfinite(predictions(model, train)).all()


def test_boosted_trees_keep_their_settings_when_read_back(spark, df, tmp_path):
    train = models.assemble(df, X, "y")
    model = models.fit(models.boosted_trees(7, rate=0.3, seed=9), train)
    assert (model.getNumTrees, model.getMaxIter(), model.getStepSize(), model.getSeed()) == (7, 7, 0.3, 9)
    assert list(model.treeWeights) == [1.0] + [0.3] * 6
    model.write().save(str(tmp_path / "m"))
    np.testing.assert_array_equal(predictions(type(model).load(str(tmp_path / "m")), train), predictions(model, train))


def test_scores_by_cells_are_those_of_rows(spark, df):
    train = models.assemble(df, X, "y")
    test = models.assemble(df.withColumn("y", F.when(F.col("a") < 3, F.col("y"))), X, "y")
    fitted = {
        "forest": models.fit(models.random_forest(7, depth=4), train), "boosted": models.fit(models.boosted_trees(5), train),
        "tree": models.fit(models.default_roster()["decision_tree"], train), "linear": models.fit(models.default_roster()[models.LINEAR], train),
        "none": None,
    }
    got = models._scored(test, fitted, 2.5)
    for name, model in fitted.items():
        rows = test.withColumn(models.PREDICTION, F.lit(2.5)) if model is None else model.transform(test)
        want = rows.agg(models.r2_of(F.col("label"), F.col("prediction")), F.avg("prediction"), F.count(F.lit(1))).first()
        assert got[name]["r2"] == pytest.approx(want[0], rel=1e-9), name
        assert (got[name]["mean"], got[name]["n"]) == (pytest.approx(want[1], rel=1e-9), want[2]), name


def test_nodes_predict_as_their_model(spark, df):
    train = models.assemble(df.withColumn("b", F.when(F.col("b") < 6, F.col("b"))), X, "y")
    x = np.array(train.select("_x0", "_x1", "_x2").toPandas())
    assert np.isnan(x).any()
    for name in ("boosted_trees", "decision_tree", "permutation_base"):
        model = models.fit(models.default_roster(0.05)[name], train)
        np.testing.assert_allclose(tree_cells.tree_nodes(model, spark).predict(x), predictions(model, train), rtol=1e-12, err_msg=name)


def test_predictions_of_all_models_in_one_table(spark, df):
    train = models.assemble(df, X, "y")
    fitted = {n: models.fit(models.default_roster(0.05)[n], train) for n in ("random_forest", "boosted_trees", models.LINEAR)} | {"none": None}
    asked = models.assemble(df.limit(3).withColumn("scenario_id", F.monotonically_increasing_id()), X, keep=["scenario_id"])
    long = models.predict_long(asked, fitted)
    assert long.columns == ["scenario_id", "model", "predicted"]
    found = {(r[0], r[1]): r[2] for r in long.collect()}
    for name, model in fitted.items():
        for r in (asked if model is None else model.transform(asked)).collect():
            assert found[r["scenario_id"], name] == (None if model is None else pytest.approx(r["prediction"], rel=1e-12))
    assert len(found) == 12
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1  # all trees in one pass, their models not sent one by one


def test_shapley_importance_from_rows_alike_is_that_of_all_rows(spark, df):
    coarse = df.select(*[F.round(F.col(c) / 3).alias(c) for c in X], "y").withColumn("b", F.when(F.col("a") < 1, F.col("b")))
    model = models.fit(models.random_forest(6, depth=4), models.assemble(coarse, X, "y"))
    alike = tree_shap.rows_alike(coarse, X, model)
    assert alike.count() < 600 and alike.agg({"rows": "sum"}).first()[0] == 900
    by_cells = models.shapley_importance(tree_shap.tree_shapley(alike, X, model, keep=["rows"]), X, "rows")
    by_rows = models.shapley_importance(tree_shap.tree_shapley(coarse, X, model), X)
    want = {r["variable"]: r["importance"] for r in by_rows.collect()}
    assert {r["variable"]: r["importance"] for r in by_cells.collect()} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize(("name", "rows"), [("shap_select", 3), ("variable_review", 4)])
def test_the_review_trains_on_cells_and_explains_kinds_of_rows(spark, sf_dir, monkeypatch, name, rows):
    from plantscope.plans import regression

    explained, fitted = [], []
    shapley, fit = tree_shap.tree_shapley, models.fit
    monkeypatch.setattr(tree_shap, "tree_shapley", lambda df, *a, **k: explained.append(df.count()) or shapley(df, *a, **k))
    monkeypatch.setattr(models, "fit", lambda learner, *a: fitted.append(learner) or fit(models.random_forest(3, depth=3), *a))
    assert getattr(regression, name)(spark, sf_dir).count() == rows
    assert (fitted[0].getNumTrees(), fitted[0].getMaxDepth()) == (50, 8)
    assert explained[0] < spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() / 2


def test_permuted_cells_are_permuted_rows(spark, df):
    model = models.fit(models.random_forest(6, depth=4), models.assemble(df, X, "y"))
    got = {r["variable"]: r for r in models.permutation_importance(df, X, "y", model, repeats=4).collect()}
    want = {r["variable"]: r for r in models._permuted_rows(df, X, "y", model, 4, models.PERMUTATION_BLOCK).collect()}
    assert set(got) == set(want) == set(X)
    for c in X:  # in one block both take the same permutations
        assert tuple(got[c])[1:] == pytest.approx(tuple(want[c])[1:], rel=1e-9, abs=1e-12)
    small = {r["variable"]: r for r in models.permutation_importance(df, X, "y", model, repeats=20, block=100).collect()}
    for c in X:
        assert small[c]["importance"] == pytest.approx(want[c]["importance"], abs=0.1 * max(w["importance"] for w in want.values()))


def test_permuted_rows_of_trees_are_not_predicted_again(spark, df, monkeypatch):
    model = models.fit(models.random_forest(3, depth=3), models.assemble(df, X, "y"))
    monkeypatch.setattr(type(model), "transform", lambda *a: pytest.fail("rows were predicted one by one"))
    assert models.permutation_importance(df, X, "y", model, repeats=2, block=200).count() == 3


def test_scoring_does_not_bring_forests_into_the_driver(spark, df):
    train = models.assemble(df, X, "y")
    learner = models.random_forest(6, depth=4, seed=31)
    done = models.benchmark(train, train, {"forest": learner})
    model = done.models["forest"]
    assert model._made is None and done.scores.first()["r2"] > 0.5
    assert (model.getMaxDepth(), model.getSeed()) == (4, 31) and model._made is None
    assert model.getNumTrees == 6 and len(model.trees) == 6 and model._made is not None
    assert model._made.uid() == model.uid
    again = models.fit_once(learner, train)
    assert again.uid == model.uid and np.array_equal(predictions(again, train), predictions(model, train))
