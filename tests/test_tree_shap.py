from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

from plantscope.operators import models, tree_shap


def path_value(nodes, x, coalition):
    """Path-dependent value of a coalition for one tree: follow x on its features, else weigh both children by their counts."""
    by_id = {int(r.id): r for r in nodes.itertuples()}

    def walk(at):
        r = by_id[at]
        if r.left < 0:
            return r.prediction
        if int(r.feature) in coalition:
            xv = x[int(r.feature)]
            return walk(int(r.left) if not np.isnan(xv) and xv <= r.threshold else int(r.right))
        return (by_id[int(r.left)].count * walk(int(r.left)) + by_id[int(r.right)].count * walk(int(r.right))) / r.count

    return walk(0)


def brute_force(model, spark, x, weights):
    nodes = tree_shap._node_table(model, spark)
    p = len(x)
    phi = np.zeros(p)
    for tree, rows in nodes.groupby("tree"):
        v = lambda s: weights[int(tree)] * path_value(rows, x, set(s))
        for i in range(p):
            others = [j for j in range(p) if j != i]
            for k in range(p):
                for s in combinations(others, k):
                    phi[i] += factorial(k) * factorial(p - k - 1) / factorial(p) * (v(s + (i,)) - v(s))
    return phi


@pytest.mark.parametrize("kind", ["gbt", "forest", "tree"])
def test_tree_shapley_equals_brute_force_and_adds_up(spark, kind):
    r = np.random.default_rng(3)
    n, p = 400, 4
    x = r.normal(size=(n, p)).round(1)
    x[::37, 2] = np.nan
    y = x[:, 0] * 2 + np.where(x[:, 1] > 0, 1.0, -1.0) * x[:, 3] + r.normal(scale=0.1, size=n)
    cols = [f"c{j}" for j in range(p)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) + (float(t), k) for k, (row, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", y double, id long")
    learner = {"gbt": GBTRegressor(maxIter=5, maxDepth=3, seed=1), "forest": RandomForestRegressor(numTrees=4, maxDepth=4, seed=1),
               "tree": DecisionTreeRegressor(maxDepth=5)}[kind]
    model = learner.setFeaturesCol("features").setLabelCol("label").fit(models.assemble(df.dropna(), cols, "y"))
    got = tree_shap.tree_shapley(df, cols, model, keep=["id"]).toPandas().sort_values("id")
    predicted = model.transform(models.assemble(df, cols, "y", keep=["id"])).toPandas().sort_values("id")["prediction"].to_numpy()
    phi = got[[f"phi_{c}" for c in cols]].to_numpy()
    assert np.allclose(phi.sum(axis=1) + got["expected"].to_numpy(), predicted)
    weights = list(model.treeWeights) if kind == "gbt" else [1.0 / model.getNumTrees] * model.getNumTrees if kind == "forest" else [1.0]
    for k in (0, 5, 37, 111):
        assert np.allclose(phi[k], brute_force(model, spark, x[k], weights))
    assert len(got) == n


def test_values_looked_up_by_pattern_are_those_worked_out_row_by_row(spark, monkeypatch):
    r = np.random.default_rng(8)
    groups = {}
    for d in (1, 2, 4):
        feats = np.array([np.sort(r.choice(5, d, replace=False)) for _ in range(150)])
        lo = np.where(r.random((150, d)) < 0.3, -np.inf, r.normal(size=(150, d)))
        hi = np.where(r.random((150, d)) < 0.3, np.inf, np.where(np.isinf(lo), 0.0, lo) + 1.0)
        groups[d] = (feats, lo, hi, r.random((150, d)), r.normal(size=150))
    paths = tree_shap.Paths(groups, 0.0, 5)
    x = r.normal(size=(2100, 5))
    x[::9, 2] = np.nan
    got = tree_shap.shapley_matrix(x, paths)
    monkeypatch.setattr(tree_shap, "MOST_TABLED", 0)
    assert np.allclose(got, tree_shap.shapley_matrix(x, paths), rtol=1e-12, atol=1e-12)


def test_one_file_is_explained_on_all_cores(spark):
    df = spark.range(40).selectExpr("cast(id as double) as a", "cast(id % 7 as double) as b", "cast(id * 2 as double) as y").coalesce(1)
    model = models.random_forest(2, depth=2).fit(models.assemble(df, ["a", "b"], "y"))
    assert tree_shap.tree_shapley(df, ["a", "b"], model).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
