import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

from plantscope.operators import models, tree_cells
from plantscope.session import local_table

X = ["a", "b", "c"]


def table(spark, n=3000, seed=5, continuous=False):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 20, n).astype(float), rng.integers(-3, 4, n) * 0.1
    c = rng.exponential(size=n) if continuous else rng.integers(0, 9, n).astype(float)
    y = a * a + 30 * b * (c > 2) + rng.normal(size=n)
    return local_table(spark, list(zip(*(v.tolist() for v in (a, b, c, y)))), "a double, b double, c double, y double")


def predictions(model, train):
    return np.array([r[0] for r in model.transform(train).select(models.PREDICTION).collect()])


@pytest.mark.parametrize("name", ["boosted_trees", "decision_tree"])
def test_cells_give_what_rows_give(spark, name):
    learner = models.default_roster(0.15)[name]
    train = models.assemble(table(spark), X, "y")
    cells = tree_cells.cells_of(train, 32)
    assert cells.count < 1300 and cells.table.agg({"weight": "sum"}).first()[0] == 3000
    by_cells = tree_cells.fit_on_cells(learner, cells)
    np.testing.assert_allclose(predictions(by_cells, train), predictions(learner.fit(train), train), rtol=1e-9, atol=1e-7)


def test_a_tree_grown_from_cells_is_that_of_mllib(spark):
    train = models.assemble(table(spark), X, "y")
    cells = tree_cells.cells_of(train, 32)
    pdf, sizes = cells.table.toPandas(), [len(v) for v in cells.values]
    cell, codes = pdf["cell"].to_numpy(), []
    for size in sizes:
        codes.append(cell % size)
        cell = cell // size
    weight = pdf["weight"].to_numpy()
    nodes = tree_cells.grow(codes, weight, weight * pdf["label"].to_numpy(), sizes, 6).set_index("id")
    at = np.zeros(len(pdf), int)
    for _ in range(6):
        row = nodes.loc[at]
        code = np.stack([*codes, np.zeros(len(pdf))])[row["feature"].to_numpy(), np.arange(len(pdf))]
        at = np.where(row["feature"] < 0, at, np.where(code <= row["cut"], row["left"], row["right"]))
    fitted = DecisionTreeRegressor(maxDepth=6, maxBins=tree_cells.MANY_BINS, weightCol="weight").fit(cells.instances())
    np.testing.assert_allclose(nodes.loc[at]["prediction"], predictions(fitted, cells.instances()), rtol=1e-9)
    assert nodes.loc[0]["weight"] == 3000


def test_a_forest_of_cells_is_as_good_as_mllibs_and_its_trees_draw_rows(spark):
    train, test = (models.assemble(table(spark, seed=s, continuous=True), X, "y") for s in (5, 6))
    learner = models.random_forest(30, depth=8)
    by_cells, by_rows = models.fit(learner, train), learner.fit(train)
    y = np.array([r[0] for r in test.select(models.LABEL).collect()])
    r2 = [1 - np.mean((predictions(m, test) - y) ** 2) / y.var() for m in (by_cells, by_rows)]
    assert r2[0] > 0.98 and r2[0] == pytest.approx(r2[1], abs=0.003)
    assert by_cells.getNumTrees == 30 and by_cells.numFeatures == 3
    np.testing.assert_allclose(by_cells.featureImportances.toArray(), by_rows.featureImportances.toArray(), atol=0.02)
    sizes = [tree.numNodes for tree in by_cells.trees]
    assert len(set(sizes)) > 5  # no two bags alike
    np.testing.assert_allclose(np.mean([predictions(t, test) for t in by_cells.trees[:30]], axis=0), predictions(by_cells, test), rtol=1e-9)


def test_missing_and_constant_columns(spark):
    rows = [(None if i % 5 == 0 else float(i % 7), 1.0, float(i % 7) + 10 * (i % 5 == 0)) for i in range(400)]
    train = models.assemble(local_table(spark, rows, "a double, b double, y double"), ["a", "b"], "y")
    for learner in (models.random_forest(5, depth=4), models.boosted_trees(20, rate=0.5)):
        assert np.isfinite(predictions(models.fit(learner, train), train)).all()


def test_rows_are_used_where_cells_do_not_serve(spark, monkeypatch):
    assert not tree_cells.cell_learner(RandomForestRegressor(numTrees=2))  # columns sampled at every split
    assert tree_cells.cell_learner(models.random_forest(2))
    train = models.assemble(table(spark), X, "y")
    monkeypatch.setattr(tree_cells, "MOST_CELLS", 100)
    assert tree_cells.cells_of(train, 32) is None
    assert models.fit(models.random_forest(2, depth=2), train).getNumTrees == 2
    broken = models.assemble(local_table(spark, [(1.0, None), (2.0, 3.0)], "a double, y double"), ["a"], "y")
    assert tree_cells.cells_of(broken, 32) is None


def test_values_next_to_each_other(spark):
    values = [0.0, 1.0, float(np.nextafter(1.0, 2.0)), float(np.nextafter(np.nextafter(1.0, 2.0), 2.0)), 5.0]
    kept = np.array(tree_cells._apart(values[::-1]))
    middles = (kept[:-1] + kept[1:]) / 2.0
    assert {0.0, 1.0, 5.0} <= set(kept) and (np.diff(middles) > 0).all() and (middles < kept[1:]).all()
    train = models.assemble(local_table(spark, [(v, float(i)) for i, v in enumerate(values * 3)], "a double, y double"), ["a"], "y")
    assert tree_cells.cells_of(train, 32).table.agg({"weight": "sum"}).first()[0] == 15
