import numpy as np

from plantscope.operators import models


def test_a_learner_is_fitted_once_for_the_same_rows_and_settings(spark):
    r = np.random.default_rng(5)
    rows = [(float(a), float(b), float(2 * a - b + r.normal(scale=0.1))) for a, b in r.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    train = models.assemble(df, ["a", "b"], "y")
    first = models.fit_once(models.boosted_trees(5, seed=3), train)
    again = models.fit_once(models.boosted_trees(5, seed=3), models.assemble(df, ["a", "b"], "y"))
    other = models.fit_once(models.boosted_trees(6, seed=3), train)
    assert first.uid == again.uid != other.uid  # read back, not fitted anew
    predicted = [m.transform(train).select("prediction").toPandas()["prediction"].to_numpy() for m in (first, again)]
    assert np.array_equal(*predicted)
    done = models.benchmark(train, train, {"a": models.boosted_trees(5, seed=3), "b": models.random_forest(3, depth=3)})
    assert done.models["a"].uid == first.uid
    assert sorted(r["model"] for r in done.scores.collect()) == ["a", "b"]
