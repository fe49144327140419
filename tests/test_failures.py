"""A learner that could not be trained must not look like one with a score."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.regression import LinearRegression
from py4j.protocol import Py4JJavaError

from plantscope.operators import models
from plantscope.plans import learning
from plantscope.session import local_table


@pytest.fixture
def roster(spark, monkeypatch):
    full = models.default_roster()
    some = {"boosted_trees": models.boosted_trees(3), "decision_tree": full["decision_tree"], models.LINEAR: full[models.LINEAR]}
    monkeypatch.setattr(models, "default_roster", lambda: some)
    monkeypatch.setattr(learning, "X", ["a", "b"])
    monkeypatch.setattr(learning, "Y", "y")
    return some


def frame(spark, gaps=False):
    r = np.random.default_rng(4)
    rows = []
    for k, (a, b) in enumerate(r.normal(size=(400, 2))):
        y = float(3 * a - b + r.normal(scale=0.1))
        rows.append((None if gaps and k % 9 == 0 else float(a), float(b), None if gaps and k % 7 == 0 else y, k % 5 == 0, k % 3))
    return local_table(spark, rows, "a double, b double, y double, is_test boolean, fold int")


def test_rows_with_gaps_are_left_out_and_every_learner_is_trained(spark, monkeypatch, roster):
    df = frame(spark, gaps=True)
    monkeypatch.setattr(learning, "split", lambda spark, sf: df)
    done, _ = learning._train(spark, "", roster)
    scores = {r["model"]: r for r in done.scores.collect()}
    assert all(not r["failed"] and r["r2"] > 0.5 and r["n"] == 80 for r in scores.values())
    row = learning.benchmark_summary(spark, "").first()
    assert row["best_model"] == models.LINEAR and row["best_r2"] > 0.99 and row["baseline_r2"] > 0.99
    assert set(row["scores"]) == set(roster) and min(row["scores"].values()) > 0.5


def test_a_job_that_fails_ends_the_comparison(spark):
    train = models.assemble(frame(spark, gaps=True), ["a", "b"], "y")  # MLlib stops at labels that are missing
    with pytest.raises((PySparkException, Py4JJavaError)):
        models.benchmark(train, train, {"boosted_trees": models.boosted_trees(3)})


def test_a_model_that_cannot_be_written_ends_the_comparison(spark, monkeypatch):
    train = models.assemble(frame(spark), ["a", "b"], "y")

    def no_folder(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")

    monkeypatch.setattr(models, "scratch_dir", no_folder)
    with pytest.raises(RuntimeError, match="checkpoint"):
        models.benchmark(train, train, {"boosted_trees": models.boosted_trees(3)})


def test_queries_refuse_to_go_on_without_a_learner(spark, monkeypatch, roster):
    monkeypatch.setattr(learning, "split", lambda spark, sf: frame(spark))
    roster["wrong"] = LinearRegression(featuresCol="nothing", labelCol="label")
    with pytest.warns(UserWarning, match="wrong"), pytest.raises(models.NotTrained, match="wrong"):
        learning.benchmark_summary(spark, "")


def test_a_summary_gives_no_score_to_a_model_that_failed(spark):
    rows = [("a", 0.4, 1.0, False), ("b", 0.9, 1.0, True), (models.LINEAR, 0.3, 1.0, False)]
    row = models.benchmark_summary(local_table(spark, rows, "model string, r2 double, mean_prediction double, failed boolean"), 0.1).first()
    assert row["best_model"] == "a" and row["scores"] == {"a": 0.4, "b": None, models.LINEAR: 0.3}
    assert [(t["model"], t["weight"]) for t in row["top_models"]] == [("a", 1.0)]


def test_a_model_of_other_rows_is_not_taken_for_this_one(spark, tmp_path):
    """Tables that look alike in their plans: in memory, and a file written anew under its name."""
    learner, path = models.boosted_trees(3, seed=77), str(tmp_path / "t")
    seen = []
    for k in (1.0, 5.0):
        rows = [(float(i % 7), k * (i % 7)) for i in range(200)]
        made = spark.createDataFrame(rows, "a double, y double")
        made.coalesce(1).write.mode("overwrite").parquet(path)
        for df in (local_table(spark, rows, "a double, y double"), made, spark.read.parquet(path)):
            train = models.assemble(df, ["a"], "y")
            model = models.fit_once(learner, train)
            seen.append(model.transform(train).agg({"prediction": "max"}).first()[0] / k)
            assert models.fit_once(learner, models.assemble(df, ["a"], "y")).uid == model.uid
    np.testing.assert_allclose(seen, seen[0])
