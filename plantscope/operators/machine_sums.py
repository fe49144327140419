"""Factorization machines trained from the sums of one scan.

Of a row, the prediction of a factorization machine takes the columns and the products of two different columns, so the squared loss and
its gradient need only the cross-products of those terms, the constant and the target over the training rows. They are added in one scan by
matrix products in the tasks, and the rounds of gradient descent that MLlib makes, one pass over the rows each, run on them: the same start,
steps and stopping rule, hence the same model up to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.regression import FMRegressionModel, FMRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, LABEL = "features", "label"
#: A scan returns a number for every pair of terms, of which there are about half the square of the columns.
MOST_COLUMNS = 24
# AdamW as MLlib sets it.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def sums_learner(learner: Estimator, columns: int) -> bool:
    """Whether sums serve ``learner``: columns scaled, then a factorization machine on all rows, without penalty."""
    if not isinstance(learner, Pipeline) or len(learner.getStages()) != 2 or columns > MOST_COLUMNS:
        return False
    scaler, machine = learner.getStages()
    return (
        isinstance(scaler, StandardScaler) and isinstance(machine, FMRegressor) and scaler.getInputCol() == FEATURES
        and machine.getFeaturesCol() == scaler.getOutputCol() and machine.getLabelCol() == LABEL and machine.getSolver() == "adamW"
        and machine.getMiniBatchFraction() == 1 and machine.getRegParam() == 0 and machine.getFitIntercept() and machine.getFitLinear()
    )


def _terms(u: np.ndarray) -> np.ndarray:
    """1, the columns, and the products of two different columns."""
    pairs = list(combinations(range(u.shape[1]), 2))
    return np.column_stack([np.ones(len(u)), u, *[u[:, i] * u[:, j] for i, j in pairs]])


def _cross_products(train: DataFrame, cols: Sequence[str], shift: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Cross-products of the terms and the target, last, over the rows of ``train``."""
    size = 2 + len(cols) + len(cols) * (len(cols) - 1) // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for pdf in batches:
            u = (pdf[list(cols)].to_numpy(np.float64) - shift) * factor
            t = np.column_stack([_terms(u), pdf[LABEL].to_numpy(np.float64)])
            total += t.T @ t
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    sums = train.select(LABEL, *cols).mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((size, size))
    for r in sums.collect():  # a row per pair of terms
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def descend(products: np.ndarray, p: int, factors: int, start: np.ndarray, rate: float, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Factors (p x factors), weights and intercept after MLlib's rounds of AdamW on the mean squared error, stopped where they move by less than ``tol``."""
    n = products[0, 0]
    g, b = products[:-1, :-1] / n, products[:-1, -1] / n
    pairs = list(combinations(range(p), 2))
    i, j = (np.array([pair[k] for pair in pairs], np.int64) for k in (0, 1))
    theta = np.concatenate([start, np.zeros(p + 1)])
    m, v, last = np.zeros_like(theta), np.zeros_like(theta), None
    for k in range(1, rounds + 1):
        f = theta[: p * factors].reshape(p, factors)
        both = np.einsum("kf,kf->k", f[i], f[j])
        slope = 2.0 * (g @ np.concatenate([theta[-1:], theta[p * factors : -1], both]) - b)  # of the loss, by the weight of each term
        df = np.zeros_like(f)
        np.add.at(df, i, slope[p + 1 :, None] * f[j])
        np.add.at(df, j, slope[p + 1 :, None] * f[i])
        gradient = np.concatenate([df.ravel(), slope[1 : p + 1], slope[:1]])
        m = BETA1 * m + (1 - BETA1) * gradient
        v = BETA2 * v + (1 - BETA2) * gradient * gradient
        theta = theta - rate * (m / (1 - BETA1**k)) / (np.sqrt(v / (1 - BETA2**k)) + EPSILON)
        if last is not None and np.linalg.norm(theta - last) < tol * max(np.linalg.norm(theta), 1.0):
            break
        last = theta
    return theta[: p * factors].reshape(p, factors), theta[p * factors : -1], float(theta[-1])


def fit_on_sums(learner: Pipeline, train: DataFrame, cols: Sequence[str]) -> PipelineModel:
    """``learner`` (see :func:`sums_learner`) fitted on ``train``; ``cols`` are the doubles behind its features."""
    spark = train.sparkSession
    scaler, machine = learner.getStages()
    scaled = scaler.fit(train)
    p, factors = len(cols), machine.getFactorSize()
    mean, std = scaled.mean.toArray(), scaled.std.toArray()
    shift = mean if scaler.getWithMean() else np.zeros(p)
    factor = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0) if scaler.getWithStd() else np.ones(p)
    products = _cross_products(train, cols, shift, factor)
    if not products[0, 0]:
        raise RuntimeError("no rows to train on")
    random = spark._jvm.java.util.Random(machine.getSeed())
    start = np.array([random.nextGaussian() for _ in range(p * factors)]) * machine.getInitStd()
    f, weights, intercept = descend(products, p, factors, start, machine.getStepSize(), machine.getMaxIter(), machine.getTol())
    sc = spark.sparkContext
    made = FMRegressionModel(spark._jvm.org.apache.spark.ml.regression.FMRegressionModel(
        machine.uid, intercept, _py2java(sc, DenseVector(weights)), _py2java(sc, DenseMatrix(p, factors, f.ravel().tolist(), True))
    ))
    return PipelineModel([scaled, machine._copyValues(made)])
