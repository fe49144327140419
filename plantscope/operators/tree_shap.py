"""Exact Shapley values of MLlib tree ensembles on every row, by path-dependent tree SHAP.

The fitted trees are read back as node tables from MLlib's own saved form (split, threshold, children, prediction
and the count of training rows that reached each node). Each leaf becomes one path: for every feature split on the
way, the interval of values that follows the path, and the share of training rows that followed it (the product of
the children's counts over their parents'). A coalition's value of a tree is the sum over leaves of the leaf value
times, per path feature, the indicator of the interval if the feature is in the coalition, else the share. Every leaf is a
game of its own path features only, so its Shapley values come from the polynomial of the other features' factors,
d * d steps for d features on the path; for few features they are worked out once for each pattern of intervals and looked up. The paths are tables of at most trees times leaves rows; their size is
checked before they are broadcast, and rows are explained in Arrow batches, leaves in chunks, so memory is bounded.
Values of a row add up to its prediction minus the expected value of the ensemble over the training rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plantscope.operators.tree_cells import MOST_CELLS, alike, cells_between, split_points, tree_nodes
from plantscope.session import scratch_dir, spread

#: At most so many leaves are explained in one task; beyond, the ensemble is too large to ship to every task.
MOST_LEAVES = 2_000_000
#: Leaves evaluated at once against a batch of rows.
LEAF_CHUNK = 64
#: Rows evaluated at once, and path features up to which a leaf's values are looked up by which intervals a row lies in.
ROW_CHUNK, MOST_TABLED = 1024, 6


@dataclass(frozen=True)
class Paths:
    """Leaves grouped by their number d of distinct path features: features, lower and upper bounds, shares (each L x d) and values (L)."""

    groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    expected: float
    n_features: int


def _node_table(model, spark: SparkSession) -> pd.DataFrame:
    """treeID, id, prediction, count, left, right, feature, threshold of every node, from the model's saved form."""
    path = f"{scratch_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = "nodeData" if "nodeData" in data.columns else None
    col = (lambda c: F.col(f"nodeData.{c}")) if node else F.col
    tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    table = data.select(
        tree.alias("tree"), col("id").alias("id"), col("prediction").alias("prediction"),
        F.try_element_at(col("impurityStats"), F.lit(1)).alias("count"), col("leftChild").alias("left"), col("rightChild").alias("right"),
        col("split.featureIndex").alias("feature"), F.try_element_at(col("split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"),
        col("split.numCategories").alias("categories"),
    )
    n = table.count()
    if n > 2 * MOST_LEAVES:
        raise ValueError(f"{n} nodes: the ensemble is too large to explain in every task")
    if table.where("categories > 0").limit(1).count():
        raise ValueError("only splits on continuous features are supported")
    out = table.toPandas()
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    return out


def tree_paths(model, n_features: int, spark: SparkSession) -> Paths:
    """The leaf paths of a fitted regression tree, random forest or boosted ensemble, with each tree's weight in its leaf values."""
    if isinstance(model, GBTRegressionModel):
        weights = list(model.treeWeights)
    elif isinstance(model, RandomForestRegressionModel):
        weights = [1.0 / model.getNumTrees] * model.getNumTrees
    elif isinstance(model, DecisionTreeRegressionModel):
        weights = [1.0]
    else:
        raise TypeError(f"{type(model).__name__} is not a tree model")
    nodes = _node_table(model, spark)
    found: dict[int, list[tuple[list[int], list[float], list[float], list[float], float]]] = {}
    expected = 0.0
    for tree, rows in nodes.groupby("tree"):
        by_id = {int(r.id): r for r in rows.itertuples()}
        stack = [(0, {})]  # node, feature: [low, high, share]
        while stack:
            at, bounds = stack.pop()
            r = by_id[at]
            if r.left < 0:
                value = weights[int(tree)] * r.prediction
                feats = sorted(bounds)
                entry = ([*feats], [bounds[f][0] for f in feats], [bounds[f][1] for f in feats], [bounds[f][2] for f in feats], value)
                found.setdefault(len(feats), []).append(entry)
                expected += value * float(np.prod([bounds[f][2] for f in feats]))
                continue
            f, t = int(r.feature), float(r.threshold)
            for child, low, high in ((int(r.left), -np.inf, t), (int(r.right), t, np.inf)):
                lo, hi, share = bounds.get(f, (-np.inf, np.inf, 1.0))
                nxt = dict(bounds)
                nxt[f] = (max(lo, low), min(hi, high), share * by_id[child].count / r.count)
                stack.append((child, nxt))
    groups = {}
    for d, entries in found.items():
        feats, lo, hi, share, value = zip(*entries)
        groups[d] = (np.array(feats, np.int64).reshape(-1, d), np.array(lo).reshape(-1, d), np.array(hi).reshape(-1, d),
                     np.array(share).reshape(-1, d), np.array(value))
    return Paths(groups, expected, n_features)


def _gains(one: np.ndarray, share: np.ndarray, value: np.ndarray) -> Iterator[np.ndarray]:
    """For each path feature, the Shapley values (rows x leaves) of leaves whose intervals hold the rows where ``one`` (rows x leaves x d) is 1."""
    d = one.shape[2]
    weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    for i in range(d):
        # coefficients of prod over the other features of (share + one * t)
        poly = np.zeros((d,) + one.shape[:2])
        poly[0] = 1.0
        for j in range(d):
            if j == i:
                continue
            poly[1:] = poly[1:] * share[:, j] + poly[:-1] * one[:, :, j]
            poly[0] = poly[0] * share[:, j]
        yield np.tensordot(weight, poly, axes=1) * (one[:, :, i] - share[:, i]) * value


def _tabled(x: np.ndarray, phi: np.ndarray, feats, lo, hi, share, value) -> None:
    """Adds leaves of few path features: a leaf's values for each of the 2 ** d patterns of intervals a row can lie in, looked up by pattern."""
    d = feats.shape[1]
    patterns = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(np.float64)
    sets, of = np.unique(feats, axis=0, return_inverse=True)
    for k, names in enumerate(sets):  # leaves of the same features
        leaves = np.flatnonzero(of.ravel() == k)
        for a in range(0, len(leaves), LEAF_CHUNK):
            at = leaves[a : a + LEAF_CHUNK]
            one = np.broadcast_to(patterns[:, None, :], (1 << d, len(at), d))
            tables = [g.T.ravel() for g in _gains(one, share[at], value[at])]  # by leaf, then pattern
            first = np.arange(len(at)) << d
            for b in range(0, len(x), ROW_CHUNK):
                part = x[b : b + ROW_CHUNK]
                place = np.repeat(first[None, :], len(part), axis=0)
                for j, f in enumerate(names):
                    v = part[:, f, None]
                    place += ((v > lo[at, j]) & (v <= hi[at, j])) * (1 << j)
                for f, t in zip(names, tables):
                    phi[b : b + ROW_CHUNK, f] += t[place].sum(axis=1)


def shapley_matrix(x: np.ndarray, paths: Paths) -> np.ndarray:
    """Shapley values (rows x features) of the rows of ``x``; a missing value (NaN) goes right at every split, as in MLlib."""
    x = np.where(np.isnan(x), np.inf, x)
    phi = np.zeros((len(x), paths.n_features))
    for d, group in paths.groups.items():
        if d == 0:
            continue
        if d <= MOST_TABLED:
            _tabled(x, phi, *group)
            continue
        for a in range(0, len(group[4]), LEAF_CHUNK):
            f, l, h, z, v = (y[a : a + LEAF_CHUNK] for y in group)
            vals = x[:, f]  # rows x leaves x d
            one = ((vals > l) & (vals <= h)).astype(np.float64)
            for i, gain in enumerate(_gains(one, z, v)):
                np.add.at(phi.T, f[:, i], gain.T)
    return phi


def rows_alike(df: DataFrame, x: Sequence[str], model, rows: str = "rows") -> DataFrame:
    """The features of ``df``, one row for all rows that the trees of ``model`` do not tell apart, and in ``rows`` how many they are.

    Such rows lie on the same side of every split, so their predictions and Shapley values are the same. Where there may be more than
    ``MOST_CELLS`` kinds, every row stands for itself.
    """
    nodes = tree_nodes(model, df.sparkSession)
    cuts = split_points([nodes], len(x)) if nodes else []
    if nodes is None or cells_between(cuts) > MOST_CELLS:
        return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in x], F.lit(1).cast("long").alias(rows))
    return alike(df, x, cuts).select(*[F.col(f"_x{j}").alias(c) for j, c in enumerate(x)], F.col("rows").alias(rows))


def tree_shapley(df: DataFrame, x: Sequence[str], model, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, the features, ``phi_<feature>`` for every row of ``df``, and ``expected``: the ensemble's mean over its training rows.

    Features are cast to double; NULL is missing and goes right at every split. Values add up to the model's prediction minus
    ``expected``. No row is sampled or dropped.
    """
    paths = tree_paths(model, len(x), df.sparkSession)
    leaves = sum(len(g[4]) for g in paths.groups.values())
    if leaves > MOST_LEAVES:
        raise ValueError(f"{leaves} leaves: the ensemble is too large to explain in every task")
    names = [f"_x{j}" for j in range(len(x))]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(x, names)])
    rows = spread(rows)
    shipped = df.sparkSession.sparkContext.broadcast(paths)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shipped.value
        for pdf in batches:
            phi = shapley_matrix(pdf[names].to_numpy(np.float64, na_value=np.nan), p)
            out = pdf.copy()
            for j in range(len(x)):
                out[f"phi_{j}"] = phi[:, j]
            out["expected"] = p.expected
            yield out

    schema = StructType([*rows.schema.fields, *[StructField(f"phi_{j}", DoubleType()) for j in range(len(x))], StructField("expected", DoubleType())])
    done = rows.mapInPandas(explain, schema)
    return done.select(*[F.col(f"`{c}`") for c in keep], *[F.col(n).alias(c) for c, n in zip(x, names)],
                       *[F.col(f"phi_{j}").alias(f"phi_{c}") for j, c in enumerate(x)], "expected")
