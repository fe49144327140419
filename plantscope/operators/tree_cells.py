"""Tree learners trained on cells: rows that no candidate split can tell apart, counted together.

A tree splits a column only at candidate thresholds, one less than ``maxBins`` a column, so rows with the same bins in every column
stay together down to the leaf. For squared errors such a cell needs only its weight and its mean: what its rows differ by is in
every node they pass, and drops out of each gain. The cells are one aggregate over the rows, at most the product of the columns' bins and
never more than the rows; what follows runs on them however many rows there are.

* A decision tree is MLlib's own, fitted on cells weighted by their rows. A cell holds one value per column, set so that
  MLlib's midpoints between them are the thresholds that made the cells.
* Boosted trees are grown from the cells in one task, round by round as MLlib does: each tree on twice what the trees before it leave over.
* Every tree of a forest draws each row a Poisson number of times. Rows are drawn in Arrow batches; for each tree only the drawn weights and
  sums by cell are kept, shuffled by tree, and each tree is grown from its cells level by level. The nodes are written in the form in which MLlib saves them, and read back as its model.
* A fitted tree tells rows apart only by its split points, so rows between the same split points of all models are one cell again: predictions and
  Shapley values are worked out once a cell (:func:`alike`).

Where there are more than ``MOST_CELLS`` cells, or a learner is set up otherwise, it is fitted on the rows.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plantscope.functions.numeric import clean
from plantscope.session import materialize, scratch_path, spread

FEATURES, LABEL = "features", "label"
TREES = (DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel)
#: Cells of one tree are held by one task, about 30 bytes each.
MOST_CELLS = 1_000_000
#: Cells in a partition of the table that MLlib passes over.
CELLS_A_TASK = 20_000
#: Nodes of a model that every task may hold, about 30 bytes each.
MOST_NODES = 4_000_000
#: High enough that MLlib looks at every cell for its thresholds, not at a sample (it takes maxBins ** 2 rows).
MANY_BINS = 1024


def cell_learner(learner: Estimator) -> bool:
    """Whether cells serve ``learner``: squared errors, every column tried at every split, and no stopping rule beyond depth."""
    if not isinstance(learner, (DecisionTreeRegressor, GBTRegressor, RandomForestRegressor)):
        return False
    plain = (
        learner.getFeaturesCol() == FEATURES and learner.getLabelCol() == LABEL and not learner.isDefined(learner.weightCol)
        and learner.getImpurity() == "variance" and learner.getMinInfoGain() == 0 and learner.getMinInstancesPerNode() == 1
        and learner.getMinWeightFractionPerNode() == 0 and learner.getMaxBins() < MANY_BINS and not learner.getLeafCol()
    )
    if isinstance(learner, RandomForestRegressor):
        plain = plain and learner.getBootstrap() and learner.getFeatureSubsetStrategy() == "all"
    if isinstance(learner, GBTRegressor):
        plain = plain and learner.getLossType() == "squared" and learner.getFeatureSubsetStrategy() == "all" and not learner.isDefined(learner.validationIndicatorCol)
    return plain and (isinstance(learner, DecisionTreeRegressor) or learner.getSubsamplingRate() == 1)


@dataclass(frozen=True)
class Cells:
    """``rows`` (cell, label) and ``table`` (cell, label, weight); per column the values that stand for its bins."""

    rows: DataFrame
    table: DataFrame
    count: int
    values: tuple[tuple[float, ...], ...]

    def thresholds(self) -> list[np.ndarray]:
        return [(np.array(v[:-1]) + np.array(v[1:])) / 2.0 for v in self.values]

    def instances(self) -> DataFrame:
        """features, label, weight of every cell."""
        place, digits = F.col("cell"), []
        for v in self.values:
            digits.append(F.element_at(F.array(*[F.lit(x) for x in v]), (place % len(v) + 1).cast("int")))
            place = F.floor(place / len(v)) if len(v) > 1 else place
        return self.table.select(array_to_vector(F.array(*digits)).alias(FEATURES), LABEL, "weight")


def wide_columns(df: DataFrame) -> list[str]:
    """The doubles behind ``features`` that :func:`models.assemble` leaves in a frame."""
    return [f"_x{j}" for j in range(len([c for c in df.columns if c.startswith("_x") and c[2:].isdigit()]))]


def _bin_values(df: DataFrame, cols: list[str], bins: int) -> tuple[tuple[float, ...], ...] | None:
    """All values of a column with at most ``bins`` of them, else the middles of ``bins`` equal shares of its rows. Empty columns have none.

    None where a label is no number.
    """
    shares, x = [(k + 0.5) / bins for k in range(bins)], {c: clean(F.col(c)) for c in cols}
    about = df.agg(F.count_if(clean(F.col(LABEL)).isNull()).alias("unlabelled"), *[F.approx_count_distinct(x[c]).alias(c) for c in cols]).first()
    if about["unlabelled"]:
        return None
    # a column of few values is listed; quantiles, which cost most, are taken only of the others
    few = {c for c in cols if about[c] <= 4 * bins}
    some = df.agg(*[
        F.collect_set(x[c]).alias(c) if c in few else F.percentile_approx(x[c], shares, F.lit(10_000)).alias(c) for c in cols
    ]).first()
    found = {c: some[c] or [] for c in cols}
    if over := [c for c in few if len(found[c]) > bins]:
        found |= df.agg(*[F.percentile_approx(x[c], shares, F.lit(10_000)).alias(c) for c in over]).first().asDict()
    return tuple(_apart(found[c]) for c in cols)


def _apart(values: list[float]) -> tuple[float, ...]:
    """The values in order, without those that no threshold can tell from the one before."""
    out, last = [], -np.inf
    for v in sorted(values):
        middle = (out[-1] + v) / 2.0 if out else None
        if middle is not None:
            if not last < middle < v:
                continue
            last = middle
        out.append(v + 0.0)
    return tuple(out)


def cells_of(train: DataFrame, bins: int) -> Cells | None:
    """Cells of a frame of :func:`models.assemble`, or None where rows are needed: labels that are no numbers, or too many cells."""
    cols = wide_columns(train)
    if cols:
        wide = train.select(F.col(LABEL), *cols)
    else:
        first = train.select(FEATURES).first()
        if first is None or first[0] is None:
            return None
        cols = [f"v{j}" for j in range(first[0].size)]
        x = vector_to_array(F.col(FEATURES))
        wide = train.select(F.col(LABEL), *[x[j].alias(c) for j, c in enumerate(cols)])
    values = _bin_values(wide, cols, bins)
    if values is None or not all(values) or np.prod([float(len(v)) for v in values]) >= 2.0**62:
        return None
    binned, cell = _binned(wide, cols, [(np.array(v[:-1]) + np.array(v[1:])) / 2.0 for v in values])
    rows = binned.select(cell.alias("cell"), LABEL)
    table = materialize(rows.groupBy("cell").agg(F.avg(LABEL).alias(LABEL), F.count(F.lit(1)).cast("double").alias("weight")), "cells")
    count = table.count()
    return Cells(rows, table, count, values) if 1 < count <= MOST_CELLS else None


def _binned(df: DataFrame, cols: Sequence[str], cuts: Sequence[np.ndarray]) -> tuple[DataFrame, Column]:
    """``df`` with the bins of its columns between ascending cuts, and the number of the cell they make."""
    # a value equal to a threshold goes left, as it does in a fitted tree; one that is no number lies above every threshold
    split = {c: [-np.inf, *map(float, np.nextafter(k, np.inf)), np.inf] for c, k in zip(cols, cuts) if len(k)}
    out = df
    if split:
        outputs = [f"b_{c}" for c in split]
        out = Bucketizer(splitsArray=list(split.values()), inputCols=list(split), outputCols=outputs, handleInvalid="keep").transform(df)
    cell, unit = F.lit(0).cast("long"), 1
    for c, k in zip(cols, cuts):
        if c in split:
            cell = cell + F.least(F.col(f"b_{c}"), F.lit(len(split[c]) - 2.0)).cast("long") * F.lit(unit)
        unit *= len(k) + 1
    return out, cell


class CellSource:
    """Cells of one training frame, made when first asked for and shared by its learners."""

    def __init__(self, train: DataFrame):
        self.train, self.lock, self.made = train, threading.Lock(), {}

    def get(self, bins: int) -> Cells | None:
        with self.lock:
            if bins not in self.made:
                self.made[bins] = cells_of(self.train, bins)
            return self.made[bins]


def fit_on_cells(learner: Estimator, cells: Cells, path: str | None = None) -> Model:
    """``learner`` (see :func:`cell_learner`) fitted on cells. Ensembles are saved to ``path`` or a scratch folder, their ``saved_at``."""
    if isinstance(learner, RandomForestRegressor):
        return _forest(learner, cells, path or scratch_path(cells.table.sparkSession, "forest"))
    if isinstance(learner, GBTRegressor):
        return _boosted(learner, cells, path or scratch_path(cells.table.sparkSession, "boosted"))
    instances = cells.instances().coalesce(max(1, cells.count // CELLS_A_TASK)).persist()
    try:
        return learner.copy({learner.weightCol: "weight", learner.maxBins: MANY_BINS}).fit(instances)
    finally:
        instances.unpersist()


# --- forests -------------------------------------------------------------------------------------


def _draws(trees: int, seed: int):
    """For every tree, weight and sum of the drawn rows by cell, packed: a row per batch and tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed & 0xFFFFFFFF, TaskContext.get().partitionId()])
        for pdf in batches:
            if not len(pdf):
                continue
            cell, first = np.unique(pdf["cell"].to_numpy(np.int64), return_index=True)  # rows come in order of their cells
            drawn = rng.poisson(1.0, (len(pdf), trees)).astype(np.float64)
            weight = np.add.reduceat(drawn, first, axis=0)
            drawn *= pdf[LABEL].to_numpy(np.float64)[:, None]
            total = np.add.reduceat(drawn, first, axis=0)
            out = []
            for t in range(trees):
                some = np.flatnonzero(weight[:, t])
                out.append((t, cell[some].tobytes(), weight[some, t].tobytes(), total[some, t].tobytes()))
            yield pd.DataFrame(out, columns=["treeID", "cell", "weight", "total"])

    return run


def grow(codes: list[np.ndarray], weight: np.ndarray, total: np.ndarray, sizes: list[int], depth: int) -> pd.DataFrame:
    """Nodes of one tree, level by level, from cells: their bin in every column, weight and sum. ``threshold`` is the last bin on the left."""
    mean = total.sum() / weight.sum()
    total = total - mean * weight  # centred, so that squares do not drown the gains
    square = total * total / weight
    floor = 1e-14 * square.sum()
    node, done, ids = np.zeros(len(weight), np.int64), [], 1
    open_ids = np.zeros(1, np.int64)
    for level in range(depth + 1):
        m = len(open_ids)
        w, s, q = (np.bincount(node, x, m) for x in (weight, total, square))
        best, column, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        if level < depth:
            for j, size in enumerate(sizes):
                at = node * size + codes[j]
                left, sums = (np.cumsum(np.bincount(at, x, m * size).reshape(m, size), axis=1)[:, :-1] for x in (weight, total))
                right = w[:, None] - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = sums**2 / left + (s[:, None] - sums) ** 2 / right - (s**2 / w)[:, None]
                gain[(left <= 0) | (right <= 0)] = -1.0
                if size > 1:
                    k = np.argmax(gain, axis=1)
                    top = gain[np.arange(m), k]
                    better = (top > best) & (top > floor)
                    best[better], column[better], cut[better] = top[better], j, k[better]
        split = column >= 0
        rank = np.cumsum(split) - 1
        children = ids + 2 * rank
        done.append(pd.DataFrame({
            "id": open_ids, "prediction": s / w + mean, "weight": w, "total": s + mean * w, "square": q + 2 * mean * s + mean**2 * w,
            "impurity": np.maximum(q / w - (s / w) ** 2, 0.0), "gain": np.where(split, best / w, -1.0), "left": np.where(split, children, -1),
            "right": np.where(split, children + 1, -1), "feature": column, "cut": np.where(split, cut, -1),
        }))
        if not split.any():
            break
        open_ids = ids + np.arange(2 * int(split.sum()))
        ids += len(open_ids)
        stay = split[node]
        node, weight, total, square = node[stay], weight[stay], total[stay], square[stay]
        codes = [c[stay] for c in codes]
        mine = np.choose(column[node], codes) if len(codes) < 32 else np.stack(codes)[column[node], np.arange(len(node))]
        node = 2 * rank[node] + (mine > cut[node])
    return pd.concat(done, ignore_index=True)


_NODES = (
    "treeID int, id int, prediction double, weight double, total double, square double, impurity double, gain double, left int, right int, "
    "feature int, threshold double"
)


def _trees(sizes: list[int], thresholds: list[np.ndarray], depth: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, weight, total = (np.concatenate([np.frombuffer(b, kind) for b in pdf[c]]) for c, kind in (("cell", "<i8"), ("weight", "<f8"), ("total", "<f8")))
        cell, of = np.unique(cell, return_inverse=True)
        weight, total = np.bincount(of, weight), np.bincount(of, total)
        codes = _codes(cell, sizes)
        nodes = grow(codes, weight, total, sizes, depth)
        nodes["threshold"] = [thresholds[f][k] if f >= 0 else 0.0 for f, k in zip(nodes["feature"], nodes.pop("cut"))]
        nodes["treeID"] = pdf["treeID"].iloc[0]
        return nodes

    return run


def _forest(learner: RandomForestRegressor, cells: Cells, path: str) -> RandomForestRegressionModel:
    spark = cells.table.sparkSession
    trees, width = learner.getNumTrees(), len(cells.values)
    # a cell of very many rows is spread over tasks; its sums meet again in the trees
    rows = cells.rows.hint("rebalance", "cell").sortWithinPartitions("cell", LABEL)
    drawn = rows.mapInPandas(_draws(trees, learner.getSeed()), "treeID int, cell binary, weight binary, total binary")
    sizes = [len(v) for v in cells.values]
    nodes = drawn.groupBy("treeID").applyInPandas(_trees(sizes, cells.thresholds(), learner.getMaxDepth()), _NODES)
    # settings and tree list of a forest fitted on two rows, nodes from above
    settings = scratch_path(spark, "settings")
    learner.fit(_two_rows(spark, width)).write().save(settings)
    trees = spark.read.parquet(f"{settings}/treesMetadata")
    return _saved(RandomForestRegressionModel, path, spark.read.text(f"{settings}/metadata"), trees, nodes)


def _two_rows(spark: SparkSession, width: int) -> DataFrame:
    two = spark.createDataFrame([(float(k),) for k in range(2)], "label double")
    return two.select(LABEL, array_to_vector(F.array_repeat(LABEL, width)).alias(FEATURES))


def _saved(kind: type[Model], path: str, settings: DataFrame, trees: DataFrame, nodes: DataFrame) -> Model:
    """An ensemble written in the form in which MLlib saves it, and read back."""
    leaf = F.col("feature") < 0
    data = nodes.select("treeID", F.struct(
        "id", "prediction", "impurity", F.array("weight", "total", "square").alias("impurityStats"), F.col("weight").cast("long").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(
            F.col("feature").alias("featureIndex"),
            F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"),
        ).alias("split"),
    ).alias("nodeData"))
    settings.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    trees.write.mode("overwrite").parquet(f"{path}/treesMetadata")
    data.write.mode("overwrite").parquet(f"{path}/data")
    return read_saved(kind, path, nodes.sparkSession)


def read_saved(kind: type[Model], path: str, spark: SparkSession) -> Model:
    model = SavedForest(path, spark) if kind is RandomForestRegressionModel else kind.load(path)
    model.saved_at = path
    return model


class SavedForest(RandomForestRegressionModel):
    """A forest read from its saved form when Spark's object is first asked for: many deep trees take hundreds of MB of the driver."""

    def __init__(self, path: str, spark: SparkSession):
        self._made = None
        super().__init__()
        self.saved_at = path
        settings = DefaultParamsReader.loadMetadata(path, spark)
        self._resetUid(settings["uid"])
        DefaultParamsReader.getAndSetParams(self, settings)

    @property
    def _java_obj(self):
        if self._made is None and "saved_at" in self.__dict__:
            self._made = RandomForestRegressionModel.read()._jread.load(self.saved_at)
        return self._made

    @_java_obj.setter
    def _java_obj(self, made):
        self._made = made

    @property
    def trees(self) -> list[DecisionTreeRegressionModel]:  # a property proper, which a search for parameters passes over
        return [DecisionTreeRegressionModel(m) for m in list(self._call_java("trees"))]

    def __del__(self):
        if self._made is not None:
            super().__del__()


# --- boosted trees -------------------------------------------------------------------------------


def _codes(cell: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    codes = []
    for size in sizes:
        codes.append(cell % size)
        cell = cell // size
    return codes


def boost(codes: list[np.ndarray], weight: np.ndarray, label: np.ndarray, sizes: list[int], depth: int, rounds: int, rate: float) -> pd.DataFrame:
    """Nodes of boosted trees of squared errors, from cells; as in MLlib the first tree counts in full and the others by ``rate``."""
    every, place = np.stack(codes), np.arange(len(weight))
    sum_, target, out = np.zeros(len(weight)), label, []
    for t in range(rounds):
        nodes = grow(codes, weight, weight * target, sizes, depth)
        feature, cut, left, right = (nodes[c].to_numpy() for c in ("feature", "cut", "left", "right"))
        at = np.zeros(len(weight), np.int64)
        for _ in range(depth):
            f = feature[at]
            at = np.where(f < 0, at, np.where(every[f, place] <= cut[at], left[at], right[at]))
        sum_ += (rate if t else 1.0) * nodes["prediction"].to_numpy()[at]
        target = 2.0 * (label - sum_)
        out.append(nodes.assign(treeID=t))
    return pd.concat(out, ignore_index=True)


def _boosted(learner: GBTRegressor, cells: Cells, path: str) -> GBTRegressionModel:
    spark = cells.table.sparkSession
    rounds, rate, depth, width = learner.getMaxIter(), learner.getStepSize(), learner.getMaxDepth(), len(cells.values)
    sizes, thresholds = [len(v) for v in cells.values], cells.thresholds()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([p for p in batches if len(p)], ignore_index=True).sort_values("cell")
        codes = _codes(pdf["cell"].to_numpy(np.int64), sizes)
        nodes = boost(codes, pdf["weight"].to_numpy(np.float64), pdf[LABEL].to_numpy(np.float64), sizes, depth, rounds, rate)
        nodes["threshold"] = [thresholds[f][k] if f >= 0 else 0.0 for f, k in zip(nodes["feature"], nodes.pop("cut"))]
        yield nodes[[c.split()[0] for c in _NODES.split(", ")]]

    # settings of one tree fitted on two rows, nodes from above
    one = scratch_path(spark, "settings")
    learner.copy({learner.maxIter: 1}).fit(_two_rows(spark, width)).write().save(one)
    settings = json.loads(spark.read.text(f"{one}/metadata").first()[0])
    settings["paramMap"]["maxIter"] = settings["numTrees"] = rounds
    tree = json.loads(spark.read.parquet(f"{one}/treesMetadata").first()["_2"])
    trees = [(t, json.dumps(tree | {"uid": f"{tree['uid']}_{t}"}), rate if t else 1.0) for t in range(rounds)]
    return _saved(
        GBTRegressionModel, path, spark.createDataFrame([(json.dumps(settings),)], "value string"),
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double"), cells.table.coalesce(1).mapInPandas(run, _NODES),
    )


# --- rows that fitted trees do not tell apart ----------------------------------------------------


@dataclass(frozen=True)
class Nodes:
    """All nodes of a fitted tree model, and the places of the roots; children by place, values with the weight of their tree, -1 as feature of a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of doubles; a missing value (NaN) goes right at every split."""
        out, row = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at, going = np.full(len(x), root), row
            while len(going):
                here = at[going]
                f = self.feature[here]
                going, here, f = going[f >= 0], here[f >= 0], f[f >= 0]
                at[going] = np.where(x[going, f] <= self.threshold[here], self.left[here], self.right[here])
            out += self.value[at]
        return out


def tree_nodes(model: Model, spark: SparkSession) -> Nodes | None:
    """Nodes of a fitted tree model from its saved form, kept with it; None above ``MOST_NODES`` or with splits on categories."""
    if getattr(model, "nodes", None) is not None:
        return model.nodes
    path = getattr(model, "saved_at", None)
    if path is None:
        path = scratch_path(spark, "trees")
        model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    inside = "nodeData." if "nodeData" in data.columns else ""
    data = data.select(
        (F.col("treeID") if "treeID" in data.columns else F.lit(0)).alias("tree"), F.col(f"{inside}id").alias("id"), F.col(f"{inside}prediction").alias("value"),
        F.col(f"{inside}leftChild").alias("left"), F.col(f"{inside}rightChild").alias("right"), F.col(f"{inside}split.featureIndex").alias("feature"),
        F.coalesce(F.try_element_at(F.col(f"{inside}split.leftCategoriesOrThreshold"), F.lit(1)), F.lit(0.0)).alias("threshold"),
        F.col(f"{inside}split.numCategories").alias("categories"),
    )
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max("categories").alias("k")).first()
    if size["n"] > MOST_NODES or size["k"] > 0:
        return None
    t = data.toArrow().to_pandas().sort_values(["tree", "id"])
    tree, place = t["tree"].to_numpy(), np.arange(len(t))
    roots = place[t["id"].to_numpy() == 0]
    first = roots[np.searchsorted(tree[roots], tree)]  # where the nodes of each tree begin; ids are 0, 1, 2, ...
    feature = np.where(t["left"] < 0, -1, t["feature"]).astype(np.int32)
    left, right = ((first + t[c].to_numpy()).astype(np.int32) for c in ("left", "right"))
    weight = np.array(model.treeWeights) if isinstance(model, GBTRegressionModel) else np.full(len(roots), 1.0 / len(roots))
    model.nodes = Nodes(feature, t["threshold"].to_numpy(), left, right, t["value"].to_numpy() * weight[tree], roots)
    return model.nodes


def split_points(models: Sequence[Nodes], width: int) -> list[np.ndarray]:
    """Per column the thresholds of all splits of the trees of ``models``, in order."""
    return [np.unique(np.concatenate([np.zeros(0), *[m.threshold[m.feature == j] for m in models]])) for j in range(width)]


def cells_between(cuts: Sequence[np.ndarray]) -> float:
    return float(np.prod([len(k) + 1.0 for k in cuts]))


def with_cell(df: DataFrame, cols: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """``df``, its columns as doubles ``_v0``, ``_v1``, ... (NaN for missing), and the number of its ``cell`` between the cuts."""
    names = [f"_v{j}" for j in range(len(cols))]
    wide = df.select("*", *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(n) for c, n in zip(cols, names)])
    binned, cell = _binned(wide, names, cuts)
    return binned.withColumn("cell", cell)


def cell_predictions(nodes: Nodes, cuts: Sequence[np.ndarray], spark: SparkSession) -> np.ndarray:
    """The prediction for every cell between the cuts, in order of their numbers, of which there are ``MOST_CELLS`` at most."""
    sizes = [len(k) + 1 for k in cuts]
    middles = [np.append(k, np.inf) for k in cuts]  # a value equal to a threshold goes left
    shipped, count = spark.sparkContext.broadcast(nodes), int(np.prod(sizes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = _codes(pdf["id"].to_numpy(np.int64), sizes)
            yield pdf.assign(p=shipped.value.predict(np.column_stack([m[c] for m, c in zip(middles, codes)])))

    parts = max(1, min(spark.sparkContext.defaultParallelism, count // 1000))
    found = spark.range(0, count, 1, parts).mapInPandas(run, "id long, p double").toArrow()
    out = np.empty(count)
    out[found["id"].to_numpy()] = found["p"].to_numpy()
    return out


def alike(df: DataFrame, cols: Sequence[str], cuts: Sequence[np.ndarray], *aggregates: Column) -> DataFrame:
    """One row for all rows of ``df`` between the same cuts: the number of rows ``rows``, for each column a value in the same bin, the aggregates.

    Written once and spread over the cores. The columns are doubles; a missing value goes right at every split.
    """
    names = [f"_x{j}" for j in range(len(cols))]
    binned = with_cell(df, cols, cuts)
    met = binned.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), *[F.min(f"_v{j}").alias(n) for j, n in enumerate(names)], *aggregates
    )
    return spread(materialize(met, "alike"))


def predicted_once(cells: DataFrame, cols: Sequence[str], models: Sequence[Nodes]) -> DataFrame:
    """``cells`` with the predictions of tree models as ``p0``, ``p1``, ..."""
    shipped = cells.sparkSession.sparkContext.broadcast(list(models))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(cols)].to_numpy(np.float64)
            yield pdf.assign(**{f"p{k}": m.predict(x) for k, m in enumerate(shipped.value)})

    return cells.mapInPandas(run, StructType([*cells.schema.fields, *[StructField(f"p{k}", DoubleType()) for k in range(len(models))]]))
