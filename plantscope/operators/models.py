"""Model roster, ranking, consensus, permutation and Shapley importance on MLlib regressors."""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import PipelineModel
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    FMRegressionModel,
    FMRegressor,
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from plantscope.functions.numeric import all_of, band, clean
from plantscope.operators.machine_sums import fit_on_sums, sums_learner
from plantscope.operators.tree_cells import (
    MOST_CELLS,
    TREES,
    CellSource,
    Nodes,
    alike,
    cell_learner,
    cell_predictions,
    cells_between,
    fit_on_cells,
    predicted_once,
    read_saved,
    split_points,
    tree_nodes,
    wide_columns,
    with_cell,
)
from plantscope.session import local_table, materialize, scratch_dir, spread

FEATURES, LABEL, PREDICTION = "features", "label", "prediction"
LINEAR = "linear_regression"
EXACT_COLUMNS = 8
PERMUTATION_BLOCK = 10_000


def random_forest(trees: int = 200, depth: int = 12, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all", featuresCol=FEATURES, labelCol=LABEL,
        cacheNodeIds=True,
    )


def boosted_trees(rounds: int = 100, rate: float = 0.1, depth: int = 3, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(
        maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, featuresCol=FEATURES, labelCol=LABEL, cacheNodeIds=True
    )


def default_roster(scale: float = 1.0, depth: int = 12) -> dict[str, Estimator]:
    """Six learners and the scaled linear model; ``scale`` shrinks the ensembles.

    A decision tree and a factorization machine fill the places of a kernel
    machine and a neural net, which Spark has no regressor for.
    """

    def size(n: int) -> int:
        return max(1, round(n * scale))

    scaled = StandardScaler(inputCol=FEATURES, outputCol="scaled", withMean=True, withStd=True)
    return {
        "random_forest": random_forest(size(200), depth, 42),
        "boosted_trees": boosted_trees(size(100), seed=42),
        "decision_tree": DecisionTreeRegressor(maxDepth=8, seed=42, featuresCol=FEATURES, labelCol=LABEL),
        "factorization_machine": Pipeline(
            stages=[scaled, FMRegressor(factorSize=4, maxIter=size(100), seed=42, featuresCol="scaled", labelCol=LABEL)]
        ),
        "permutation_base": random_forest(size(150), depth, 123),
        "shapley_base": boosted_trees(size(100), seed=7),
        LINEAR: Pipeline(stages=[scaled, LinearRegression(featuresCol="scaled", labelCol=LABEL, solver="normal")]),
    }


def assemble(df: DataFrame, x: Sequence[str], y: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector, the label when there is one, the kept columns, and the doubles behind the features as ``_x0``, ``_x1``, ... (NaN for missing)."""
    label = [F.col(f"`{y}`").cast("double").alias(LABEL)] if y else []
    out = VectorAssembler(inputCols=list(x), outputCol=FEATURES, handleInvalid="keep").transform(df)
    wide = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"_x{j}") for j, c in enumerate(x)]
    return out.select(*keep, *label, FEATURES, *wide)


@dataclass(frozen=True)
class Trained:
    models: Mapping[str, Model | None]
    scores: DataFrame  # model, r2, mean_prediction, n, failed


def r2_of(actual: Column, predicted: Column) -> Column:
    gap = actual - predicted
    return 1 - F.try_divide(F.avg(gap * gap), F.var_pop(actual))


#: What a learner raises when it cannot be trained. Jobs that fail, lost files and other faults are not among them: they end the comparison.
LEARNER_ERRORS = (IllegalArgumentException, RuntimeError)


class NotTrained(RuntimeError):
    """A learner's own refusal to be trained, told apart from faults around it."""


def _signature(learner: Estimator) -> str:
    """The learner's kind and every parameter, set or default, of each of its stages."""
    stages = learner.getStages() if isinstance(learner, Pipeline) else [learner]
    return "|".join(type(st).__name__ + repr(sorted((p.name, repr(v)) for p, v in st.extractParamMap().items())) for st in stages)


_MODEL_OF = {
    RandomForestRegressor: RandomForestRegressionModel, GBTRegressor: GBTRegressionModel, DecisionTreeRegressor: DecisionTreeRegressionModel,
    LinearRegression: LinearRegressionModel, FMRegressor: FMRegressionModel, Pipeline: PipelineModel,
}


def rows_key(df: DataFrame) -> str:
    """A name for the rows of ``df``: its optimized plan without this session's expression ids, and its input files with their sizes and times.

    A plan does not show rows that come from elsewhere than files; they are named by the number of rows and the sum of their hashes.
    """
    optimized = df._jdf.queryExecution().optimizedPlan()
    plan = re.sub(r"#\d+L?", "", optimized.toString())
    leaves = optimized.collectLeaves()
    found: list[object] = []
    if any(leaves.apply(k).getClass().getSimpleName() != "LogicalRelation" for k in range(leaves.size())):
        hashed = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
        found.append(tuple(df.agg(F.count(F.lit(1)), hashed).first()))
    spark = df.sparkSession
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha1(f"{plan}|{found}".encode()).hexdigest()


def fit(learner: Estimator, train: DataFrame, source: CellSource | None = None, path: str | None = None) -> Model:
    """``learner`` fitted on ``train``; tree learners on its cells (``tree_cells.py``), made here unless ``source`` holds them; a factorization
    machine on its sums (``machine_sums.py``). A model that has ``saved_at`` is saved there, at ``path`` if it is given."""
    cols = wide_columns(train)
    if cols and sums_learner(learner, len(cols)):
        return fit_on_sums(learner, train, cols)
    cells = (source or CellSource(train)).get(learner.getMaxBins()) if cell_learner(learner) else None
    return learner.fit(train) if cells is None else fit_on_cells(learner, cells, path)


def fit_once(learner: Estimator, train: DataFrame, rows: str | None = None, source: CellSource | None = None) -> Model:
    """``learner`` fitted on ``train``, or read back from the shared folder where the same learner was fitted on the same rows before.

    The key is a hash of ``rows`` (by default :func:`rows_key` of ``train``) and every parameter of the learner; models are written whole, so a model
    found is one that was finished. Learners of other kinds are fitted every time. What the learner itself raises comes as :class:`NotTrained`; a
    model that cannot be written or read back is a fault of another kind.
    """

    def trained(how: Callable[[], Model]) -> Model:
        try:
            return how()
        except LEARNER_ERRORS as error:
            raise NotTrained(str(error)) from error

    kind = _MODEL_OF.get(type(learner))
    if kind is None:
        return trained(lambda: learner.fit(train))
    spark = train.sparkSession
    key = hashlib.sha1(f"{rows or rows_key(train)}|{_signature(learner)}".encode()).hexdigest()
    path = f"{scratch_dir(spark)}/models/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        model = read_saved(kind, f"{path}/model", spark)
    else:
        model = trained(lambda: fit(learner, train, source, f"{path}/model"))
        if getattr(model, "saved_at", None) is None:
            model.write().overwrite().save(f"{path}/model")
        fs.create(hadoop, True).close()
    model.saved_at = f"{path}/model"
    return model


def _few_scans(learner: Estimator, train: DataFrame) -> bool:
    """Whether a learner passes over its rows a few times only: on cells, on sums, or least squares by cross-products."""
    cols = wide_columns(train)
    linear = isinstance(learner, Pipeline) and all(
        isinstance(st, StandardScaler) or isinstance(st, LinearRegression) and st.getSolver() == "normal" for st in learner.getStages())
    return bool(cols) and (linear or sums_learner(learner, len(cols)) or cell_learner(learner))


def benchmark(train: DataFrame, test: DataFrame, roster: Mapping[str, Estimator]) -> Trained:
    """Fit every learner of the roster, at once in threads of the driver, and score all of them on the test rows in one job.

    A learner that raises one of ``LEARNER_ERRORS`` is replaced by the mean of the training target and marked as ``failed``, with a warning that
    keeps the message; any other error ends the comparison. All models are scored on the test rows that have every feature. Both frames come from :func:`assemble`; the training rows are cached if they are few, or if a learner passes over them many times. A learner fitted before on the same rows with the same settings is read back (:func:`fit_once`).
    """
    spark = train.sparkSession
    rows = rows_key(train)
    cols = wide_columns(train)
    plain = train.select(LABEL, FEATURES) if cols else train
    several, held = spread(plain), None
    if several is not plain:
        x, held = vector_to_array(F.col(FEATURES)), several.persist()
        train = held.select("*", *[x[j].alias(c) for j, c in enumerate(cols)])
    elif any(not _few_scans(learner, train) for learner in roster.values()):
        train = held = train.persist()
    source = CellSource(train)
    models: dict[str, Model | None] = {}
    try:
        def trained(item):
            name, learner = item
            try:
                return name, fit_once(learner, train, rows, source)
            except NotTrained as error:  # a broken learner must not end the comparison
                warnings.warn(f"{name} could not be trained: {str(error)[:300]}")
                return name, None

        with ThreadPoolExecutor(max_workers=max(1, len(roster))) as pool:
            models = dict(pool.map(trained, roster.items()))
        failed = [name for name, m in models.items() if m is None]
        mean = float(train.agg(F.avg(LABEL)).first()[0] or 0.0) if failed else 0.0
    finally:
        if held is not None:
            held.unpersist()
    got = _scored(test, models, mean)
    rows = [(name, got[name]["r2"] if name in got else None, got[name]["mean"] if name in got else None,
             got[name]["n"] if name in got else 0, models[name] is None) for name in roster]
    schema = "model string, r2 double, mean_prediction double, n long, failed boolean"
    return Trained(models, local_table(spark, rows, schema))


def _scored(test: DataFrame, models: Mapping[str, Model | None], mean: float) -> dict[str, Row]:
    """model, r2, mean and n of every model on the test rows, in one job; the mean stands for a model that is None.

    Rows that no split of the trees tells apart have the same predictions, so trees predict once for each cell of rows, with the number, mean and
    variance of their labels; other models predict row by row.
    """
    cols = wide_columns(test)
    known = all_of([~F.isnan(c) for c in cols]) if cols else F.lit(True)
    trees = {k: tree_nodes(m, test.sparkSession) for k, m in models.items() if isinstance(m, TREES)} if cols else {}
    trees = {k: m for k, m in trees.items() if m}
    cuts = split_points(list(trees.values()), len(cols))
    if cells_between(cuts) > MOST_CELLS:
        trees = {}
    gap = F.col(LABEL) - F.col(PREDICTION)
    columns = (F.col(LABEL), F.when(known, F.col(PREDICTION)).cast("double").alias(PREDICTION))
    sums = (F.sum(gap * gap).alias("error"), F.sum(PREDICTION).alias("total"), F.count(PREDICTION).alias("k"), F.count(gap).alias("known"))
    parts = []
    for name in models:
        if name not in trees:
            model = models[name]
            predicted = test.withColumn(PREDICTION, F.lit(mean)) if model is None else model.transform(test)
            parts.append(predicted.select(*columns).agg(*sums).select(F.lit(name).alias("model"), "*"))
    if trees:
        label = F.col(LABEL)
        cells = alike(test.where(known).select(LABEL, *cols), cols, cuts, F.count(label).alias("labels"), F.avg(label).alias(LABEL), F.var_pop(label).alias("apart"))
        done = materialize(predicted_once(cells, cols, list(trees.values())), "scored")
        weighted = (
            F.sum(F.col("labels") * (F.col("apart") + gap * gap)).alias("error"), F.sum(F.col("rows") * F.col(PREDICTION)).alias("total"),
            F.sum("rows").alias("k"), F.sum("labels").alias("known"),
        )
        for k, name in enumerate(trees):
            predicted = done.select("rows", "labels", "apart", LABEL, F.col(f"p{k}").alias(PREDICTION))
            parts.append(predicted.agg(*weighted).select(F.lit(name).alias("model"), "*"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    whole = test.agg(F.var_pop(LABEL).alias("spread"), F.count(F.lit(1)).alias("n"))
    r2 = 1 - F.try_divide(F.try_divide(F.col("error"), F.col("known")), F.col("spread"))
    return {r["model"]: r for r in every.crossJoin(F.broadcast(whole)).select(
        "model", r2.alias("r2"), F.try_divide(F.col("total"), F.col("k")).alias("mean"), "n").where("n > 0").collect()}


# --- tables over a score table (a row per model) -------------------------------------------


def floor_negative(scores: DataFrame) -> DataFrame:
    """Keeps ``r2`` and adds ``r2_floored``; ``floored`` marks models worse than the mean."""
    return scores.select(
        "*", F.greatest(F.col("r2"), F.lit(0.0)).alias("r2_floored"), (F.col("r2") < 0).alias("floored")
    )


def rank_models(scores: DataFrame, top: int = 4, bottom: int = 2) -> DataFrame:
    """Adds ``rank`` by R2 and marks best, top and bottom; one row per model, so the window is small."""
    best_first = Window.partitionBy(F.lit(0)).orderBy(F.desc("r2"), "model")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return scores.select(
        "*", F.row_number().over(best_first).alias("rank"), n.alias("_n")
    ).select(
        *scores.columns, "rank", (F.col("rank") == 1).alias("is_best"), (F.col("rank") <= top).alias("in_top"),
        (F.col("rank") > F.col("_n") - bottom).alias("in_bottom"),
    )


def improvement(scores: DataFrame, baseline_r2: float | None) -> DataFrame:
    """Best R2 against a baseline, in percentage points, with its band."""
    best = scores.orderBy(F.desc("r2"), "model").limit(1)
    base = F.lit(None if baseline_r2 is None else float(baseline_r2)).cast("double")
    return best.select(
        F.col("model").alias("best_model"), F.col("r2").alias("best_r2"), base.alias("baseline_r2"),
        ((F.col("r2") - base) * 100).alias("points"),
        band(F.col("r2"), (0.8, 0.9), ("improvable", "good", "excellent")).alias("grade"),
    )


def consensus_weights(scores: DataFrame, top: int = 4) -> DataFrame:
    """Weights of the best ``top`` models by non-negative R2; equal when none is positive."""
    best_first = Window.partitionBy(F.lit(0)).orderBy(F.desc("r2"), "model")
    kept = scores.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top)
    raw = F.greatest(F.col("r2"), F.lit(0.0))
    every = Window.partitionBy(F.lit(0))
    return kept.select(
        "model", "r2", "mean_prediction",
        F.coalesce(F.try_divide(raw, F.sum(raw).over(every)), 1.0 / F.count(F.lit(1)).over(every)).alias("weight"),
    )


def consensus_prediction(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted prediction per scenario from ``scenario_id, model, predicted``.

    A prediction that is not a number is replaced by the model's mean prediction.
    """
    usable = F.coalesce(clean(F.col("predicted")), F.col("mean_prediction"))
    joined = predictions.join(F.broadcast(weights), "model")
    return joined.groupBy("scenario_id").agg(F.sum(F.col("weight") * usable).alias("consensus"))


def consensus_spread(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Distance of each model to the consensus of its scenario, nearest first.

    A scenario has at most as many rows as there are models.
    """
    usable = F.coalesce(clean(F.col("predicted")), F.col("mean_prediction"))
    of_scenario = Window.partitionBy("scenario_id")
    table = predictions.join(F.broadcast(weights), "model").withColumn("predicted", usable)
    table = table.withColumn("consensus", F.sum(F.col("weight") * F.col("predicted")).over(of_scenario))
    table = table.withColumn("gap", F.abs(F.col("predicted") - F.col("consensus")))
    return table.select(
        "scenario_id", "model", "predicted", "consensus", "gap",
        F.row_number().over(of_scenario.orderBy("gap", "model")).alias("nearness"),
    )


def benchmark_summary(scores: DataFrame, baseline_r2: float | None, top: int = 4) -> DataFrame:
    """One row: baseline, best model, all scores, the top models and their weights. A model that failed has no score and is neither best nor on top."""
    if "failed" in scores.columns:
        scores = scores.withColumn("r2", F.when(~F.col("failed"), F.col("r2")))
    known = scores.where(F.col("r2").isNotNull())
    ai = known.where(F.col("model") != LINEAR)
    best = improvement(known, baseline_r2).select("baseline_r2", "best_model", "best_r2", "points", "grade")
    listed = scores.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "r2")))).alias("scores")
    )
    tops = consensus_weights(ai, top).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("r2")).alias("o"), "model", "weight"))),
            lambda t: F.struct(t["model"].alias("model"), t["weight"].alias("weight")),
        ).alias("top_models")
    )
    # Three one-row tables side by side.
    one = F.lit(1).alias("_one")
    return (
        best.select("*", one).join(listed.select("*", one), "_one").join(tops.select("*", one), "_one").drop("_one")
    )


def predict_long(rows: DataFrame, models: Mapping[str, Model | None], keep: Sequence[str] = ("scenario_id",)) -> DataFrame:
    """Predictions of all models in one long table; ``rows`` come from :func:`assemble`."""
    cols = wide_columns(rows)
    trees = {k: tree_nodes(m, rows.sparkSession) for k, m in models.items() if isinstance(m, TREES)} if cols else {}
    trees = {k: m for k, m in trees.items() if m}
    parts = []
    for name, model in models.items():
        if name not in trees:
            done = rows.withColumn(PREDICTION, F.lit(None).cast("double")) if model is None else model.transform(rows)
            parts.append(done.select(*keep, F.lit(name).alias("model"), F.col(PREDICTION).alias("predicted")))
    if trees:
        done = predicted_once(rows.select(*keep, *cols), cols, list(trees.values()))
        marks = [F.struct(F.lit(name).alias("model"), F.col(f"p{k}").alias("predicted")) for k, name in enumerate(trees)]
        parts.append(done.select(*keep, F.inline(F.array(*marks))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- importance ---------------------------------------------------------------------------------


def permutation_importance(
    test: DataFrame, x: Sequence[str], y: str, model: Model, repeats: int = 10, block: int = PERMUTATION_BLOCK
) -> DataFrame:
    """Mean loss of R2 when one column is shuffled: ``variable, importance, sd``.

    The rows are thrown into random blocks of bounded size, and each repeat
    hands every row the values of the next one in a random order of its block,
    a permutation that needs no global order and no join. Trees do not see more
    of a row than its cell, so with them a row travels as its cell and target,
    and its predictions are looked up in a table of all cells, where that is
    small. Other models predict every row for every repeat and column.
    """
    nodes = tree_nodes(model, test.sparkSession) if isinstance(model, TREES) else None
    cuts = split_points([nodes], len(x)) if nodes else []
    if nodes and cells_between(cuts) <= MOST_CELLS:
        return _permuted_cells(test, x, y, nodes, cuts, repeats, block)
    return _permuted_rows(test, x, y, model, repeats, block)


def _permuted_cells(test: DataFrame, x: Sequence[str], y: str, nodes: Nodes, cuts: Sequence[np.ndarray], repeats: int, block: int) -> DataFrame:
    """:func:`permutation_importance` of trees, by the prediction of every cell between the cuts."""
    spark = test.sparkSession
    table = spark.sparkContext.broadcast(cell_predictions(nodes, cuts, spark))
    rows = with_cell(test, x, cuts).select("cell", F.col(f"`{y}`").cast("double").alias(LABEL)).withColumn("_row", F.monotonically_increasing_id())
    numbered = materialize(rows, "numbered")
    whole = numbered.agg(F.count(F.lit(1)).alias("n"), F.var_pop(LABEL).alias("spread")).first()
    blocks = max(1, -(-whole["n"] // block))
    hashes = [f"_h{r}" for r in range(repeats)]
    thrown = numbered.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    sizes = [len(k) + 1 for k in cuts]
    units = np.cumprod([1, *sizes[:-1]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        cell, label = pdf["cell"].to_numpy(np.int64), pdf[LABEL].to_numpy(np.float64)
        predicted = table.value
        known = ~np.isnan(label)

        def error(cells: np.ndarray) -> float:
            gap = (label - predicted[cells])[known]
            return float(gap @ gap)

        shares = [cell // unit % size * unit for unit, size in zip(units, sizes)]
        out, following = [(-1, -1, error(cell), int(known.sum()))], np.empty(len(cell), np.int64)
        for r, name in enumerate(hashes):
            order = np.argsort(pdf[name].to_numpy(), kind="stable")
            following[order] = np.roll(order, -1)
            for j, share in enumerate(shares):
                out.append((r, j, error(cell + share[following] - share), out[0][3]))
        return pd.DataFrame(out, columns=["repeat", "j", "error", "known"])

    wide = thrown.select("*", *[F.xxhash64(F.lit(r), "_row").alias(h) for r, h in enumerate(hashes)])
    errors = wide.groupBy("_block").applyInPandas(run, "repeat int, j int, error double, known long")
    found = errors.groupBy("repeat", "j").agg(F.sum("error").alias("error"), F.sum("known").alias("known"))
    found = found.select("repeat", "j", (1 - F.try_divide(F.try_divide("error", "known"), F.lit(whole["spread"]))).alias("r2")).collect()
    known = next((r["r2"] for r in found if r["j"] < 0), None)
    names = local_table(spark, [(j, c) for j, c in enumerate(x)], "j int, variable string")
    moved = local_table(spark, [(r["repeat"], r["j"], r["r2"]) for r in found if r["j"] >= 0], "repeat int, j int, r2 double")
    return moved.join(names, "j").groupBy("variable").agg(
        F.avg(F.lit(known).cast("double") - F.col("r2")).alias("importance"), F.stddev_pop("r2").alias("sd")
    )


def _permuted_rows(test: DataFrame, x: Sequence[str], y: str, model: Model, repeats: int, block: int) -> DataFrame:
    """:func:`permutation_importance` of any model; here the blocks are thrown anew for every repeat."""
    # every row gets a number of its own, written once, so that equal rows are told apart and stay so
    base = test.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in [y, *x]])
    numbered = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    base = numbered.drop("_row")
    n = numbered.count()
    blocks = max(1, -(-n // block))
    tagged = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    tagged = tagged.withColumn("_h", F.xxhash64("repeat", "_row"))
    tagged = tagged.withColumn("_block", F.pmod(F.col("_h"), F.lit(blocks)))
    inside = Window.partitionBy("repeat", "_block").orderBy("_h", "_row")
    ahead = F.struct(*[F.col(f"`{c}`") for c in x])
    first = F.first(ahead).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = tagged.withColumn("_other", F.coalesce(F.lead(ahead).over(inside), first))
    marks = [F.struct(F.lit(c).alias("variable"), F.lit(j).alias("_j")) for j, c in enumerate(x)]
    wide = moved.select(*base.columns, "repeat", "_other", F.inline(F.array(*marks)))
    shuffled = wide.select(
        "repeat", "variable", F.col(f"`{y}`").alias(LABEL),
        *[F.when(F.col("_j") == j, F.col(f"_other.{c}")).otherwise(F.col(f"`{c}`")).alias(c) for j, c in enumerate(x)],
    )
    known = model.transform(assemble(base, x, y)).agg(r2_of(F.col(LABEL), F.col(PREDICTION))).first()[0]
    scored = model.transform(
        VectorAssembler(inputCols=list(x), outputCol=FEATURES).transform(shuffled)
    )
    per_repeat = scored.groupBy("variable", "repeat").agg(r2_of(F.col(LABEL), F.col(PREDICTION)).alias("r2"))
    return per_repeat.groupBy("variable").agg(
        F.avg(F.lit(known) - F.col("r2")).alias("importance"), F.stddev_pop("r2").alias("sd")
    )


def coalition_weights(d: int, permutations: int = 200, seed: int = 7) -> dict[int, list[float]]:
    """Weight of each coalition's value in the Shapley value of every column.

    Exact up to ``EXACT_COLUMNS`` columns; above, averaged over random orders.
    """
    if d <= EXACT_COLUMNS:
        out = {}
        for mask in range(2**d):
            size = bin(mask).count("1")
            gain = 1.0 / (d * comb(d - 1, size - 1)) if size else 0.0
            loss = -1.0 / (d * comb(d - 1, size)) if size < d else 0.0
            out[mask] = [gain if mask >> j & 1 else loss for j in range(d)]
        assert abs(out[0][0] + factorial(d - 1) / factorial(d)) < 1e-12
        return out
    rng = np.random.default_rng(seed)
    out = {}
    for _ in range(permutations):
        mask = 0
        for j in rng.permutation(d):
            out.setdefault(mask, [0.0] * d)[j] -= 1.0 / permutations
            mask |= 1 << int(j)
            out.setdefault(mask, [0.0] * d)[j] += 1.0 / permutations
    return out


def hash_sample(df: DataFrame, cols: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows, each as likely as any other however many rows equal it: lowest hashes of row numbers.

    The numbers follow the partitions of ``df``, so the same files give the same rows.
    """
    numbered = df.select(*cols).withColumn("_row", F.monotonically_increasing_id())
    return numbered.orderBy(F.xxhash64(F.lit(seed), "_row"), "_row").limit(n).drop("_row")


def shapley_values(
    sample: DataFrame, background: DataFrame, x: Sequence[str], predict: Callable[[DataFrame], DataFrame],
    most_background: int = 200,
) -> DataFrame:
    """Interventional Shapley values of the sample rows: the sample's columns and ``phi_<column>``.

    The value of a coalition is the mean prediction with the coalition's columns
    from the row and the others from the background rows. ``predict`` adds
    ``prediction``. The background is a sample of at most ``most_background`` rows.
    """
    rows = [tuple(float(r[c]) for c in x) for r in background.select(*x).limit(most_background + 1).collect()]
    if len(rows) > most_background:
        raise ValueError("the background must be a sample")
    weights = coalition_weights(len(x))
    others = F.array(*[F.struct(*[F.lit(v).alias(f"_b{j}") for j, v in enumerate(r)]) for r in rows])
    masks = F.array(
        *[F.struct(F.lit(m).cast("long").alias("_mask"), F.array(*[F.lit(v) for v in w]).alias("_w")) for m, w in weights.items()]
    )
    named = sample.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in x])
    named = named.withColumn("_id", F.monotonically_increasing_id())
    grid = named.select("_id", *[F.col(f"`{c}`").alias(f"_x{j}") for j, c in enumerate(x)], F.inline(masks))
    grid = grid.select("*", F.inline(others))
    mixed = grid.select(
        "_id", "_mask", "_w", *[f"_x{j}" for j in range(len(x))],
        *[
            F.when(F.col("_mask").bitwiseAND(F.lit(1 << j)) != 0, F.col(f"_x{j}")).otherwise(F.col(f"_b{j}")).alias(c)
            for j, c in enumerate(x)
        ],
    )
    keys = ["_id", *[f"_x{j}" for j in range(len(x))]]
    valued = predict(mixed).groupBy(*keys, "_mask", "_w").agg(F.avg(PREDICTION).alias("_v"))
    out = valued.groupBy(*keys).agg(
        *[F.sum(F.col("_w")[j] * F.col("_v")).alias(f"phi_{c}") for j, c in enumerate(x)]
    )
    return out.select(*[F.col(f"_x{j}").alias(c) for j, c in enumerate(x)], *[f"phi_{c}" for c in x])


def model_predictor(model: Model, x: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Predictor for :func:`shapley_values` from a fitted MLlib model."""
    return lambda df: model.transform(VectorAssembler(inputCols=list(x), outputCol=FEATURES).transform(df))


def shapley_importance(values: DataFrame, x: Sequence[str], rows: str | None = None) -> DataFrame:
    """Mean absolute Shapley value per column; ``rows`` names the column that says for how many rows a row of ``values`` stands."""
    def mean(v: Column) -> Column:
        return F.avg(v) if rows is None else F.try_divide(F.sum(F.col(rows) * v), F.sum(F.when(v.isNotNull(), F.col(rows))))

    wide = values.agg(*[mean(F.abs(F.col(f"phi_{c}"))).alias(f"v{j}") for j, c in enumerate(x)])
    marks = [F.struct(F.lit(c).alias("variable"), F.col(f"v{j}").alias("importance")) for j, c in enumerate(x)]
    return wide.select(F.inline(F.array(*marks)))


def linear_shapley(df: DataFrame, coef: Mapping[str, float], mean: Mapping[str, float]) -> DataFrame:
    """Shapley values of a linear model in closed form, on every row."""
    return df.select(
        "*", *[(F.lit(float(w)) * (F.col(f"`{c}`") - F.lit(float(mean[c])))).alias(f"phi_{c}") for c, w in coef.items()]
    )


def scenario_frame(spark: SparkSession, rows: Sequence[Mapping[str, object]], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(",")]
    return local_table(spark, [tuple(r.get(k) for k in names) for r in rows], schema)
