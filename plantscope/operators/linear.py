"""Linear models from cross-products: least squares, elastic net, ridge, lasso, Huber; terms and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantscope.functions.numeric import band
from plantscope.operators.gram import Gram, gram_by, whole
from plantscope.session import local_table

INTERCEPT = "(intercept)"

# Search grids and selection limits.
L1_RATIOS = (0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
PATH_ALPHAS = tuple(float(a) for a in np.logspace(-6, 2, 45))
MAX_ITERATIONS = 2000
LASSO_ALPHA, LASSO_KEPT, LASSO_IMPORTANT = 0.1, 1e-5, 0.1
R2_CUTS, R2_LABELS = (0.5, 0.8), ("low", "medium", "good")
VIF_CUTS, VIF_LABELS = (5, 10), ("fine", "caution", "severe")


@dataclass(frozen=True)
class LinearModel:
    """Coefficients on the original scale of the columns."""

    name: str
    y: str
    coef: Mapping[str, float]
    intercept: float
    settings: Mapping[str, float] = field(default_factory=dict)

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in self.coef.items():
            out = out + F.lit(float(w)) * F.col(f"`{c}`")
        return out


def with_holdout(df: DataFrame, key: str | None = None, parts: int = 5, folds: int = 5) -> DataFrame:
    """Adds ``is_test`` (one part in ``parts``) and ``fold`` (0..folds-1 for the rest).

    With an integer key the split is by its remainder, so all rows of a key stay
    together; without one it is by a hash of the whole row. Both are the same
    however the rows are partitioned.
    """
    if key is None:
        place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts * folds))
    else:
        place = F.pmod(F.col(key), F.lit(parts * folds))
    return df.withColumn("is_test", F.pmod(place, F.lit(parts)) == 0).withColumn(
        "fold", F.floor(place / parts).cast("int")
    )


def standardize(df: DataFrame, cols: Sequence[str], centre: bool = True) -> DataFrame:
    """Columns over their population deviation, centred or not; one aggregate."""
    g = gram_by(df.na.drop(subset=list(cols)), cols)[()]
    scaled = {
        c: (F.col(f"`{c}`") - F.lit(float(g.mean[i]) if centre else 0.0)) / F.lit(float(g.sd[i]))
        for i, c in enumerate(cols)
    }
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(f"`{c}`") for c in df.columns])


@dataclass(frozen=True)
class Parts:
    """Cross-products of the training folds and of the test rows."""

    y: str
    x: tuple[str, ...]
    folds: Mapping[int, Gram]
    test: Gram

    @property
    def train(self) -> Gram:
        return whole(dict(self.folds))


def split_grams(df: DataFrame, y: str, x: Sequence[str]) -> Parts:
    """One scan over rows that carry ``is_test`` and ``fold``."""
    cols = [y, *x]
    found = gram_by(df.na.drop(subset=cols), cols, ["is_test", "fold"])
    test = whole({k: g for k, g in found.items() if k[0]})
    return Parts(y, tuple(x), {k[1]: g for k, g in found.items() if not k[0]}, test)


def solve_least_squares(g: Gram, y: str, name: str = "ols") -> LinearModel:
    x = [c for c in g.columns if c != y]
    p = g.pick([y, *x])
    scale = p.sd[1:]
    sxx = p.cross[1:, 1:] / np.outer(scale, scale)
    w = np.linalg.lstsq(sxx, p.cross[1:, 0] / scale, rcond=1e-12)[0] / scale
    return LinearModel(name, y, dict(zip(x, map(float, w))), float(p.mean[0] - w @ p.mean[1:]))


def _squared_error(g: Gram, y: str, w: np.ndarray, intercept: float) -> float:
    p = g.pick([y, *[c for c in g.columns if c != y]])
    within = p.cross[0, 0] - 2 * w @ p.cross[1:, 0] + w @ p.cross[1:, 1:] @ w
    bias = p.mean[0] - intercept - w @ p.mean[1:]
    return max(float(within), 0.0) + p.n * float(bias) ** 2


def score(model: LinearModel, g: Gram) -> dict[str, float]:
    """R2 and RMSE of a model on the rows behind a Gram, without touching them."""
    w = np.array([model.coef.get(c, 0.0) for c in g.columns if c != model.y])
    error = _squared_error(g, model.y, w, model.intercept)
    spread = float(g.pick([model.y]).cross[0, 0])
    return {"r2": 1 - error / spread if spread > 0 else 0.0, "rmse": (error / g.n) ** 0.5, "n": g.n}


def descend(g: Gram, y: str, alpha: float, l1_ratio: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent for 1/(2n)|y-Xw|^2 + alpha l1 |w|_1 + alpha (1-l1)/2 |w|^2 on cross-products."""
    p = g.pick([y, *[c for c in g.columns if c != y]])
    a, b = p.cross[1:, 1:] / p.n, p.cross[1:, 0] / p.n
    w = np.zeros(len(b)) if start is None else start.copy()
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(MAX_ITERATIONS):
        moved = 0.0
        for j in range(len(b)):
            if a[j, j] + l2 <= 0:
                continue
            pull = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (a[j, j] + l2)
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        if moved <= 1e-10 * max(1.0, float(np.abs(w).max(initial=0.0))):
            break
    return w


def elastic_net_cv(
    parts: Parts, l1_ratios: Sequence[float] = L1_RATIOS, alphas: Sequence[float] = ALPHAS, name: str = "elastic_net"
) -> LinearModel:
    """Grid search by mean fold error, then a fit on all training rows. No Spark job is started.

    Columns are standardized on the whole training part first.
    """
    y, train = parts.y, parts.train
    scaled = train.standardized(y)
    folds = [(k, f.standardized(y, train)) for k, f in sorted(parts.folds.items())]
    outside = {k: scaled - f for k, f in folds} if len(folds) > 1 else {}
    best: tuple[float, float, float] | None = None
    for l1 in l1_ratios:
        errors: dict[float, list[float]] = {a: [] for a in alphas}
        for k, fold in folds if outside else ():
            fit, w = outside[k], None
            for alpha in sorted(alphas, reverse=True):
                w = descend(fit, y, alpha, l1, w)
                errors[alpha].append(_squared_error(fold, y, w, _intercept(fit, y, w)) / fold.n)
        for alpha in sorted(alphas, reverse=True):
            mean = float(np.mean(errors[alpha])) if errors[alpha] else 0.0
            if best is None or mean < best[0]:
                best = (mean, alpha, l1)
    _, alpha, l1 = best
    return _unscaled(name, train, y, descend(scaled, y, alpha, l1), {"alpha": alpha, "l1_ratio": l1, "cv_mse": best[0]})


def _intercept(g: Gram, y: str, w: np.ndarray) -> float:
    p = g.pick([y, *[c for c in g.columns if c != y]])
    return float(p.mean[0] - w @ p.mean[1:])


def _unscaled(name: str, train: Gram, y: str, w: np.ndarray, settings: dict) -> LinearModel:
    x = [c for c in train.columns if c != y]
    p = train.pick([y, *x])
    raw = w / p.sd[1:]
    return LinearModel(name, y, dict(zip(x, map(float, raw))), float(p.mean[0] - raw @ p.mean[1:]), settings)


def lasso_cv(parts: Parts, alphas: Sequence[float] = PATH_ALPHAS) -> LinearModel:
    return elastic_net_cv(parts, (1.0,), alphas, "lasso")


def ridge_cv(parts: Parts, alphas: Sequence[float] = PATH_ALPHAS) -> LinearModel:
    """|y-Xw|^2 + alpha |w|^2 over the folds, solved in closed form."""
    y, train = parts.y, parts.train
    scaled = train.standardized(y)

    def solve(g: Gram, alpha: float) -> np.ndarray:
        p = g.pick([y, *[c for c in g.columns if c != y]])
        return np.linalg.solve(p.cross[1:, 1:] + alpha * np.eye(len(p.columns) - 1), p.cross[1:, 0])

    best = None
    for alpha in alphas:
        errors = []
        for _, fold in sorted(parts.folds.items()):
            held = fold.standardized(y, train)
            fit = scaled - held
            w = solve(fit, alpha)
            errors.append(_squared_error(held, y, w, _intercept(fit, y, w)) / held.n)
        mean = float(np.mean(errors))
        if best is None or mean < best[0]:
            best = (mean, alpha)
    return _unscaled("ridge", train, y, solve(scaled, best[1]), {"alpha": best[1], "cv_mse": best[0]})


def huber_fit(
    df: DataFrame, y: str, x: Sequence[str], alphas: Sequence[float] = (1e-6, 1e-3, 1.0),
    epsilons: Sequence[float] = (1.1, 1.35, 2.0),
) -> LinearModel:
    """Robust linear fit; the grid is judged on fold 0 of the training rows, the winner refitted on all of them.

    Target and columns are brought to unit deviation first: the solver does not
    get far from its start on large targets.
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.where(~F.col("is_test")).na.drop(subset=[y, *x])
    g = gram_by(rows, [y, *x])[()]
    scaled = rows.select(
        "fold", *[((F.col(f"`{c}`") - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(g.columns, g.mean, g.sd)]
    )
    scaled = VectorAssembler(inputCols=list(x), outputCol="features").transform(scaled)
    scaled = scaled.select("features", F.col(f"`{y}`").alias("label"), "fold").persist()
    judge = RegressionEvaluator(metricName="r2")

    def fit(part: DataFrame, epsilon: float, alpha: float):
        return LinearRegression(loss="huber", epsilon=epsilon, regParam=alpha, maxIter=100).fit(part)

    try:
        best = None
        for epsilon in epsilons:
            for alpha in alphas:
                r2 = judge.evaluate(fit(scaled.where("fold <> 0"), epsilon, alpha).transform(scaled.where("fold = 0")))
                if best is None or r2 > best[0]:
                    best = (r2, epsilon, alpha)
        _, epsilon, alpha = best
        won = fit(scaled, epsilon, alpha)
    finally:
        scaled.unpersist()
    w = np.array(won.coefficients.toArray()) * g.sd[0] / g.sd[1:]
    intercept = float(won.intercept) * g.sd[0] + g.mean[0] - w @ g.mean[1:]
    return LinearModel(
        "huber", y, dict(zip(x, map(float, w))), float(intercept), {"alpha": alpha, "epsilon": epsilon}
    )


# --- tables ---------------------------------------------------------------------------------


def coefficient_table(spark: SparkSession, models: Sequence[LinearModel]) -> DataFrame:
    rows = [(m.name, t, w) for m in models for t, w in [*m.coef.items(), (INTERCEPT, m.intercept)]]
    return local_table(spark, [(a, b, float(c)) for a, b, c in rows], "model string, term string, coef double")


def term_contributions(
    spark: SparkSession, models: Sequence[LinearModel], rows: Gram, train: Gram | None = None, compat: str | None = None
) -> DataFrame:
    """Average share of every term in the prediction: ``model, term, coef, avg_contribution, ratio, rank``.

    A term contributes its coefficient times the mean of its column over the rows
    behind ``rows``. ``compat='ols'`` instead scales the coefficient by the
    training deviation and adds the training mean to the column, and
    ``compat='elastic_net'`` only scales it; both need ``train``.
    """
    out = []
    for m in models:
        sd = dict(zip(train.columns, train.sd)) if train else {}
        mean = dict(zip(train.columns, train.mean)) if train else {}
        at = dict(zip(rows.columns, rows.mean))
        intercept = m.intercept
        if compat == "elastic_net":
            intercept += sum(w * mean[c] for c, w in m.coef.items())
        for c, w in m.coef.items():
            if compat:
                value = w * sd[c] * (at[c] + (mean[c] if compat == "ols" else 0.0))
            else:
                value = w * at[c]
            out.append((m.name, c, float(w), float(value)))
        out.append((m.name, INTERCEPT, float(intercept), float(intercept)))
    table = local_table(spark, out, "model string, term string, coef double, avg_contribution double")
    everything = F.sum("avg_contribution").over(Window.partitionBy("model"))
    table = table.withColumn("ratio", F.coalesce(F.try_divide(F.col("avg_contribution") * 100, everything), F.lit(0.0)))
    order = Window.partitionBy("model").orderBy(F.desc(F.abs("ratio")), "term")
    return table.withColumn("rank", F.row_number().over(order))


def waterfall(terms: DataFrame, y: str) -> DataFrame:
    """Running start of each term's bar, largest first, and a closing row with the total."""
    order = Window.partitionBy("model").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    steps = terms.select(
        "model", "rank", "term", "ratio", F.coalesce(F.sum("ratio").over(order), F.lit(0.0)).alias("start")
    )
    total = terms.groupBy("model").agg(
        (F.max("rank") + 1).alias("rank"), F.lit(y).alias("term"), F.sum("ratio").alias("ratio"), F.lit(0.0).alias("start")
    )
    return steps.unionByName(total)


def number_text(value: Column) -> Column:
    """Three decimals, four below a thousandth, scientific below a ten-thousandth."""
    size = F.abs(value)
    return (
        F.when(size >= 1e-3, F.format_string("%.3f", value))
        .when(size >= 1e-4, F.format_string("%.4f", value))
        .otherwise(F.format_string("%.2e", value))
    )


def equation_text(terms: DataFrame, y: str) -> DataFrame:
    """One line per model: signed terms in rank order with their shares."""
    sign = F.when(F.col("coef") >= 0, "+ ").otherwise("- ")
    name = F.when(F.col("term") == INTERCEPT, F.lit("")).otherwise(F.concat(F.lit(" * "), F.col("term")))
    part = F.concat(sign, number_text(F.abs("coef")), name, F.format_string(" (%+.1f%%)", F.col("ratio")))
    listed = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    joined = F.array_join(F.transform(listed, lambda t: t["part"]), " ")
    return terms.groupBy("model").agg(F.concat(F.lit(f"{y} = "), joined).alias("equation"))


def predict_table(df: DataFrame, model: LinearModel, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.col(f"`{model.y}`").alias("actual"), model.predict().alias("predicted"))


def prediction_range(predicted: DataFrame) -> DataFrame:
    """Common minimum and maximum of actual and predicted values."""
    return predicted.agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
        F.count(F.lit(1)).alias("n"),
    )


def regression_metrics(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """R2, MAE, RMSE and grade of a table with ``actual`` and ``predicted``; one aggregate."""
    gap = F.col("actual") - F.col("predicted")
    sums = predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("actual").alias("_v"), F.avg(gap * gap).alias("_e"),
        F.avg(F.abs(gap)).alias("mae"),
    )
    r2 = 1 - F.try_divide("_e", "_v")
    return sums.select(*keys, "n", r2.alias("r2"), "mae", F.sqrt("_e").alias("rmse"), band(r2, R2_CUTS, R2_LABELS).alias("grade"))


def model_scores(spark: SparkSession, models: Sequence[LinearModel], test: Gram) -> DataFrame:
    rows = [(m.name, float(s["r2"]), float(s["rmse"]), int(s["n"])) for m in models for s in [score(m, test)]]
    table = local_table(spark, rows, "model string, r2 double, rmse double, n long")
    return table.withColumn("grade", band(F.col("r2"), R2_CUTS, R2_LABELS))


def best_model(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("r2"), "model").limit(1)


def model_comparison(terms: DataFrame, models: Sequence[str], value: str = "coef") -> DataFrame:
    """Terms down, models across."""
    return terms.groupBy("term").pivot("model", list(models)).agg(F.first(value))


# --- variable review from the same cross-products ----------------------------------------------


def vif(spark: SparkSession, g: Gram) -> DataFrame:
    """Variance inflation per column: diagonal of the inverse correlation matrix, infinite where it is singular."""
    d = len(g.columns)
    corr = g.cross / np.outer(g.sd, g.sd) / g.n
    values, vectors = np.linalg.eigh(corr)
    tiny = values <= 1e-10 * max(float(values.max()), 1.0)
    inverse = (vectors[:, ~tiny] / values[~tiny]) @ vectors[:, ~tiny].T
    caught = (np.abs(vectors[:, tiny]) > 1e-6).any(axis=1) if tiny.any() else np.zeros(d, dtype=bool)
    rows = [(c, float("inf") if caught[i] else float(inverse[i, i])) for i, c in enumerate(g.columns)]
    table = local_table(spark, rows, "variable string, vif double")
    return table.withColumn("band", band(F.col("vif"), VIF_CUTS, VIF_LABELS))


def lasso_select(spark: SparkSession, g: Gram, y: str, alpha: float = LASSO_ALPHA) -> DataFrame:
    """Coefficients of the lasso on standardized columns; kept and important ones marked."""
    w = descend(g.standardized(y), y, alpha, 1.0)
    x = [c for c in g.columns if c != y]
    table = local_table(spark, [(c, float(v)) for c, v in zip(x, w)], "variable string, coef double")
    size = F.abs("coef")
    return table.select("*", (size > LASSO_KEPT).alias("kept"), (size > LASSO_IMPORTANT).alias("important"))
