"""Huber regression with a concomitant scale, its whole grid of penalties and thresholds cross-validated in shared scans.

Each fit minimises ``sum_i (sigma + H(r_i / sigma) sigma) + alpha |w|^2`` over the coefficients w, the intercept and the scale
sigma, with ``H(z) = z^2`` for ``|z| <= epsilon`` and ``2 epsilon |z| - epsilon^2`` beyond, on columns standardised by the
mean and deviation of the fit's own training rows; the intercept is not penalised. The objective is jointly convex, and it is
minimised by alternating two steps that both lower it: a reweighted least-squares step for (w, intercept) at fixed sigma
(weight 1/sigma inside the threshold, epsilon/|r| beyond) and the closed-form sigma at fixed residuals.

All fits of the grid and of all folds move together: every round is one scan of the training rows in Arrow batches that
adds, for every fit, its weighted cross-products, right-hand side and scale sums; the driver only solves a (p+1) x (p+1)
system per fit. Rows are never collected: a scan returns one number per fit and entry, summed across tasks by Spark.
Grid points are judged by their mean R2 over the held-out folds, ties to the first in (alpha, epsilon) order; the winner
is fitted again on all training rows. On large tables the same fits are found with two scans of all rows (``huber_bands.py``).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.operators import huber_bands
from plantscope.operators.linear import LinearModel
from plantscope.session import spread

# the grid searched (fixed values: 13 penalties from 1e-6 to 1, six thresholds)
ALPHAS = tuple(float(a) for a in np.logspace(-6, 0, 13))
EPSILONS = (1.1, 1.2, 1.35, 1.5, 1.8, 2.0)
ROUNDS, TOLERANCE = 200, 1e-9
CHUNK = 1024
#: Above so many rows those far from a threshold are added up once (``huber_bands.py``), below all are scanned every round.
MOST_SCANNED = 400_000


def _scan(
    rows: DataFrame, names: Sequence[str], fits: np.ndarray, which: np.ndarray, state: np.ndarray, scale: np.ndarray, kind: str,
) -> np.ndarray:
    """Sums over the rows for every fit. fits: (G, 3) of alpha, epsilon and the fold held out (-1: none); which: (G,) the scaler of
    each fit; state: (G, p + 2) of w, intercept, sigma; scale: (S, 2, p) of means and deviations.

    kind "fit": per fit, the weighted cross-products of (z, 1), the right-hand side, the sum of squared inside residuals, the count of
    outside rows and the count of rows. kind "score": per fit, the squared error on its held-out fold.

    Tasks work on columns u scaled once for all fits, by the last scaler; a fit's own columns are (z, 1) = T (u, 1), so its coefficients
    are taken to u beforehand and its sums to z afterwards. The residuals of all fits and their weighted sums of the products of
    (u, 1) are matrix products.
    """
    p = len(names)
    rise, fall = np.triu_indices(p + 1)
    size = len(rise) + p + 1 + 3 if kind == "fit" else 1
    mean, sd = scale[-1]
    to = np.zeros((len(scale), p + 1, p + 1))
    to[:, np.arange(p), np.arange(p)] = sd / scale[:, 1]
    to[:, :p, p] = (mean - scale[:, 0]) / scale[:, 1]
    to[:, p, p] = 1.0
    to = to[np.asarray(which, np.int64)]
    theta = np.einsum("gij,gi->jg", to, state[:, : p + 1])  # (p + 1, G)
    held_out = fits[:, 2].astype(np.int64)
    groups = [(k, np.flatnonzero(held_out == k)) for k in np.unique(held_out)]  # fits that see the same rows
    edge = fits[:, 1] * state[:, p + 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(fits), size))
        for pdf in batches:
            u1 = np.ones((len(pdf), p + 1))
            u1[:, :p] = (pdf[list(names)].to_numpy(np.float64) - mean) / sd
            y = pdf["_y"].to_numpy(np.float64)
            fold = pdf["_fold"].to_numpy(np.int64)
            for k, of in groups:
                at = np.flatnonzero((fold == k) == (kind == "score"))
                coef, eps, limit = theta[:, of], fits[of, 1], edge[of]
                for a in range(0, len(at), CHUNK):
                    us, ys = u1[at[a : a + CHUNK]], y[at[a : a + CHUNK], None]
                    r = np.abs(ys - us @ coef)  # (B, fits)
                    if kind == "score":
                        total[of, 0] += np.einsum("bg,bg->g", r, r)
                        continue
                    inside = r <= limit
                    c = eps / np.maximum(r, limit)  # 1 / sigma inside, epsilon / |r| beyond
                    total[of, :-3] += c.T @ np.concatenate([us[:, rise] * us[:, fall], us * ys], axis=1)
                    r *= inside
                    total[of, -3] += np.einsum("bg,bg->g", r, r)
                    total[of, -2] += len(ys) - inside.sum(axis=0)
                    total[of, -1] += len(ys)
        yield pd.DataFrame(total, columns=[f"v{j}" for j in range(size)]).assign(g=np.arange(len(fits)))

    shape = ", ".join(f"v{j} double" for j in range(size)) + ", g long"
    sums = rows.mapInPandas(run, shape).groupBy("g").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(size)])
    got = np.zeros((len(fits), size))
    for row in sums.collect():  # one row per fit, (p + 2)^2 numbers at most
        got[row["g"]] = row[1:]
    if kind == "score":
        return got
    products = np.zeros((len(fits), p + 1, p + 1))
    products[:, rise, fall] = products[:, fall, rise] = got[:, : len(rise)]
    products = to @ products @ to.transpose(0, 2, 1)
    right = np.einsum("gij,gj->gi", to, got[:, len(rise) : -3])
    return np.concatenate([products.reshape(len(fits), -1), right, got[:, -3:]], axis=1)


def _fit_all(rows: DataFrame, names: Sequence[str], fits: np.ndarray, which: np.ndarray, scale: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(G, p + 2): coefficients on standardised columns, intercept and scale of every fit, by alternating rounds of scans.

    ``start`` (G, 2) holds the mean and deviation of each fit's target, the first intercept and scale. A fit leaves the scans
    once no entry moves by more than ``TOLERANCE`` relative to its size; the others go on.
    """
    p = len(names)
    state = np.zeros((len(fits), p + 2))
    state[:, p] = start[:, 0]
    state[:, p + 1] = np.where(start[:, 1] > 0, start[:, 1], 1.0)
    active = np.arange(len(fits))
    for _ in range(ROUNDS):
        if not len(active):
            break
        part = fits[active]
        sums = _scan(rows, names, part, which[active], state[active], scale, "fit")
        a = sums[:, : (p + 1) ** 2].reshape(-1, p + 1, p + 1)
        b = sums[:, (p + 1) ** 2 : (p + 1) ** 2 + p + 1]
        penalty = np.zeros((len(part), p + 1, p + 1))
        penalty[:, np.arange(p), np.arange(p)] = part[:, 0, None]
        theta = np.linalg.solve(a + penalty, b[:, :, None])[:, :, 0]
        inside_sq, outside, n = sums[:, -3], sums[:, -2], sums[:, -1]
        room = n - outside * part[:, 1] ** 2
        # where too few rows lie inside for a closed form, the objective still falls as the scale grows: double it
        old = state[active, p + 1]
        sigma = np.where(room > 0, np.sqrt(np.maximum(inside_sq, 1e-300) / np.maximum(room, 1e-300)), 2.0 * old)
        new = np.concatenate([theta, sigma[:, None]], axis=1)
        moved = np.max(np.abs(new - state[active]) / (np.abs(new) + 1e-12), axis=1)
        state[active] = new
        active = active[moved >= TOLERANCE]
    return state


def huber_search(
    df: DataFrame, y: str, x: Sequence[str], alphas: Sequence[float] = ALPHAS, epsilons: Sequence[float] = EPSILONS,
) -> LinearModel:
    """The best Huber fit of the grid by mean R2 over the folds of ``fold`` among rows where ``is_test`` is false; refitted on all of them.

    Rows with a NULL in ``y`` or ``x`` are left out. ``settings`` hold alpha, epsilon, scale and the mean R2 of the winner.
    """
    names = [f"_x{j}" for j in range(len(x))]
    rows = df.where(~F.col("is_test")).select(
        F.col("fold").cast("long").alias("_fold"), F.col(f"`{y}`").cast("double").alias("_y"),
        *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(x, names)]).na.drop()
    per_fold = rows.groupBy("_fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") ** 2).alias("syy"),
        *[F.sum(n).alias(f"s{j}") for j, n in enumerate(names)], *[F.sum(F.col(n) ** 2).alias(f"q{j}") for j, n in enumerate(names)],
    ).collect()  # one row per fold
    folds = sorted(r["_fold"] for r in per_fold)
    stats = {r["_fold"]: r for r in per_fold}

    def scaler(kept):
        n = sum(stats[f]["n"] for f in kept)
        s = np.array([sum(stats[f][f"s{j}"] for f in kept) for j in range(len(x))]) / n
        q = np.array([sum(stats[f][f"q{j}"] for f in kept) for j in range(len(x))]) / n
        sd = np.sqrt(np.maximum(q - s * s, 0.0))
        return np.stack([s, np.where(sd > 0, sd, 1.0)])

    # fold index k in 0..K-1 is the k-th fold held out; index K stands for all rows
    scale = np.stack([scaler([f for f in folds if f != k]) for k in folds] + [scaler(folds)])
    def target(kept):
        n = sum(stats[f]["n"] for f in kept)
        m = sum(stats[f]["sy"] for f in kept) / n
        return m, float(np.sqrt(max(sum(stats[f]["syy"] for f in kept) / n - m * m, 0.0)))

    targets = np.array([target([f for f in folds if f != k]) for k in folds] + [target(folds)])
    grid = [(a, e) for a in alphas for e in epsilons]
    fits = np.array([(a, e, folds[k]) for a, e in grid for k in range(len(folds))], np.float64)
    which = np.array([k for _ in grid for k in range(len(folds))])
    total = sum(r["n"] for r in per_fold)
    sst = np.array([stats[f]["syy"] - stats[f]["sy"] ** 2 / stats[f]["n"] for f in folds])
    if total > MOST_SCANNED:
        try:
            best, r2, final = huber_bands.search(rows, total, names, folds, scale, alphas, epsilons, sst)
            return _named(y, x, scale[-1], final, grid[best], r2[best])
        except (huber_bands.NoSolution, np.linalg.LinAlgError) as error:
            warnings.warn(f"all rows are scanned for every round: {error}")
    rows = spread(rows).persist()
    try:
        state = _fit_all(rows, names, fits, which, scale, targets[which])
        error = _scan(rows, names, fits, which, state, scale, "score")[:, 0]
        r2 = (1 - error / sst[which]).reshape(len(grid), len(folds)).mean(axis=1)
        best = int(np.argmax(r2))  # the first of the best, in (alpha, epsilon) order
        alpha, epsilon = grid[best]
        final = _fit_all(rows, names, np.array([(alpha, epsilon, -1)], np.float64), np.array([len(folds)]), scale, targets[[len(folds)]])[0]
    finally:
        rows.unpersist()
    return _named(y, x, scale[-1], final, (alpha, epsilon), r2[best])


def _named(y: str, x: Sequence[str], scale: np.ndarray, final: np.ndarray, pair: tuple[float, float], r2: float) -> LinearModel:
    """A fit on scaled columns (coefficients, intercept, scale) as a model of the columns."""
    w = final[: len(x)] / scale[1]
    intercept = float(final[len(x)] - w @ scale[0])
    return LinearModel("huber", y, dict(zip(x, map(float, w))), intercept,
                       {"alpha": pair[0], "epsilon": pair[1], "scale": float(final[-1]), "cv_r2": float(r2)})
