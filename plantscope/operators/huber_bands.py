"""The Huber grid on large tables: rows far from a threshold are added up once, only those near it are looked at again.

For fixed coefficients and scale a row lies inside its threshold or beyond it, above or below. As long as no row changes sides the objective
is quadratic, and what it needs of the rows are sums: cross-products of the inside ones, signed sums and the number of the outside ones. From
them the minimum is solved for directly, and solved again after rows are told apart anew until none changes (a Newton method, few rounds).

A row whose side is the same for all coefficients and scales of a region is settled: one scan adds the settled rows of each threshold by fold,
and writes out the others, those in a band around the thresholds. Regions come first from a sample of the rows (its solutions and their
errors), then from the solutions for all rows, around which those of all penalties and folds lie closely. The sample and the regions never
enter a result: a solution counts only if it lies in the region its sums were made for, and otherwise the region is widened and the scan made anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.session import materialize

#: Rows of the sample that gives the first region.
SAMPLE = 200_000
#: Rounds of solving, and tries with a wider region, before the plain search is made instead.
ROUNDS, TRIES = 40, 3
TOLERANCE = 1e-10
CHUNK = 4096


class NoSolution(Exception):
    """The rounds did not settle; the plain search must be made."""


@dataclass(frozen=True)
class Shape:
    """How rows are read: names of the columns, their mean and deviation, coefficients (of the scaled columns and 1) taken off the target, thresholds."""

    names: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray
    taken: np.ndarray
    epsilons: np.ndarray
    folds: tuple[int, ...]

    @property
    def q(self) -> int:
        return len(self.names) + 1

    @property
    def size(self) -> int:
        """Numbers per sum: cross-products of (u, 1, y), signed sums of (u, 1), outside rows."""
        return (self.q + 1) * (self.q + 2) // 2 + self.q + 1

    def read(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, 1), the target without what is taken off, and the place of the fold."""
        u1 = np.ones((len(pdf), self.q))
        u1[:, :-1] = (pdf[list(self.names)].to_numpy(np.float64) - self.mean) / self.sd
        fold = np.searchsorted(self.folds, pdf["_fold"].to_numpy(np.int64))
        return u1, pdf["_y"].to_numpy(np.float64) - u1 @ self.taken, fold

    def products(self, u1: np.ndarray, y: np.ndarray) -> np.ndarray:
        v = np.column_stack([u1, y])
        rise, fall = np.triu_indices(self.q + 1)
        return v[:, rise] * v[:, fall]

    def add(self, inside: np.ndarray, sign: np.ndarray, products: np.ndarray, u1: np.ndarray) -> np.ndarray:
        """Sums for each column of ``inside`` and ``sign`` (rows x fits)."""
        return np.column_stack([inside.T.astype(np.float64) @ products, sign.T @ u1, np.abs(sign).sum(axis=0)])

    def parts(self, sums: np.ndarray, to: np.ndarray):
        """Cross-products, right-hand side, squares, signed sums, inside and outside rows, on the columns (z, 1) = to (u, 1)."""
        q, t = self.q, (self.q + 1) * (self.q + 2) // 2
        rise, fall = np.triu_indices(q + 1)
        m = np.zeros((len(sums), q + 1, q + 1))
        m[:, rise, fall] = m[:, fall, rise] = sums[:, :t]
        a = to @ m[:, :q, :q] @ to.transpose(0, 2, 1)
        b = np.einsum("gij,gj->gi", to, m[:, :q, q])
        s = np.einsum("gij,gj->gi", to, sums[:, t : t + q])
        return a, b, m[:, q, q], s, m[:, q - 1, q - 1], sums[:, -1]


@dataclass(frozen=True)
class Region:
    """For each threshold a centre (coefficients of (u, 1), scale), the root of a matrix whose ellipsoid holds the coefficients, and the room of the scale."""

    centre: np.ndarray  # E x q
    sigma: np.ndarray
    root: np.ndarray  # E x q x q, lower
    room: np.ndarray

    def holds(self, theta: np.ndarray, sigma: np.ndarray, of: np.ndarray) -> bool:
        gap = np.linalg.solve(self.root[of], (theta - self.centre[of])[:, :, None])[:, :, 0]
        return bool((np.einsum("gi,gi->g", gap, gap) <= 1).all() and (np.abs(sigma - self.sigma[of]) <= self.room[of]).all())


def stationary(parts, alpha: np.ndarray, epsilon: np.ndarray, sigma: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (beyond ``taken``) and scale that minimise the objective of each fit while no row changes sides."""
    a, b, c, s, inside, outside = parts
    q = a.shape[1]
    free = np.append(np.ones(q - 1), 0.0)
    room = inside + outside - outside * epsilon**2
    for _ in range(60):
        pull = alpha * sigma
        m = a + pull[:, None, None] * np.diag(free)
        both = np.linalg.solve(m, np.stack([b - pull[:, None] * free * taken, epsilon[:, None] * s], axis=-1))
        first, turn = both[:, :, 0], both[:, :, 1]
        along = np.einsum("gij,gj->gi", a, turn)
        rest = np.einsum("gi,gij,gj->g", first, a, first) - 2 * np.einsum("gi,gi->g", b, first) + c
        cross = np.einsum("gi,gi->g", first, along) - np.einsum("gi,gi->g", b, turn)
        lead = room - np.einsum("gi,gi->g", turn, along)
        under = cross**2 + lead * rest
        if not (np.all(lead > 0) and np.all(under > 0)):
            raise NoSolution("too few rows inside the threshold")
        new = (cross + np.sqrt(under)) / lead
        done = np.max(np.abs(new - sigma) / new) < 1e-15
        sigma = new
        if done:
            break
    return first + sigma[:, None] * turn, sigma


def _sides(u1: np.ndarray, y: np.ndarray, theta: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = y[:, None] - u1 @ theta.T
    inside = np.abs(r) <= limit
    return inside, np.where(inside, 0.0, np.sign(r))


def _sample_region(pdf: pd.DataFrame, shape: Shape, alphas: np.ndarray, wide: float) -> tuple[np.ndarray, Region]:
    """Coefficients to take off the target, and a region from the solutions for the sample with the least and the largest penalty (``alphas``)."""
    u1, y, _ = shape.read(pdf)
    products, eye, zero = shape.products(u1, y), np.eye(shape.q)[None], np.zeros((1, shape.q))
    theta = np.linalg.lstsq(u1, y, rcond=None)[0]
    sigma = max(1.4826 * float(np.median(np.abs(y - u1 @ theta))), 1e-12 * float(np.abs(y).max() + 1e-300))
    centre, scale, root, room = [], [], [], []
    for epsilon in shape.epsilons:
        ends = []
        for alpha in alphas:
            for k in range(ROUNDS):
                inside, sign = _sides(u1, y, theta[None], epsilon * np.array([sigma]))
                # the scale alone is moved first, until it suits the threshold
                if k < 5:
                    out = float((~inside).sum())
                    left = len(y) - out * epsilon**2
                    r = (y - u1 @ theta)[inside[:, 0]]
                    sigma = float(np.sqrt((r @ r) / left)) if left > 0 and r.any() else 2.0 * sigma
                    continue
                one = np.array([alpha]), np.array([epsilon])
                new, s = stationary(shape.parts(shape.add(inside, sign, products, u1), eye), *one, np.array([sigma]), zero)
                moved = max(float(np.max(np.abs(new[0] - theta))), abs(s[0] - sigma)) / s[0]
                theta, sigma = new[0], float(s[0])
                if moved < 1e-9:
                    break
            ends.append((theta, sigma))
        theta, sigma = (ends[0][0] + ends[-1][0]) / 2, (ends[0][1] + ends[-1][1]) / 2
        half = ends[0][0] - theta
        r = np.minimum(np.abs(y - u1 @ theta), epsilon * sigma)
        inside = np.abs(y - u1 @ theta) <= epsilon * sigma
        bread = np.linalg.pinv((u1 * inside[:, None]).T @ u1 + 1e-9 * len(y) * np.eye(shape.q))
        spread = bread @ ((u1 * (r * r)[:, None]).T @ u1) @ bread
        spread = (6 * wide) ** 2 * spread + (3 * wide) ** 2 * np.outer(half, half) + 1e-18 * sigma**2 * np.eye(shape.q)
        centre.append(theta)
        scale.append(sigma)
        root.append(np.linalg.cholesky(spread))
        room.append(wide * (7.5 * sigma / np.sqrt(len(y)) + 3 * abs(ends[0][1] - sigma)))
    return centre[len(centre) // 2], Region(np.array(centre), np.array(scale), np.array(root), np.array(room))


def _settle(rows: DataFrame, shape: Shape, region: Region) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with thresholds left open (bits of ``_open``), the sums of the rows settled here by fold and threshold, and of all rows by fold."""
    folds, number, size = len(shape.folds), len(shape.epsilons), shape.size
    limit, margin = shape.epsilons * region.sigma, shape.epsilons * region.room
    roots, every_e = np.hstack(list(region.root)), np.arange(number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, every = np.zeros((folds, number, size)), np.zeros((folds, size))
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                u1, y, fold = shape.read(part)
                was = part["_open"].to_numpy(np.int64)
                products = shape.products(u1, y)
                open_ = (was[:, None] >> every_e & 1).astype(bool)
                r = y[:, None] - u1 @ region.centre.T
                play = (u1 @ roots).reshape(len(part), number, -1)
                play = np.sqrt(np.einsum("bei,bei->be", play, play)) + margin
                away = np.abs(r)
                inside = open_ & (away + play <= limit)
                outside = open_ & (away - play > limit)
                now = ((open_ & ~inside & ~outside) << every_e).sum(axis=1)
                of = fold[:, None] == np.arange(folds)
                sign = np.where(outside, np.sign(r), 0.0)
                both = [(of[:, :, None] * v[:, None, :]).reshape(len(part), -1) for v in (inside, sign)]
                total += shape.add(both[0], both[1], products, u1).reshape(total.shape)
                every[:, : products.shape[1]] += of.T.astype(np.float64) @ products
                if now.any():
                    yield part.assign(_open=now, _sums=None)[now != 0]
        last = {c: [0] for c in ("_fold", "_open")} | {c: [0.0] for c in ("_y", *shape.names)} | {"_sums": [total.tobytes() + every.tobytes()]}
        yield pd.DataFrame(last)

    names = ", ".join(f"{c} double" for c in shape.names)
    found = materialize(rows.mapInPandas(run, f"_fold long, _y double, {names}, _open long, _sums binary"), "huber")
    total = np.zeros(folds * number * size + folds * size)
    for r in found.where("_sums is not null").select("_sums").toLocalIterator():  # one row per task
        total += np.frombuffer(r[0])
    cut = folds * number * size
    return found.where("_sums is null").drop("_sums"), total[:cut].reshape(folds, number, size), total[cut:].reshape(folds, size)


def _near(rows: DataFrame, shape: Shape, theta: np.ndarray, limit: np.ndarray, of: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sums over the open rows for every fit: coefficients of (u, 1), limit, place of the threshold and of the fold held out (-1: none)."""
    groups = [(e, k, np.flatnonzero((of == e) & (held == k))) for e, k in sorted({(int(e), int(k)) for e, k in zip(of, held)})]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(of), shape.size))
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                u1, y, fold = shape.read(part)
                open_, products = part["_open"].to_numpy(np.int64), shape.products(u1, y)
                for e, k, fits in groups:
                    some = np.flatnonzero((open_ >> e & 1).astype(bool) & (fold != k))
                    if len(some):
                        inside, sign = _sides(u1[some], y[some], theta[fits], limit[fits])
                        total[fits] += shape.add(inside, sign, products[some], u1[some])
        yield pd.DataFrame(total, columns=[f"v{j}" for j in range(shape.size)]).assign(g=np.arange(len(of)))

    ddl = ", ".join(f"v{j} double" for j in range(shape.size)) + ", g long"
    sums = rows.mapInPandas(run, ddl).groupBy("g").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(shape.size)])
    out = np.zeros((len(of), shape.size))
    for r in sums.collect():  # one row per fit
        out[r["g"]] = r[1:]
    return out


def _solve(rows: DataFrame, shape: Shape, base: np.ndarray, fits, to: np.ndarray, theta: np.ndarray, sigma: np.ndarray, tolerance: float = TOLERANCE):
    """Coefficients of (u, 1) and scale of every fit, from the settled sums and the open rows. ``fits``: alpha, place of the threshold, of the fold held out."""
    alpha, of, held = fits
    epsilon = shape.epsilons[of]
    settled = base.sum(axis=0)[of] - np.where((held >= 0)[:, None], base[np.maximum(held, 0), of], 0.0)
    back = to.transpose(0, 2, 1)  # coefficients of (u, 1) from those of (z, 1)
    taken = np.linalg.solve(back, np.broadcast_to(shape.taken, (len(of), shape.q))[:, :, None])[:, :, 0]
    theta, sigma, active = theta.copy(), sigma.copy(), np.arange(len(of))
    for _ in range(ROUNDS):
        part = active
        sums = settled[part] + _near(rows, shape, theta[part], epsilon[part] * sigma[part], of[part], held[part])
        z, s = stationary(shape.parts(sums, to[part]), alpha[part], epsilon[part], sigma[part], taken[part])
        new = np.einsum("gij,gj->gi", back[part], z)
        moved = np.maximum(np.max(np.abs(new - theta[part]), axis=1), np.abs(s - sigma[part])) / s
        theta[part], sigma[part] = new, s
        active = part[moved >= tolerance]
        if not len(active):
            return theta, sigma
    raise NoSolution("rows keep changing sides")


def search(
    rows: DataFrame, count: int, names: Sequence[str], folds: Sequence[int], scale: np.ndarray, alphas: Sequence[float], epsilons: Sequence[float],
    spread: np.ndarray,
) -> tuple[int, np.ndarray, np.ndarray]:
    """The place of the best (alpha, epsilon) pair, the mean R2 of all, and the winner on all rows: coefficients of its scaled columns and 1, scale.

    ``scale``: means and deviations (a row per fold held out, then all rows); ``spread``: the sum of squares of the target in each fold.
    """
    mean, sd = scale[-1]
    q = len(names) + 1
    shape = Shape(tuple(names), mean, sd, np.zeros(q), np.array(epsilons, np.float64), tuple(folds))
    part = max(1, count // SAMPLE)
    # by numbers of rows, so that rows which come many times are drawn as often as others
    pdf = rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(part)) == 0).limit(2 * SAMPLE).toArrow().to_pandas()
    if len(pdf) < 1000:
        raise NoSolution("the sample is too small")
    to = np.zeros((len(scale), q, q))
    to[:, np.arange(q - 1), np.arange(q - 1)] = sd / scale[:, 1]
    to[:, : q - 1, q - 1] = (mean - scale[:, 0]) / scale[:, 1]
    to[:, q - 1, q - 1] = 1.0
    number, k = len(epsilons), len(folds)
    all_ = np.arange(number)
    middle = float(np.sqrt(min(alphas) * max(alphas)))
    grid = [(a, e) for a in alphas for e in range(number)]
    alpha, of = np.array([a for a, _ in grid for _ in folds]), np.array([e for _, e in grid for _ in folds])
    held = np.array([f for _ in grid for f in range(k)])
    for wide in (2.0**i for i in range(TRIES)):
        start = Shape(shape.names, mean, sd, np.zeros(q), shape.epsilons, shape.folds)
        taken, region = _sample_region(pdf, start, np.array([min(alphas), max(alphas)]) * len(pdf) / count, wide)
        shape = Shape(shape.names, mean, sd, taken, shape.epsilons, shape.folds)
        region = Region(region.centre - taken, region.sigma, region.root, region.room)
        near, base, every = _settle(rows.withColumn("_open", F.lit(2**number - 1).cast("long")), shape, region)
        # the middle penalty on all rows, then what the others and the folds make of its sides
        whole = np.full(number, middle), all_, np.full(number, -1)
        centre, sigma = _solve(near, shape, base, whole, np.repeat(to[-1:], number, axis=0), region.centre, region.sigma, 1e-4)
        if not region.holds(centre, sigma, all_):
            continue
        by = np.repeat(all_, k), np.tile(np.arange(k), number)
        sums = _near(near, shape, centre[by[0]], shape.epsilons[by[0]] * sigma[by[0]], *by)
        sums = (sums + base.sum(axis=0)[by[0]] - base[by[1], by[0]]).reshape(number, k, -1)[of, held]
        back = to.transpose(0, 2, 1)
        z_taken = np.linalg.solve(back, np.broadcast_to(taken, (k + 1, q))[:, :, None])[:, :, 0]
        z, s = stationary(shape.parts(sums, to[held]), alpha, shape.epsilons[of], sigma[of], z_taken[held])
        about = np.einsum("gij,gj->gi", back[held], z)
        for closer in (4.0**i for i in range(TRIES)):
            root, room = [], []
            for e in range(number):
                gap = about[of == e] - centre[e]
                inner = gap.T @ gap + region.root[e] @ region.root[e].T * (len(pdf) / count / (6 * wide) ** 2)
                root.append(closer * np.linalg.cholesky(inner + 1e-18 * sigma[e] ** 2 * np.eye(q)))
                room.append(closer * (np.abs(s[of == e] - sigma[e]).max() + 1.5 * sigma[e] / np.sqrt(count)))
            small = Region(centre, sigma, np.array(root), np.array(room))
            last, added, _ = _settle(near, shape, small)
            theta, scales = _solve(last, shape, base + added, (alpha, of, held), to[held], about, s)
            if small.holds(theta, scales, of) and region.holds(theta, scales, of):
                break
        else:
            continue
        one = np.zeros(1, np.int64)
        t = (q + 1) * (q + 2) // 2
        a, b, c, *_ = shape.parts(every[held], np.repeat(np.eye(q)[None], len(held), axis=0))
        error = np.einsum("gi,gij,gj->g", theta, a, theta) - 2 * np.einsum("gi,gi->g", b, theta) + c
        assert every[:, t:].sum() == 0
        r2 = (1 - error / spread[held]).reshape(len(grid), k).mean(axis=1)
        best = int(np.argmax(r2))
        e = np.array([grid[best][1]])
        winner, scale_of = _solve(last, shape, base + added, (np.array([grid[best][0]]), e, one - 1), to[-1:], centre[e], sigma[e])
        if small.holds(winner, scale_of, e) and region.holds(winner, scale_of, e):
            return best, r2, np.append(np.linalg.solve(back[-1], winner[0] + taken), scale_of[0])
    raise NoSolution("no region held the solutions")
