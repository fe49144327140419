"""Weighted inversions of many column pairs: the shared core of Kendall's tau and distance correlation.

For rows (a, b), an inversion is a pair with a_i < a_j and b_i > b_j. Two sums
are wanted per column pair: the number of all inversions, and their total of
(x_j - x_i)(y_j - y_i).

Every column is cut into value ranges, once for all its pairs. A cut value is a
range of its own, so values held by very many rows lie alone, in a pure range
without inversions, and the open ranges between them stay small whatever the
ties. An inversion is then one of
* both rows in the same open range of a,
* same open range of b, different ranges of a,
* both ranges different, which is settled on the grid of range totals.
So the rows are shuffled once per column that has open ranges, for all its pairs
together, and not at all for columns of few values; the grid is summed before
its shuffle. Nothing is listed per pair of columns, and the cuts come from the
driver, so no branch depends on a sampled partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.operators.ranks import ColumnSizes

CELLS_PER_BUCKET = 100_000
#: Open ranges of a column; the grid of a pair has at most some (2 * MAX_PIECES) ** 2 cells.
MAX_PIECES = 400
#: Columns of at most so many values get a pure range for each of them.
FEW_VALUES = 400
_SUMS = ["w", "wx", "wy", "wxy"]
_OUT = "pair int, weight double, cross double, tied double"


def _count(first: np.ndarray, second: np.ndarray, sums: np.ndarray) -> tuple[float, float]:
    """Inversion sums of cells; ``first`` and ``second`` are places without ties (0..n-1 in some order).

    Goes over the bits of ``second``: among cells that agree on the higher bits,
    taken in the order of ``first``, each 0 is inverted with every earlier 1.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    place, held = second[order], sums[:, order]
    weight = cross = 0.0
    for bit in range(max(1, int(n - 1).bit_length()) - 1, -1, -1):
        # Rows now stand in blocks that agree on the bits above this one.
        one = ((place >> bit) & 1).astype(bool)
        start = np.minimum((place >> (bit + 1)) << (bit + 1), n)
        running = np.zeros((4, n + 1))
        np.cumsum(np.where(one, held, 0.0), axis=1, out=running[:, 1:])
        at = np.flatnonzero(~one)
        before = running[:, at] - running[:, start[at]]
        mine = held[:, at]
        weight += float(before[0] @ mine[0])
        cross += float(before[0] @ mine[3] + before[3] @ mine[0] - before[1] @ mine[2] - before[2] @ mine[1])
        # Next level: zeros of each block first, order kept. Places are dense, so a block starts at its own number.
        ones = np.concatenate(([0], np.cumsum(one)))
        earlier_ones = ones[:-1] - ones[start]
        rank = np.where(one, earlier_ones, np.arange(n) - start - earlier_ones)
        target = ((place >> bit) << bit) + rank
        moved_place, moved_held = np.empty_like(place), np.empty_like(held)
        moved_place[target], moved_held[:, target] = place, held
        place, held = moved_place, moved_held
    return weight, cross


def _places(keys: list[np.ndarray]) -> np.ndarray:
    """Place of each row when sorted by the keys, most important first."""
    order = np.lexsort(keys[::-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order))
    return out


def _inverted(first: list[np.ndarray], second: list[np.ndarray], sums: np.ndarray) -> tuple[float, float]:
    return _count(_places(first), _places(second), sums)


def _tied(a: np.ndarray, b: np.ndarray) -> float:
    """Pairs of rows equal in both."""
    if not len(a):
        return 0.0
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    held = np.diff(np.append(starts, len(a))).astype(float)
    return float((held * (held - 1) / 2).sum())


def _cut_values(df: DataFrame, cols: Sequence[str], sizes: ColumnSizes, cells_per_bucket: int) -> dict[str, list[float]]:
    """Cut values of each column: all its values if they are few, else quantiles of its rows."""
    few = [c for c in cols if sizes.distinct[c] <= min(FEW_VALUES, cells_per_bucket)]
    out: dict[str, list[float]] = {c: [] for c in cols}
    if few:
        tagged = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in few])
        for r in df.select(F.inline(tagged)).distinct().collect():  # some FEW_VALUES for each column
            out[r["column"]].append(r["value"])
    wide = [c for c in cols if c not in few]
    pieces = min(MAX_PIECES, -(-sizes.n // cells_per_bucket))
    if wide and pieces > 1:
        found = df.approxQuantile(wide, [i / pieces for i in range(1, pieces)], 0.2 / pieces)
        out |= dict(zip(wide, found))
    return {c: sorted({float(v) for v in cuts}) for c, cuts in out.items()}


def _edges(cuts: Sequence[float]) -> tuple[list[float], list[int]]:
    """Bounds of the ranges, and the numbers of the pure ones, which hold one cut value each."""
    points = sorted({p for v in cuts for p in (v, float(np.nextafter(v, np.inf))) if np.isfinite(p)})
    own = set(cuts)
    edges = [-np.inf, *points, np.inf]
    return edges, [k for k in range(1, len(edges) - 1) if edges[k] in own and edges[k + 1] == np.nextafter(edges[k], np.inf)]


def _inside(c: str, pairs: Sequence[tuple[str, str]], edges: dict[str, list[float]], pure: dict[str, list[int]], mean: dict[str, float]):
    """The work on one open range of ``c``: inversions in the range, for every pair that ``c`` belongs to."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, (a, b) in enumerate(pairs):
            if c not in (a, b):
                continue
            x, y = pdf[a].to_numpy(dtype=float), pdf[b].to_numpy(dtype=float)
            weight = cross = tied = 0.0
            dx, dy = x - mean[a], y - mean[b]
            sums = np.stack([np.ones(len(x)), dx, dy, dx * dy])
            if c == a:
                weight, cross = _inverted([x, y], [y, x], sums)
                tied = _tied(x, y)
            elif len(edges[a]) > 2:
                # Rows of one range of a are put in the order of b, so they are not inverted among themselves.
                place = np.searchsorted(edges[a][1:-1], x, side="right")
                weight, cross = _inverted([place, y, x], [y, x], sums)
                alone = np.isin(place, pure[a])  # the others are counted in the ranges of a
                tied = _tied(x[alone], y[alone])
            out.append((i, weight, cross, tied))
        return pd.DataFrame(out, columns=["pair", "weight", "cross", "tied"])

    return work


def _between(pairs: Sequence[tuple[str, str]], pure: dict[str, list[int]]):
    """The work on the grid of one pair: both ranges different, and rows tied in two pure ranges."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["pair"].iloc[0])
        x, y = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        weight, cross = _inverted([x, y], [y, x], pdf[_SUMS].to_numpy(dtype=float).T.copy())
        held = pdf["w"].to_numpy(dtype=float)[np.isin(x, pure[pairs[i][0]]) & np.isin(y, pure[pairs[i][1]])]
        return pd.DataFrame({"pair": [i], "weight": [weight], "cross": [cross], "tied": [float((held * (held - 1) / 2).sum())]})

    return work


def inversion_sums(
    base: DataFrame, pairs: Sequence[tuple[str, str]], sizes: ColumnSizes, cells_per_bucket: int = CELLS_PER_BUCKET
) -> DataFrame:
    """``pair, weight, cross, tied`` for every pair of complete columns (no NULL) of ``base``; ``pair`` is its place in ``pairs``.

    The means are taken off first, so that the products stay small. ``tied``
    counts the pairs of rows equal in both columns.
    """
    cols = sorted({c for p in pairs for c in p})
    base = base.select(*[(F.col(c) + F.lit(0.0)).alias(c) for c in cols])  # one zero: the cuts tell -0.0 from 0.0
    ranges = {c: _edges(cuts) for c, cuts in _cut_values(base, cols, sizes, cells_per_bucket).items()}
    edges, pure = {c: e for c, (e, _) in ranges.items()}, {c: p for c, (_, p) in ranges.items()}
    cut = [c for c in cols if len(edges[c]) > 2]
    number = {c: f"_in_{i}" for i, c in enumerate(cols)}
    placed = base
    if cut:
        placed = Bucketizer(splitsArray=[edges[c] for c in cut], inputCols=cut, outputCols=[number[c] for c in cut]).transform(base)
    placed = placed.withColumns({number[c]: F.lit(0.0) for c in cols if c not in cut})
    parts = []
    for c in cols:
        partners = [d for d in cols if any(c in p and d in p for p in pairs)]
        rows = placed.select(F.col(number[c]).cast("int").alias("_range"), *partners)
        if pure[c]:
            rows = rows.where(~F.col("_range").isin(pure[c]))
        parts.append(rows.groupBy("_range").applyInPandas(_inside(c, pairs, edges, pure, sizes.mean), _OUT))
    crossed = [(i, a, b) for i, (a, b) in enumerate(pairs) if a in cut and b in cut]
    if crossed:
        x, y = F.col("x"), F.col("y")
        tagged = F.array(*[
            F.struct(F.lit(i).alias("pair"), F.col(number[a]).alias("a"), F.col(number[b]).alias("b"),
                     (F.col(a) - F.lit(sizes.mean[a])).alias("x"), (F.col(b) - F.lit(sizes.mean[b])).alias("y"))
            for i, a, b in crossed
        ])
        grid = placed.select(F.inline(tagged)).groupBy("pair", "a", "b").agg(
            F.count(F.lit(1)).cast("double").alias("w"), F.sum(x).alias("wx"), F.sum(y).alias("wy"), F.sum(x * y).alias("wxy"))
        parts.append(grid.groupBy("pair").applyInPandas(_between(pairs, pure), _OUT))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("weight", "cross", "tied")])
