"""Cross-products of numeric columns, per group of rows, from one scan.

A Gram holds the row count, the means and the centred cross-products. Groups
add and subtract exactly, so the training part of each fold is the whole minus
the fold, and no fit needs the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NARROW = 12


@dataclass(frozen=True)
class Gram:
    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cross: np.ndarray  # sum over rows of (v - mean)(v - mean)'

    def __add__(self, other: "Gram") -> "Gram":
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        gap = other.mean - self.mean
        return Gram(
            self.columns, n, self.mean + gap * (other.n / n),
            self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n),
        )

    def __sub__(self, part: "Gram") -> "Gram":
        n = self.n - part.n
        if n <= 0:
            raise ValueError("no rows are left outside this part")
        mean = (self.mean * self.n - part.mean * part.n) / n
        gap = part.mean - mean
        return Gram(
            self.columns, n, mean, self.cross - part.cross - np.outer(gap, gap) * (n * part.n / self.n)
        )

    def pick(self, cols: Sequence[str]) -> "Gram":
        at = [self.columns.index(c) for c in cols]
        return Gram(tuple(cols), self.n, self.mean[at], self.cross[np.ix_(at, at)])

    @property
    def sd(self) -> np.ndarray:
        """Population standard deviations, 1 where a column does not vary."""
        sd = np.sqrt(np.maximum(np.diag(self.cross), 0) / max(self.n, 1))
        return np.where(sd > 1e-12, sd, 1.0)

    def standardized(self, y: str, scale: "Gram | None" = None) -> "Gram":
        """Every column but ``y`` divided by its deviation and centred, taken from ``scale``."""
        base = scale or self
        x = np.array([c != y for c in self.columns])
        shift, width = np.where(x, base.mean, 0.0), np.where(x, base.sd, 1.0)
        return Gram(self.columns, self.n, (self.mean - shift) / width, self.cross / np.outer(width, width))


def gram_by(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), narrow: int = NARROW) -> dict[tuple, Gram]:
    """Gram per group of the rows that are complete in ``cols``. The groups and the columns are few, the rows need not be."""
    for c in cols:
        df = df.where(F.col(f"`{c}`").isNotNull())
    if len(cols) <= narrow:
        return _narrow(df, tuple(cols), list(keys))
    return _wide(df, tuple(cols), list(keys))


def whole(parts: dict[tuple, Gram]) -> Gram:
    out = None
    for part in parts.values():
        out = part if out is None else out + part
    if out is None:
        raise ValueError("no rows")
    return out


def _narrow(df: DataFrame, cols: tuple[str, ...], keys: list[str]) -> dict[tuple, Gram]:
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(F.col(f"`{cols[i]}`"), F.col(f"`{cols[j]}`")).alias(f"c{i}_{j}") for i, j in pairs]
    out = {}
    for r in df.groupBy(*keys).agg(*aggs).collect():  # one row per group
        n = r["_n"]
        if not n:
            continue
        cross = np.zeros((d, d))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r[f"c{i}_{j}"] * n
        out[tuple(r[k] for k in keys)] = Gram(cols, n, np.array([r[f"m{i}"] for i in range(d)]), cross)
    return out


def _wide(df: DataFrame, cols: tuple[str, ...], keys: list[str]) -> dict[tuple, Gram]:
    """Matrix products inside the tasks, entries summed by Spark."""
    d = len(cols)
    shift = np.array(df.agg(*[F.avg(F.col(f"`{c}`")) for c in cols]).first(), dtype=float)
    group = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("{}")
    frame = df.select(group.alias("_group"), *keys, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("_v"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("_group", sort=False):
                v = np.stack(part["_v"].to_numpy()) - shift
                v = np.hstack([np.ones((len(v), 1)), v])
                held[name] = held.get(name, 0) + v.T @ v
        for name, m in held.items():
            i, j = np.triu_indices(d + 1)
            yield pd.DataFrame({"_group": name, "i": i, "j": j, "s": m[i, j]})

    sums = (
        frame.select("_group", "_v")
        .mapInPandas(products, "_group string, i int, j int, s double")
        .groupBy("_group", "i", "j")
        .agg(F.sum("s").alias("s"))
    )
    labels = {r["_group"]: tuple(r[k] for k in keys) for r in frame.select("_group", *keys).distinct().collect()}
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # (d + 1)(d + 2) / 2 rows per group
        m = found.setdefault(r["_group"], np.zeros((d + 1, d + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    out = {}
    for name, m in found.items():
        n, first = m[0, 0], m[0, 1:]
        out[labels[name]] = Gram(cols, int(round(n)), shift + first / n, m[1:, 1:] - np.outer(first, first) / n)
    return out
