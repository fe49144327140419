"""Similar past cases, coverage of the training data, projections and maps."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantscope.functions.numeric import all_of, clean, equal_width_bin
from plantscope.operators.cleaning import numeric_columns
from plantscope.operators.gram import gram_by
from plantscope.operators.quantiles import exact_quantiles
from plantscope.session import local_table, materialize

SCENARIOS_AT_ONCE = 64
SALTS = 64
MAP_BINS = 60

# Reach of the search for similar cases.
PRESETS = {
    "narrow": {"alpha": 0.05, "k_cap": 20, "k_max": 200},
    "balanced": {"alpha": 0.20, "k_cap": 80, "k_max": 500},
    "wide": {"alpha": 0.5, "k_cap": 200, "k_max": 2000},
}


def exploration_preset(name: str | None) -> dict[str, float]:
    """Preset by the start of its name, in any case; anything else is the balanced one."""
    label = (name or "balanced").lower()
    for key in ("narrow", "wide"):
        if label.startswith(key):
            return dict(PRESETS[key])
    return dict(PRESETS["balanced"])


def case_scale(df: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Population deviation per column, 1 where it does not vary."""
    if not numeric:
        return {}
    row = df.agg(*[F.stddev_pop(clean(F.col(f"`{c}`"))).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
    return {c: row[f"s{i}"] if row[f"s{i}"] and row[f"s{i}"] > 1e-12 else 1.0 for i, c in enumerate(numeric)}


def _away(
    df: DataFrame, chunk: Sequence[Mapping[str, object]], scale: Mapping[str, float], categorical: Sequence[str] = (), metric: str = "L2",
    cat_weight: float = 1.0, extra: Mapping[str, Sequence[object]] | None = None,
) -> DataFrame:
    """Every row next to every scenario of ``chunk``: the columns, ``scenario_id``, the ``extra`` doubles by scenario, and ``distance``.

    Numbers are compared in deviations, categories count ``cat_weight`` when they differ or are missing. Columns a scenario leaves
    open are skipped; the distance is NULL when a needed number is missing in the row. Scenarios are one array of constants, so the
    generated code holds one distance and not one for each of them (methods of many distances are too long for the JVM to compile).
    """

    def open_at(s, c):
        return s.get(c) is None or s[c] != s[c]

    asked = [c for c in scale if not all(open_at(s, c) for s in chunk)]
    named = [c for c in categorical if not all(open_at(s, c) for s in chunk)]
    extra = extra or {}
    marks = F.array(*[
        F.struct(
            F.lit(s["scenario_id"]).alias("scenario_id"),
            *[F.lit(None if open_at(s, c) else float(s[c])).cast("double").alias(f"_q{j}") for j, c in enumerate(asked)],
            *[F.lit(None if open_at(s, c) else str(s[c])).cast("string").alias(f"_n{j}") for j, c in enumerate(named)],
            *[F.lit(values[i]).cast("double").alias(name) for name, values in extra.items()],
        )
        for i, s in enumerate(chunk)
    ])
    wide = df.select("*", *[clean(F.col(f"`{c}`")).alias(f"_x{j}") for j, c in enumerate(asked)])
    long = wide.select("*", F.inline(marks))
    total, known = F.lit(0.0), []
    for j, c in enumerate(asked):
        x, q = F.col(f"_x{j}"), F.col(f"_q{j}")
        gap = (x - q) / F.lit(float(scale[c]))
        total = total + F.when(q.isNull(), 0.0).otherwise(F.abs(gap) if metric.upper() == "L1" else gap * gap)
        known.append(q.isNull() | x.isNotNull())
    if metric.upper() != "L1":
        total = F.sqrt(total)
    for j, c in enumerate(named):
        q = F.col(f"_n{j}")
        total = total + F.when(q.isNull() | F.col(f"`{c}`").cast("string").eqNullSafe(q), 0.0).otherwise(float(cat_weight))
    out = long.withColumn("distance", F.when(all_of(known), total) if known else total)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "scenario_id", *extra, "distance")


def _chunks(scenarios: DataFrame, size: int) -> Iterator[list[dict]]:
    """Scenario rows in lists of bounded length, however many there are."""
    rows = (r.asDict() for r in scenarios.toLocalIterator())
    while part := list(islice(rows, size)):
        yield part


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def case_distances(
    df: DataFrame, scenarios: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), keep: Sequence[str] = (),
    metric: str = "L2", cat_weight: float = 1.0,
) -> DataFrame:
    """Distance of every row to every scenario: the kept columns, ``scenario_id, distance``."""
    scale = case_scale(df, numeric)
    parts = []
    for chunk in _chunks(scenarios, SCENARIOS_AT_ONCE):
        parts.append(_away(df, chunk, scale, categorical, metric, cat_weight).select(*keep, "scenario_id", "distance"))
    return _union(parts)


@dataclass(frozen=True)
class Reach:
    """Deviations by column, and the scenarios in chunks with the best distance of each."""

    scale: Mapping[str, float]
    categorical: tuple[str, ...]
    metric: str
    cat_weight: float
    chunks: tuple[tuple[list[dict], list[float | None]], ...]

    def away(self, df: DataFrame, chunk: Sequence[dict], **extra: Sequence[float | None]) -> DataFrame:
        """Rounded distances, so that equal ones tie whatever the order of the additions."""
        long = _away(df, chunk, self.scale, self.categorical, self.metric, self.cat_weight, extra)
        return long.withColumn("distance", F.rint(F.col("distance") * 1e12) / 1e12)

    def within(self, df: DataFrame, alpha: float | None = None, delta: float | None = None) -> DataFrame:
        """Rows next to each scenario inside its limit: the columns, ``scenario_id, d_best, distance``."""
        parts = []
        for chunk, best in self.chunks:
            limits = []
            for b in best:
                some = [b * (1 + alpha)] if b is not None and alpha is not None else []
                some += [b + delta] if b is not None and delta is not None else []
                limits.append(None if b is None else min(some, default=float("inf")))
            near = self.away(df, chunk, d_best=best, _limit=limits)
            parts.append(near.where(F.col("distance") <= F.col("_limit")).drop("_limit"))
        return _union(parts)


def case_reach(
    df: DataFrame, scenarios: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), metric: str = "L2", cat_weight: float = 1.0
) -> Reach:
    """Deviations and best distances, from one scan each (one more for every further chunk of scenarios)."""
    reach = Reach(case_scale(df, numeric), tuple(categorical), metric, cat_weight, ())
    chunks = []
    for chunk in _chunks(scenarios, SCENARIOS_AT_ONCE):
        numbered = [s | {"scenario_id": i} for i, s in enumerate(chunk)]  # scenarios may share an id
        found = reach.away(df, numbered).groupBy("scenario_id").agg(F.min("distance").alias("best")).collect()
        best = {r["scenario_id"]: r["best"] for r in found}
        chunks.append((chunk, [best.get(i) for i in range(len(chunk))]))
    return replace(reach, chunks=tuple(chunks))


def nearest_cases(
    df: DataFrame, scenarios: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
    order: Sequence[str] = (), metric: str = "L2", cat_weight: float = 1.0, k_max: int = 500, k_cap: int = 80,
    alpha: float | None = 0.20, delta: float | None = None,
) -> DataFrame:
    """Closest rows of each scenario with ``scenario_id, rank, distance, d_best, similarity``.

    A row is kept when its distance is within ``(1 + alpha)`` times the best
    and within ``delta`` of it; ties go by ``order``. The first scan finds the
    best distance of every scenario, the second emits only rows inside the
    limit, and ranking is done in salted groups before the last few meet.
    """
    reach = case_reach(df, scenarios, numeric, categorical, metric, cat_weight)
    return _ranked(reach.within(df, alpha, delta), df.columns, order, min(k_max, k_cap))


def nearest_by_preset(
    df: DataFrame, scenarios: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), order: Sequence[str] = (),
    presets: Mapping[str, Mapping[str, float]] = PRESETS,
) -> dict[str, DataFrame]:
    """:func:`nearest_cases` for every preset, in as many scans as for one: what is inside the widest limit is written once."""
    reach = case_reach(df, scenarios, numeric, categorical)
    inside = materialize(reach.within(df, max(p["alpha"] for p in presets.values())), "inside")
    return {
        name: _ranked(inside.where(F.col("distance") <= F.col("d_best") * F.lit(1 + p["alpha"])), df.columns, order, min(p["k_max"], p["k_cap"]))
        for name, p in presets.items()
    }


def _ranked(near: DataFrame, columns: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of every scenario among those of :meth:`Reach.within`."""
    near = near.select(*[F.col(f"`{c}`") for c in columns], "scenario_id", "distance", "d_best")
    near = near.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(SALTS)))
    ties = ["distance", *order]
    within = Window.partitionBy("scenario_id", "_salt").orderBy(*ties)
    last = Window.partitionBy("scenario_id").orderBy(*ties)
    return (
        near.withColumn("_r", F.row_number().over(within))
        .where(F.col("_r") <= most)
        .drop("_r", "_salt")
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= most)
        .withColumn("similarity", similarity(F.col("distance"), F.col("d_best")))
    )


def similarity(distance: Column, best: Column) -> Column:
    """1 for the best case, less with distance; 0 when a distance is unknown."""
    return F.coalesce((1 + clean(best)) / (1 + clean(distance)), F.lit(0.0))


def difference_flags(
    matched: DataFrame, scenarios: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), top: int = 20
) -> DataFrame:
    """Long table of the best ``top`` cases: how each cell differs from the scenario."""
    asked = scenarios.select(
        "scenario_id", *[F.col(f"`{c}`").alias(f"_q_{c}") for c in [*numeric, *categorical] if c in scenarios.columns]
    )
    joined = matched.where(F.col("rank") <= top).join(asked, "scenario_id")
    cells = []
    for c in numeric:
        a, b = clean(F.col(f"`{c}`")), clean(F.col(f"_q_{c}"))
        gap = F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-6))
        flag = F.when(gap > 0.05, "large").when(gap > 0.01, "small").when(gap.isNotNull(), "same").otherwise("unknown")
        cells.append(F.struct(F.lit(c).alias("column"), flag.alias("flag")))
    for c in categorical:
        if c not in scenarios.columns:
            continue
        same = F.col(f"`{c}`").cast("string").eqNullSafe(F.col(f"_q_{c}").cast("string"))
        cells.append(F.struct(F.lit(c).alias("column"), F.when(same, "same").otherwise("differs").alias("flag")))
    return joined.select("scenario_id", "rank", F.inline(F.array(*cells)))


# --- coverage -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Coverage:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    inverse: tuple[tuple[float, ...], ...]
    p90: float
    p975: float
    lower: tuple[float, ...]
    upper: tuple[float, ...]

    def d2(self) -> Column:
        """Squared Mahalanobis distance of a row."""
        gaps = [clean(F.col(f"`{c}`")) - F.lit(m) for c, m in zip(self.columns, self.mean)]
        out = F.lit(0.0)
        for i, a in enumerate(gaps):
            for j in range(i, len(gaps)):
                out = out + F.lit(self.inverse[i][j] * (1 if i == j else 2)) * a * gaps[j]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        row = (list(self.columns), list(self.mean), [list(r) for r in self.inverse], self.p90, self.p975,
               list(self.lower), list(self.upper))
        return local_table(spark, [row], "columns array<string>, mean array<double>, inverse array<array<double>>, p90 double, p975 double,"
            "lower array<double>, upper array<double>"
        )


def coverage_fit(df: DataFrame, cols: Sequence[str]) -> Coverage:
    """Centre, inverse covariance, distance limits and 1 to 99 percent ranges of the training rows."""
    rows = df.select(*[clean(F.col(f"`{c}`")).alias(c) for c in cols]).na.drop()
    g = gram_by(rows, cols)[()]
    inverse = np.linalg.pinv(g.cross / (g.n - 1))
    start = Coverage(tuple(cols), tuple(map(float, g.mean)), tuple(tuple(map(float, r)) for r in inverse), 0.0, 0.0, (), ())
    q = exact_quantiles(rows.withColumn("_d2", start.d2()), [*cols, "_d2"], (0.01, 0.9, 0.975, 0.99))
    return Coverage(
        start.columns, start.mean, start.inverse, q["_d2"][0.9], q["_d2"][0.975],
        tuple(q[c][0.01] for c in cols), tuple(q[c][0.99] for c in cols),
    )


def with_coverage(df: DataFrame, fit: Coverage) -> DataFrame:
    """Adds ``d2`` and ``coverage`` (high, medium, low); also works on a stream."""
    d2 = fit.d2()
    level = F.when(d2 <= fit.p90, "high").when(d2 <= fit.p975, "medium").when(d2.isNotNull(), "low")
    return df.withColumn("d2", d2).withColumn("coverage", level)


def with_extreme_variables(df: DataFrame, fit: Coverage) -> DataFrame:
    """Adds ``extreme_variables``: names of the columns outside the usual range; also works on a stream."""
    outside = []
    for c, low, high in zip(fit.columns, fit.lower, fit.upper):
        x = clean(F.col(f"`{c}`"))
        outside.append(F.when((x < low) | (x > high), F.lit(c)))
    return df.withColumn("extreme_variables", F.array_compact(F.array(*outside)))


# --- projections and maps --------------------------------------------------------------------


@dataclass(frozen=True)
class Projection:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    def column(self, k: int) -> Column:
        out = F.lit(0.0)
        for c, m, w in zip(self.columns, self.mean, self.loadings[k]):
            out = out + (F.coalesce(clean(F.col(f"`{c}`")), F.lit(0.0)) - F.lit(m)) * F.lit(w)
        return out


def pca_fit(df: DataFrame, cols: Sequence[str], k: int = 2) -> Projection:
    """First ``k`` principal axes of the unscaled columns, missing cells as 0.

    The sign is set so that the largest loading of an axis is positive.
    """
    rows = df.select(*[F.coalesce(clean(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in cols])
    g = gram_by(rows, cols)[()]
    values, vectors = np.linalg.eigh(g.cross / (g.n - 1))
    axes = []
    for i in np.argsort(values)[::-1][:k]:
        v = vectors[:, i]
        axes.append(tuple(map(float, v * np.sign(v[np.argmax(np.abs(v))]))))
    share = np.sort(values)[::-1][:k] / max(values.sum(), 1e-300)
    return Projection(tuple(cols), tuple(map(float, g.mean)), tuple(axes), tuple(map(float, share)))


def project(df: DataFrame, fit: Projection) -> DataFrame:
    return df.select("*", *[fit.column(k).alias(f"pc{k + 1}") for k in range(len(fit.loadings))])


def grid_mean_map(df: DataFrame, ax: str, ay: str, y: str, bins: int = MAP_BINS) -> DataFrame:
    """Mean target and row count per cell of a grid over two axes; empty cells are left out."""
    a, b = clean(F.col(f"`{ax}`")), clean(F.col(f"`{ay}`"))
    e = df.agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1")).first()
    return (
        df.where(a.isNotNull() & b.isNotNull())
        .groupBy(
            equal_width_bin(a, e["a0"], e["a1"], bins).alias("cx"), equal_width_bin(b, e["b0"], e["b1"], bins).alias("cy")
        )
        .agg(F.avg(clean(F.col(f"`{y}`"))).alias("mean_y"), F.count(F.lit(1)).alias("n"))
    )


def variable_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum, maximum, median and step of each column."""
    aggs = []
    for i, c in enumerate(cols):
        v = clean(F.col(f"`{c}`"))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    extent = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols) if row[f"n{i}"]}
    middle = exact_quantiles(df, list(extent), (0.5,), extent=extent)
    rows = [(c, lo, hi, middle[c][0.5], (hi - lo) / 100 if hi > lo else 0.01) for c, (_, lo, hi) in extent.items()]
    return local_table(df.sparkSession, rows, "column string, min double, max double, median double, step double")


def split_columns(df: DataFrame, x: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and other columns among ``x``."""
    numeric = numeric_columns(df, x)
    return numeric, [c for c in x if c not in numeric]
