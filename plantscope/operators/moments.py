"""Pairwise-complete second moments of many columns by masked matrix products, in one scan of Arrow batches.

For a batch, let M be the 0/1 matrix of present cells and X the values shifted by their column means, missing cells set to 0.
Then for every pair (i, j) of columns, over the rows where both are present:

* ``(M'M)[i, j]`` counts them,
* ``(X'M)[i, j]`` sums column i and ``(X^2'M)[i, j]`` its squares,
* ``(X'X)[i, j]`` sums the products.

Each task adds its batches' four p x p matrices and hands Spark one row per pair of columns; Spark sums them across tasks.
No aggregate is written per pair, the work per row is a few small matrix products, and what leaves a task grows with the
square of the number of columns, never with rows. Shifting by the means first keeps the sums of squares small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.functions.numeric import clean

SCHEMA = "i int, j int, n long, si double, sj double, sii double, sjj double, sij double"


def pairwise_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, si, sj, sii, sjj, sij) for 0 <= i < j < len(cols): counts and shifted sums over rows where both are present.

    NaN and infinities count as missing (``clean``). Values are shifted by their column means (NULL mean: 0); an empty table or
    a pair never present together gives n = 0 and zero sums.
    """
    names = [f"_c{k}" for k in range(len(cols))]
    base = df.select(*[clean(F.col(f"`{c}`")).alias(n) for c, n in zip(cols, names)])
    means = base.agg(*[F.avg(n).alias(n) for n in names]).first()  # one number per column
    shift = np.array([0.0 if means[n] is None else float(means[n]) for n in names])
    p = len(names)
    upper_i, upper_j = np.triu_indices(p, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((p, p))
        sx, sxx, sxy = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
        for pdf in batches:
            x = pdf[names].to_numpy(np.float64, na_value=np.nan)
            m = ~np.isnan(x)
            z = np.where(m, x - shift, 0.0)
            mf = m.astype(np.float64)
            n += mf.T @ mf
            sx += z.T @ mf
            sxx += (z * z).T @ mf
            sxy += z.T @ z
        yield pd.DataFrame({
            "i": upper_i.astype(np.int32), "j": upper_j.astype(np.int32), "n": np.rint(n[upper_i, upper_j]).astype(np.int64),
            "si": sx[upper_i, upper_j], "sj": sx[upper_j, upper_i], "sii": sxx[upper_i, upper_j], "sjj": sxx[upper_j, upper_i],
            "sij": sxy[upper_i, upper_j],
        })

    parts = base.mapInPandas(run, SCHEMA)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])


def pearson_masked(df: DataFrame, pairs: Sequence[tuple[str, str]], method: str = "pearson") -> DataFrame:
    """(x, y, method, value, n) of every pair in ``pairs``, pairwise complete, from one scan for all of them.

    value: population covariance over the population deviations of both columns on the rows where both are present, clamped to
    [-1, 1]; NULL where either does not vary there or no row holds both. n: the number of those rows. A pair of a column with
    itself is allowed. Pairs come back in no particular order.
    """
    cols = sorted({c for p in pairs for c in p})
    place = {c: k for k, c in enumerate(cols)}
    sums = pairwise_sums(df, cols)
    wanted = [(a, b, place[a], place[b]) for a, b in pairs]
    spark = df.sparkSession
    asked = spark.createDataFrame(
        [(a, b, min(i, j), max(i, j), i > j) for a, b, i, j in wanted if i != j], "x string, y string, i int, j int, swap boolean")
    both = asked.join(F.broadcast(sums), ["i", "j"], "left")  # the sums: one row per pair of columns, known before the scan
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    sa = F.when(F.col("swap"), F.col("sj")).otherwise(F.col("si"))
    sb = F.when(F.col("swap"), F.col("si")).otherwise(F.col("sj"))
    qa = F.when(F.col("swap"), F.col("sjj")).otherwise(F.col("sii"))
    qb = F.when(F.col("swap"), F.col("sii")).otherwise(F.col("sjj"))
    cov = n * F.col("sij") - sa * sb
    va, vb = n * qa - sa * sa, n * qb - sb * sb
    ratio = F.when((n > 0) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    value = F.when(ratio.isNotNull(), F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0)))
    out = both.select("x", "y", F.lit(method).alias("method"), value.alias("value"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    same = [(a, b) for a, b, i, j in wanted if i == j]
    if same:
        base = df.select(*[clean(F.col(f"`{a}`")).alias(a) for a in sorted({a for a, _ in same})])
        stats = base.agg(*[F.count(a).alias(f"n_{a}") for a, _ in set(same)], *[F.stddev_pop(a).alias(f"s_{a}") for a, _ in set(same)])
        rows = [F.struct(F.lit(a).alias("x"), F.lit(a).alias("y"), F.lit(method).alias("method"),
                         F.when(F.col(f"s_{a}") > 0, F.lit(1.0)).alias("value"), F.col(f"n_{a}").cast("long").alias("n")) for a, _ in same]
        out = out.unionByName(stats.select(F.inline(F.array(*rows))))
    return out
