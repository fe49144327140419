"""Four correlation families over numeric columns, as long tables ``(x, y, method, value, n)``."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.functions.numeric import any_of, band, clean
from plantscope.operators.inversions import inversion_sums
from plantscope.operators.moments import pearson_masked
from plantscope.operators.ranks import column_sizes, with_order_statistics
from plantscope.session import local_table

# Weights of the sign vote and of the strength average.
SIGN_WEIGHTS = {"pearson": 0.5, "spearman": 0.3, "kendall": 0.2}
STRENGTH_WEIGHTS = {"pearson": 0.4, "spearman": 0.2, "kendall": 0.1, "dcor": 0.3}
METHODS = list(STRENGTH_WEIGHTS)
NONLINEAR_AT = 0.3
SEVERITY_CUTS = (0.4, 0.6, 0.8, 0.95)
SEVERITY_LABELS = ("weak", "moderate", "strong", "very_strong", "collinear")


def column_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def pearson_of(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson aggregate, NULL when either side does not vary."""
    both = a.isNotNull() & b.isNotNull()
    left, right = F.when(both, a), F.when(both, b)
    ratio = F.try_divide(F.covar_pop(a, b), F.stddev_pop(left) * F.stddev_pop(right))
    return _clamped(ratio)


def _clamped(ratio: Column) -> Column:
    # greatest and least skip NULL, so a missing coefficient is let through first.
    return F.when(ratio.isNotNull(), F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0)))


def _numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[clean(F.col(f"`{c}`")).alias(c) for c in cols])


def pearson_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Every pair at once; pairwise complete where cells are missing, by masked matrix products in one scan (``moments``)."""
    return pearson_masked(df, pairs)


def _pearson_of(base: DataFrame, pairs, method: str, named) -> DataFrame:
    """Pearson of the complete columns ``named[c]``; the spreads are shared between pairs."""
    cols = sorted({c for p in pairs for c in p})
    place = {c: i for i, c in enumerate(cols)}
    sums = [F.count(F.lit(1)).alias("n"), *[F.stddev_pop(named[c]).alias(f"s{place[c]}") for c in cols]]
    rows = []
    for i, (a, b) in enumerate(pairs):
        sums.append(F.covar_pop(named[a], named[b]).alias(f"c{i}"))
        ratio = F.try_divide(F.col(f"c{i}"), F.col(f"s{place[a]}") * F.col(f"s{place[b]}"))
        rows.append(_row(a, b, method, _clamped(ratio), F.col("n")))
    return base.agg(*sums).select(F.inline(F.array(*rows)))


def _row(a: str, b: str, method: str, value: Column, n: Column) -> Column:
    return F.struct(
        F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(method).alias("method"), value.alias("value"),
        n.cast("long").alias("n"),
    )


def _pair_at_a_time(df, pairs, one):
    """Columns with missing cells are ranked anew for each pair, over the rows where both are present."""
    parts = [one(df.select(*dict.fromkeys(p)).na.drop(), [p]) for p in pairs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _spearman_of(ranked: DataFrame, pairs) -> DataFrame:
    cols = {c for p in pairs for c in p}
    return _pearson_of(ranked, pairs, "spearman", {c: f"{c}_rank" for c in cols})


def _tied(base: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Pairs of rows tied in each column, all columns in one pass."""
    tagged = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    counts = base.select(F.inline(tagged)).groupBy("column", "value").agg(F.count(F.lit(1)).cast("double").alias("t"))
    rows = counts.groupBy("column").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("tied")).collect()
    return {r["column"]: r["tied"] for r in rows}


def rank_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], methods: Sequence[str], **limits) -> DataFrame:
    """Spearman, Kendall's tau-b and distance correlation, sharing cells and ladders."""
    cols = sorted({c for p in pairs for c in p})
    base = _numbers(df, cols)
    sizes = column_sizes(base, cols)
    if sizes.missing:
        return _pair_at_a_time(base, pairs, lambda d, p: rank_pairs(d, p, methods, **limits))
    spark = base.sparkSession
    cell_limits = {k: v for k, v in limits.items() if k == "cells_per_bucket"}
    rank_limits = {k: v for k, v in limits.items() if k != "cells_per_bucket"}
    n = sizes.n
    parts = []
    inverted = {}
    if {"kendall", "dcor"} & set(methods):
        sums = inversion_sums(base, pairs, sizes, **cell_limits)
        inverted = {r["pair"]: r for r in sums.collect()}  # one row per pair
    if "kendall" in methods:
        tied = _tied(base, cols)
        total = n * (n - 1) / 2
        rows = []
        for i, (a, b) in enumerate(pairs):
            value = None
            if n >= 2 and tied[a] < total and tied[b] < total:
                found = inverted[i]
                score = total - tied[a] - tied[b] + found["tied"] - 2 * found["weight"]
                value = score / (total - tied[a]) ** 0.5 / (total - tied[b]) ** 0.5
                value = min(1.0, max(-1.0, value))
            rows.append((a, b, "kendall", value, n))
        parts.append(local_table(spark, rows, "x string, y string, method string, value double, n long"))
    if {"dcor", "spearman"} & set(methods):
        ranked = with_order_statistics(base, cols, sizes, **rank_limits)
        if "dcor" in methods:
            parts.append(_distance_correlation(ranked, pairs, inverted, n))
        if "spearman" in methods:
            parts.append(_spearman_of(ranked, pairs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _distance_correlation(ranked, pairs, inverted, n) -> DataFrame:
    """Biased distance correlation from closed forms.

    With row sums A and B of the two distance matrices and S the sum of products
    of distances, the squared covariance is S/n^2 - 2 sum(A B)/n^3 + sum(A) sum(B)/n^4.
    """
    spark = ranked.sparkSession
    cols = sorted({c for p in pairs for c in p})
    sums = [F.sum(F.col(f"{c}_spread")).alias(f"t_{i}") for i, c in enumerate(cols)]
    sums += [F.sum(F.col(f"{c}_spread") * F.col(f"{c}_spread")).alias(f"q_{i}") for i, c in enumerate(cols)]
    sums += [F.var_pop(F.col(c)).alias(f"v_{i}") for i, c in enumerate(cols)]
    for i, (a, b) in enumerate(pairs):
        sums += [
            F.sum(F.col(f"{a}_spread") * F.col(f"{b}_spread")).alias(f"ab_{i}"),
            F.covar_pop(F.col(a), F.col(b)).alias(f"c_{i}"),
        ]
    got = ranked.agg(*sums).first()
    place = {c: i for i, c in enumerate(cols)}

    def own(c: str) -> float:
        i = place[c]
        # Sum of squared distances is 2 n^2 times the variance.
        return 2 * got[f"v_{i}"] - 2 * got[f"q_{i}"] / n**3 + got[f"t_{i}"] ** 2 / n**4

    rows = []
    for i, (a, b) in enumerate(pairs):
        value = None
        if n >= 3:
            # All pairs give n^2 cov; inverted ones enter with the other sign.
            products = 2 * (n * n * got[f"c_{i}"] - 2 * inverted[i]["cross"])
            ta, tb = got[f"t_{place[a]}"], got[f"t_{place[b]}"]
            shared = products / n**2 - 2 * got[f"ab_{i}"] / n**3 + ta * tb / n**4
            va, vb = own(a), own(b)
            floor = 1e-13
            if va <= floor * 2 * got[f"v_{place[a]}"] or vb <= floor * 2 * got[f"v_{place[b]}"]:
                value = 0.0
            else:
                value = min(1.0, max(shared, 0.0) ** 0.5 / (va * vb) ** 0.25)
        rows.append((a, b, "dcor", value, n))
    return local_table(spark, rows, "x string, y string, method string, value double, n long")


def association_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str]], methods: Sequence[str] = METHODS, **limits
) -> DataFrame:
    """The chosen methods for the chosen pairs in one long table."""
    others = [m for m in methods if m != "pearson"]
    if not others:
        return pearson_pairs(df, pairs)
    out = rank_pairs(df, pairs, others, **limits)
    return pearson_pairs(df, pairs).unionByName(out) if "pearson" in methods else out


def mirrored(pairs: DataFrame) -> DataFrame:
    """Full square from the half above the diagonal, diagonal included."""
    flipped = pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "method", "value", "n")
    both = pairs.unionByName(flipped)
    diagonal = both.groupBy("x", "method").agg(F.max("n").alias("n")).select(
        "x", F.col("x").alias("y"), "method", F.lit(1.0).alias("value"), "n"
    )
    return both.unionByName(diagonal)


def target_association(long: DataFrame, y: str) -> DataFrame:
    """One row per variable with its coefficients against ``y``."""
    near = long.where((F.col("x") == y) | (F.col("y") == y)).select(
        F.when(F.col("x") == y, F.col("y")).otherwise(F.col("x")).alias("variable"), "method", "value"
    )
    return near.groupBy("variable").pivot("method", METHODS).agg(F.first("value"))


def consensus(table: DataFrame) -> DataFrame:
    """Adds the signed agreement of the four coefficients (``consensus``, -1 to 1)."""
    known = [F.col(m).isNotNull() for m in SIGN_WEIGHTS]
    vote = sum((F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in SIGN_WEIGHTS.items()), F.lit(0.0))
    sign = F.when(~any_of(known), 0).when(vote > 0, 1).otherwise(-1)
    strength = sum((F.abs(F.coalesce(F.col(m), F.lit(0.0))) * w for m, w in STRENGTH_WEIGHTS.items()), F.lit(0.0))
    return table.select("*", sign.alias("sign"), strength.alias("strength"), (sign * strength).alias("consensus"))


def compare_with_regression(table: DataFrame, terms: DataFrame) -> DataFrame:
    """Verdict per variable: contribution percent of the regression against association strength percent.

    ``table`` has ``variable, consensus``; ``terms`` has ``term, ratio``. A variable without a term counts as 0.
    """
    joined = table.join(terms.select(F.col("term").alias("variable"), "ratio"), "variable", "left")
    ratio = F.coalesce(F.col("ratio"), F.lit(0.0))
    contribution, strength = F.abs(ratio), F.abs(F.col("consensus") * 100)
    verdict = (
        F.when((contribution <= 2) | (strength <= 2), "unclear")
        .when((F.signum(ratio) != F.signum("consensus")) & (F.col("consensus") != 0), "direction_conflict")
        .when(((contribution <= 5) & (strength > 10)) | ((strength <= 5) & (contribution > 10)), "strength_conflict")
        .otherwise("agree")
    )
    return joined.withColumn("ratio", ratio).withColumn("verdict", verdict)


def association_notes(compared: DataFrame) -> DataFrame:
    """Reason codes behind each verdict."""
    contribution, strength = F.abs("ratio"), F.abs(F.col("consensus") * 100)
    unclear = F.col("verdict") == "unclear"
    clash = F.col("verdict") == "strength_conflict"
    codes = [
        F.when(F.col("dcor") >= NONLINEAR_AT, "maybe_nonlinear"),
        F.when(unclear & (contribution <= 2) & (strength <= 2), "both_weak"),
        F.when(unclear & (contribution <= 2) & (strength > 2), "contribution_weak"),
        F.when(unclear & (contribution > 2), "association_weak"),
        F.when(clash & (contribution > strength), "contribution_larger"),
        F.when(clash & (contribution <= strength), "association_larger"),
        F.when(F.col("verdict") == "direction_conflict", "directions_differ"),
    ]
    return compared.withColumn("notes", F.array_compact(F.array(*codes)))


def strong_pairs(long: DataFrame, at_least: float = 0.4, strong_from: float = 0.7) -> DataFrame:
    """Pairs whose absolute coefficient reaches the limit, with direction and band."""
    size = F.abs("value")
    return long.where(size >= at_least).select(
        "x", "y", "value",
        F.when(F.col("value") > 0, "positive").otherwise("negative").alias("direction"),
        F.when(size >= strong_from, "strong").otherwise("moderate").alias("band"),
    )


def strong_pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("direction", "band").agg(F.count(F.lit(1)).alias("n_pairs"))


def pair_severity(long: DataFrame, cuts: Sequence[float] = SEVERITY_CUTS) -> DataFrame:
    """Band of every pair by its absolute coefficient."""
    return long.select("x", "y", "value", band(F.abs("value"), cuts, SEVERITY_LABELS).alias("severity"))


def low_correlation_candidates(table: DataFrame, below: float = 0.4, dcor_from: float = NONLINEAR_AT) -> DataFrame:
    """Variables with a weak straight-line tie to the target; flagged when distance correlation still sees one."""
    weak = F.abs("pearson") < below
    return table.where(weak).select(
        "variable", "pearson", "dcor", F.coalesce(F.col("dcor") >= dcor_from, F.lit(False)).alias("maybe_nonlinear")
    )


def slope_table(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    """Least-squares slope of the target on each variable alone, one scan."""
    base = _numbers(df, [y, *x])
    target = F.col(y)
    sums = [F.regr_slope(target, F.col(c)).alias(f"b{i}") for i, c in enumerate(x)]
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"b{i}").alias("slope")) for i, c in enumerate(x)]
    return base.agg(*sums).select(F.inline(F.array(*rows)))
