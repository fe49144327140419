"""Shape of each numeric column and each categorical column.

The rows are scanned a fixed number of times for all columns together: moments,
exact quantiles, shares between thresholds, histograms, and rows near peaks.
What comes out is one row per column; every judgement below is a column
expression on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantscope.functions.numeric import band, bin_between, bin_range, clean
from plantscope.operators.quantiles import exact_quantiles
from plantscope.session import local_table

PROBS = (0.05, 0.1, 0.2, 0.25, 0.3, 0.5, 0.7, 0.75, 0.8, 0.9, 0.95)
SHAPE_BINS, EXTREME_BINS = 30, 50
KERNEL_RADIUS = 4

# Limits of the judgements.
PEAK_HEIGHT, PEAK_MIN_COUNT, PEAK_PROMINENCE = 0.25, 3, 0.05
PEAK_GAP, PEAK_WINDOW, PEAK_SHARE, VALLEY_DEPTH = 0.05, 0.1, 0.05, 0.3
SKEW_CUTS = (0.3, 0.7, 1.0, 1.5)
SKEW_LABELS = ("roughly_symmetric", "slightly_skewed", "skewed", "strongly_skewed", "very_strongly_skewed")
KURTOSIS_CUTS = (-0.5, 0.5, 2)
KURTOSIS_LABELS = ("very_flat", "normal", "peaked", "very_peaked")
OUTLIER_CUTS = (2, 5, 10, 20)
OUTLIER_LABELS = ("almost_none", "very_few", "few", "some", "many")
RANGE_CUTS = (0.05, 0.1, 0.2, 0.5)
RANGE_LABELS = ("very_narrow", "narrow", "medium", "wide", "very_wide")
SPREAD_CUTS = (0.1, 0.3, 0.5)
SPREAD_LABELS = ("very_tight", "even", "moderate", "wide")
SYMMETRY_CUTS = (2, 5, 10)
SYMMETRY_LABELS = ("almost_perfect", "mostly", "slightly_off", "clearly_off")
GRADE_CUTS = (60, 70, 80, 90)
GRADE_LABELS = ("difficult", "needs_much_preparation", "some_preparation", "suitable", "very_suitable")
HINT_LABELS = ("normalize_log_sqrt_outliers", "normalize_log_sqrt", "normalize", "none", "none")


def quantile_name(p: float) -> str:
    return f"q{round(p * 100):02d}"


def describe_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, mean, sample sd, min, max, bias-corrected skewness and excess kurtosis; one scan."""
    sums, rows = [], []
    for i, c in enumerate(cols):
        v = clean(F.col(f"`{c}`"))
        for name, agg in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max),
                          ("g1", F.skewness), ("g2", F.kurtosis)):
            sums.append(agg(v).alias(f"{name}{i}"))
        n, g1, g2 = F.col(f"n{i}"), F.col(f"g1{i}"), F.col(f"g2{i}")
        skew = F.when(n > 2, F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2) * g1)
        kurt = F.when(n > 3, (n - 1.0) / F.when(n > 3, (n - 2.0) * (n - 3)) * ((n + 1) * g2 + 6))
        rows.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column"), n.alias("n"),
                *[F.col(f"{k}{i}").alias(k) for k in ("mean", "sd", "min", "max")],
                skew.alias("skew"), kurt.alias("kurtosis"),
            )
        )
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = PROBS) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per column and probability."""
    found = exact_quantiles(df, cols, probs)
    rows = [(c, float(p), found[c][p]) for c in cols for p in probs]
    return local_table(df.sparkSession, rows, "column string, prob double, value double")


def summary_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments with quartiles, one row per column."""
    known = [r for r in describe_moments(df, cols).collect() if r["n"]]  # one row per column
    extent = {r["column"]: (r["n"], r["min"], r["max"]) for r in known}
    quartiles = exact_quantiles(df, list(extent), (0.25, 0.5, 0.75), extent=extent) if extent else {}
    rows = [
        (r["column"], r["n"], r["mean"], r["sd"], r["min"], *(quartiles[r["column"]][p] for p in (0.25, 0.5, 0.75)),
         r["max"], r["skew"], r["kurtosis"])
        for r in known
    ]
    return local_table(df.sparkSession, rows, "column string, n long, mean double, sd double, min double, q1 double, median double, q3 double,"
        "max double, skew double, kurtosis double"
    )


def _extents(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    aggs = []
    for i, c in enumerate(cols):
        v = clean(F.col(f"`{c}`"))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols) if row[f"n{i}"]}


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (position, v), one per filled cell; limits are looked up by position afterwards.

    Looking them up keeps the generated code the size of one column's, however many there are.
    """
    marks = [F.struct(F.lit(i).alias("position"), clean(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(cols)]
    return df.select(F.inline(F.array(*marks))).where(F.col("v").isNotNull())


def _by_position(values: Sequence[float]) -> Column:
    return F.get(F.lit([float(x) for x in values]), F.col("position"))


def _bin_of(extent: dict[str, tuple[int, float, float]], bins: int) -> Column:
    ranges = [bin_range(low, high) for _, low, high in extent.values()]
    return bin_between(F.col("v"), _by_position([a for a, _ in ranges]), _by_position([b for _, b in ranges]), bins)


def _bin_counts(df: DataFrame, extent: dict[str, tuple[int, float, float]], bins: int) -> DataFrame:
    """Rows (column, bin, count); partial aggregation leaves at most all bins per task."""
    names = F.lit(list(extent))
    return (
        _long(df, list(extent))
        .groupBy("position", _bin_of(extent, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.get(names, F.col("position")).alias("column"), "bin", "count")
    )


def histogram(df: DataFrame, cols: Sequence[str], bins: int = SHAPE_BINS) -> DataFrame:
    """Equal-width histogram with counts and percent; empty bins included."""
    extent = _extents(df, cols)
    spark = df.sparkSession
    frame = local_table(spark, [
            (c, k, low + k * (high - low) / bins, n)
            for c, (n, a, b) in extent.items()
            for low, high in [(a, b) if a < b else (a - 0.5, b + 0.5)]
            for k in range(bins)
        ],
        "column string, bin int, low double, total long",
    )
    counts = _bin_counts(df, extent, bins)
    return frame.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "low",
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) * 100.0 / F.col("total")).alias("pct"),
    )


def shape_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per non-empty column with everything the shape judgements read."""
    spark = df.sparkSession
    base = df.select(*[clean(F.col(f"`{c}`")).alias(c) for c in cols])
    moments = {r["column"]: r.asDict() for r in describe_moments(base, cols).collect() if r["n"]}
    extent = {c: (m["n"], m["min"], m["max"]) for c, m in moments.items()}
    if not extent:
        raise ValueError("no column has a value")
    quantiles = exact_quantiles(base, list(extent), PROBS, extent=extent)
    counts, shares = _counts_and_shares(base, extent, quantiles)
    names = ["column", "n", "mean", "sd", "min", "max", "skew", "kurtosis"]
    names += [quantile_name(p) for p in PROBS] + list(SHARE_NAMES) + ["counts30", "counts50"]
    rows = [
        (
            *[moments[c][k] for k in names[:8]],
            *[quantiles[c][p] for p in PROBS],
            *[shares[c][k] for k in SHARE_NAMES],
            counts[c][SHAPE_BINS],
            counts[c][EXTREME_BINS],
        )
        for c in extent
    ]
    kinds = {"column": "string", "n": "long", "counts30": "array<long>", "counts50": "array<long>"}
    schema = ", ".join(f"`{k}` {kinds.get(k, 'double')}" for k in names)
    return local_table(spark, rows, schema)


SHARE_NAMES = (
    "le20", "ge80", "le25", "ge75", "mid", "zero5", "ge70", "le30", "zero10", "ge90", "in2575", "in1090", "in0595",
    "out15", "out3", "mean_above_zero5", "mean_le20", "mean_gt20", "mean_ge80", "mean_lt80",
)


def _counts_and_shares(base: DataFrame, extent: dict, quantiles: dict) -> tuple[dict, dict]:
    """Bin counts and shares of every column from one scan.

    The thresholds of a column cut its range into zones (each threshold a zone
    of its own). Rows are counted by zone and bin together, a hundred or so
    groups per column, and every share is a sum over zones.
    """
    limits: dict[str, dict[str, float]] = {}
    zones: dict[str, list[float]] = {}
    for c, q in quantiles.items():
        _, low, high = extent[c]
        iqr = q[0.75] - q[0.25]
        limits[c] = {quantile_name(p): q[p] for p in PROBS}
        limits[c] |= {"z5": (high - low) * 0.05, "z10": (high - low) * 0.1, "lo15": q[0.25] - 1.5 * iqr,
                      "hi15": q[0.75] + 1.5 * iqr, "lo3": q[0.25] - 3 * iqr, "hi3": q[0.75] + 3 * iqr}
        zones[c] = sorted(set(limits[c].values()))
    v, zone = F.col("v"), F.lit(0)
    for k in range(max(len(z) for z in zones.values())):
        cut = _by_position([z[k] if k < len(z) else float("inf") for z in zones.values()])
        zone = zone + (v > cut).cast("int") + (v >= cut).cast("int")
    rows = (
        _long(base, list(quantiles))
        .groupBy(
            "position", zone.alias("zone"), _bin_of(extent, SHAPE_BINS).alias("b30"), _bin_of(extent, EXTREME_BINS).alias("b50")
        )
        .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
        .collect()  # zones and bins cut the same line: at most their number together, per column
    )
    counts, shares = {}, {}
    for i, c in enumerate(quantiles):
        mine = [r for r in rows if r["position"] == i]
        bins = {SHAPE_BINS: [0] * SHAPE_BINS, EXTREME_BINS: [0] * EXTREME_BINS}
        for r in mine:
            bins[SHAPE_BINS][r["b30"]] += r["n"]
            bins[EXTREME_BINS][r["b50"]] += r["n"]
        counts[c] = bins
        shares[c] = _shares({k: 2 * zones[c].index(t) + 1 for k, t in limits[c].items()}, mine, extent[c][0])
    return counts, shares


def _shares(at: dict[str, int], rows: Sequence, n: int) -> dict[str, float | None]:
    """Shares and part means from zone totals; ``at`` is the zone of each threshold."""

    def inside(low: str, high: str):
        return lambda z: at[low] <= z <= at[high]

    tests = {
        "le20": lambda z: z <= at["q20"], "ge80": lambda z: z >= at["q80"], "le25": lambda z: z <= at["q25"],
        "ge75": lambda z: z >= at["q75"], "mid": lambda z: at["q25"] < z < at["q75"], "zero5": lambda z: z <= at["z5"],
        "ge70": lambda z: z >= at["q70"], "le30": lambda z: z <= at["q30"], "zero10": lambda z: z <= at["z10"],
        "ge90": lambda z: z >= at["q90"], "in2575": inside("q25", "q75"), "in1090": inside("q10", "q90"),
        "in0595": inside("q05", "q95"), "out15": lambda z: not inside("lo15", "hi15")(z),
        "out3": lambda z: not inside("lo3", "hi3")(z),
    }
    parts = {
        "mean_above_zero5": lambda z: z > at["z5"], "mean_le20": lambda z: z <= at["q20"], "mean_gt20": lambda z: z > at["q20"],
        "mean_ge80": lambda z: z >= at["q80"], "mean_lt80": lambda z: z < at["q80"],
    }
    out: dict[str, float | None] = {k: sum(r["n"] for r in rows if t(r["zone"])) / n for k, t in tests.items()}
    for k, t in parts.items():
        held = [r for r in rows if t(r["zone"])]
        out[k] = sum(r["s"] for r in held) / sum(r["n"] for r in held) if held else None
    return out


# --- peaks: expressions on the 30-bin counts -------------------------------------------------


def smoothed(counts: Column, bins: int = SHAPE_BINS) -> Column:
    """Gaussian smoothing with sigma 1 and mirrored edges."""
    from math import exp

    raw = [exp(-(k**2) / 2) for k in range(-KERNEL_RADIUS, KERNEL_RADIUS + 1)]
    total = sum(raw)
    kernel = [w / total for w in raw]

    def at(i: Column) -> Column:
        parts = []
        for k, w in zip(range(-KERNEL_RADIUS, KERNEL_RADIUS + 1), kernel):
            j = i + k
            j = F.when(j < 0, -j - 1).when(j >= bins, F.lit(2 * bins - 1) - j).otherwise(j)
            parts.append(F.lit(w) * F.element_at(counts, (j + 1).cast("int")))
        out = parts[0]
        for part in parts[1:]:
            out = out + part
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), at)


def step_of(table_min: Column, table_max: Column, bins: int) -> Column:
    span = table_max - table_min
    return F.when(span == 0, 1.0 / bins).otherwise(span / bins)


def with_peaks(shape: DataFrame) -> DataFrame:
    """Adds ``smooth``, ``peaks`` (bin numbers), ``thinned``; a peak lies at the left edge of its bin."""
    top = F.array_max("counts30")
    floor = F.greatest(top * PEAK_HEIGHT, F.lit(float(PEAK_MIN_COUNT)))

    def value(i: Column, shift: int) -> Column:
        return F.element_at(F.col("smooth"), i + 1 + shift)

    def is_peak(i: Column) -> Column:
        here, left, right = value(i, 0), value(i, -1), value(i, 1)
        return (here > left) & (here > right) & (here >= floor) & (here - F.least(left, right) >= top * PEAK_PROMINENCE)

    low = F.when(F.col("min") == F.col("max"), F.col("min") - 0.5).otherwise(F.col("min"))
    step = step_of(F.col("min"), F.col("max"), SHAPE_BINS)

    def keep(done: Column, i: Column) -> Column:
        gap = (i - F.element_at(done, -1)) * F.col("step")
        far = (F.size(done) == 0) | (gap >= (F.col("max") - F.col("min")) * PEAK_GAP)
        return F.when(far, F.concat(done, F.array(i))).otherwise(done)

    return (
        shape.withColumn("smooth", smoothed(F.col("counts30")))
        .withColumn("low", low)
        .withColumn("step", step)
        .withColumn("peaks", F.filter(F.sequence(F.lit(1), F.lit(SHAPE_BINS - 2)), is_peak))
        .withColumn("thinned", F.aggregate(F.col("peaks"), F.array().cast("array<int>"), _guarded(keep)))
    )


def _guarded(keep):
    # element_at(-1) on an empty array raises, so the first peak is taken without looking back.
    def merge(done: Column, i: Column) -> Column:
        return F.when(F.size(done) == 0, F.array(i)).otherwise(keep(done, i))

    return merge


def valley(counts: Column, places: Column) -> Column:
    """Lowest count from the first to the second peak, over the higher of the two; NULL with fewer peaks."""
    first, second = F.element_at(places, 1), F.element_at(places, 2)
    between = F.slice(counts, first + 1, second - first + 1)
    higher = F.greatest(F.element_at(counts, first + 1), F.element_at(counts, second + 1))
    return F.when(F.size(places) >= 2, F.try_divide(F.array_min(between).cast("double"), higher.cast("double")))


def validated_peaks(df: DataFrame, peaked: DataFrame) -> DataFrame:
    """Adds ``near`` (share of rows around each thinned peak), ``validated`` and ``bimodal_score``.

    Peaks with too few rows nearby go, unless fewer than two would be left.
    """
    rows = peaked.select("column", "n", "min", "max", "low", "step", "thinned").collect()  # one row per column
    aggs = []
    for i, r in enumerate(rows):
        window = (r["max"] - r["min"]) * PEAK_WINDOW
        for j, place in enumerate(r["thinned"]):
            at = r["low"] + place * r["step"]
            v = clean(F.col(f"`{r['column']}`"))
            aggs.append(F.count_if((v >= F.lit(at - window)) & (v <= F.lit(at + window))).alias(f"k{i}_{j}"))
    counted = df.agg(*aggs).first() if aggs else None
    near = [
        (r["column"], [counted[f"k{i}_{j}"] / r["n"] for j in range(len(r["thinned"]))]) for i, r in enumerate(rows)
    ]
    shares = local_table(df.sparkSession, near, "column string, near array<double>")
    kept = F.filter(F.arrays_zip("thinned", "near"), lambda z: z["near"] >= PEAK_SHARE)
    out = peaked.join(F.broadcast(shares), "column").withColumn("_kept", F.transform(kept, lambda z: z["thinned"]))
    out = out.withColumn(
        "validated",
        F.when((F.size("thinned") >= 2) & (F.size("_kept") >= 2), F.col("_kept")).otherwise(F.col("thinned")),
    ).drop("_kept")
    deep = valley(F.col("counts30"), F.col("validated")) < VALLEY_DEPTH
    return out.withColumn("bimodal_score", F.coalesce(deep, F.lit(False)).cast("int"))


def peak_positions(peaked: DataFrame, places: str) -> DataFrame:
    return peaked.select(
        "column", F.posexplode(F.col(places)).alias("peak", "bin"), "low", "step"
    ).select("column", "peak", "bin", (F.col("low") + F.col("bin") * F.col("step")).alias("position"))


# --- judgements --------------------------------------------------------------------------------


def with_modality(peaked: DataFrame) -> DataFrame:
    ratio = valley(F.col("counts30"), F.col("thinned"))
    deep = F.coalesce(ratio < VALLEY_DEPTH, F.lit(False))
    return (
        peaked.withColumn("valley_ratio", ratio)
        .withColumn("bimodal", deep & (F.size("thinned") == 2))
        .withColumn("multimodal", deep & (F.size("thinned") > 2))
    )


def with_flags(shape: DataFrame) -> DataFrame:
    """Adds ``concentrated`` (half the rows at one end) and ``skew_extreme``."""
    ends = (F.col("le20") >= 0.5) | (F.col("ge80") >= 0.5) | (F.col("zero5") >= 0.5)
    tail = F.when(F.col("skew") > 1.5, F.col("ge70") >= 0.4).when(F.col("skew") < -1.5, F.col("le30") >= 0.4)
    return shape.withColumn("concentrated", ends).withColumn("skew_extreme", F.coalesce(tail, F.lit(False)))


def mean_median_gap(signed: bool = False) -> Column:
    """Distance of mean and median in percent of the mean; 0 when the mean is 0."""
    mean = F.col("mean") if signed else F.abs("mean")
    return F.coalesce(F.try_divide(F.abs(F.col("mean") - F.col("q50")), mean) * 100, F.lit(0.0))


def variation(signed: bool = False) -> Column:
    """Coefficient of variation; 0 when the mean is 0."""
    mean = F.col("mean") if signed else F.abs("mean")
    return F.coalesce(F.try_divide("sd", mean), F.lit(0.0))


def with_shape_class(modal: DataFrame, signed: bool = False) -> DataFrame:
    """Adds ``shape``: normal-like, then two or more peaks, then an extreme end, then bands of skewness."""
    size = F.abs("skew")
    extreme = (F.col("le25") >= 0.5) | (F.col("ge75") >= 0.5) | (F.col("zero5") >= 0.5) | (F.col("mid") < 0.3)
    normal = (size < 0.3) & (F.abs("kurtosis") < 0.5) & (mean_median_gap(signed) < 5)
    normal = F.coalesce(normal & ~F.col("bimodal") & ~F.col("multimodal") & ~extreme, F.lit(False))
    shape = (
        F.when(normal, F.when(size < 0.1, "near_normal").otherwise("normal_like"))
        .when(F.col("bimodal"), "bimodal")
        .when(F.col("multimodal"), "multimodal")
        .when(
            extreme,
            F.when(F.col("zero5") >= 0.5, "zero_concentrated")
            .when(F.col("le25") >= 0.5, "low_concentrated")
            .when(F.col("ge75") >= 0.5, "high_concentrated")
            .otherwise("two_ended"),
        )
        .otherwise(band(size, SKEW_CUTS, SKEW_LABELS))
    )
    return modal.withColumn("shape", shape).withColumn("extreme_ends", extreme)


def skew_direction() -> Column:
    low, high = F.col("le25"), F.col("ge75")
    ends = F.when(low > high * 1.5, "toward_low").when(high > low * 1.5, "toward_high").otherwise("both_ends")
    return (
        F.when(F.col("mid") < 0.3, ends)
        .when(F.col("skew") > 0.1, "right_tail")
        .when(F.col("skew") < -0.1, "left_tail")
        .otherwise("symmetric")
    )


def kurtosis_band() -> Column:
    return band(F.col("kurtosis"), KURTOSIS_CUTS, KURTOSIS_LABELS)


def concentration_band() -> Column:
    return band(F.col("in2575") * 100, (50, 60, 70), ("spread", "medium", "concentrated", "very_concentrated"), True)


def outlier_band() -> Column:
    return band(F.col("out15") * 100, OUTLIER_CUTS, OUTLIER_LABELS)


def extreme_check(shape: DataFrame) -> DataFrame:
    """Adds ``extreme`` (struct: is_extreme, max_ratio, second_ratio, valley_ratio) from 50 bins and shares."""
    counts = F.col("counts50")
    top = F.array_max(counts)
    floor = F.greatest(top * 0.15, F.lit(2.0))

    def at(i: Column, shift: int = 0) -> Column:
        return F.element_at(counts, i + 1 + shift)

    peaks = F.filter(
        F.sequence(F.lit(1), F.lit(EXTREME_BINS - 2)),
        lambda i: (at(i) > at(i, -1)) & (at(i) > at(i, 1)) & (at(i) >= floor),
    )
    # Highest first; equal heights keep their order.
    ranked = F.array_sort(F.transform(peaks, lambda i: F.struct((-at(i)).alias("h"), i.alias("i"))))
    staged = shape.withColumn("_ranked", ranked)
    two = F.size("_ranked") >= 2
    first, second = F.col("_ranked")[0]["i"], F.col("_ranked")[1]["i"]
    left, right = F.least(first, second), F.greatest(first, second)
    high = F.when(two, F.element_at(counts, first + 1) / F.col("n"))
    other = F.when(two, F.element_at(counts, second + 1) / F.col("n"))
    dip = F.when(two, F.array_min(F.slice(counts, left + 1, right - left + 1)) / F.col("n"))
    end = F.greatest("zero10", "ge90")

    def verdict(flag, most, rest, low) -> Column:
        return F.struct(
            flag.alias("is_extreme"), most.cast("double").alias("max_ratio"), rest.cast("double").alias("second_ratio"),
            low.cast("double").alias("valley_ratio"),
        )

    zero = F.lit(0.0)
    plain = (
        F.when(end >= 0.5, verdict(F.lit(True), end, 1 - end, F.lit(0.1)))
        .when(two, verdict((high >= 0.5) & (other >= 0.15) & (dip < F.least(high, other) * 0.4), high, other, dip))
        .otherwise(verdict(F.lit(False), zero, zero, zero))
    )
    tail = F.when(F.col("skew") > 2, F.col("ge75")).when(F.col("skew") < -2, F.col("le25"))
    skewed = F.when(tail >= 0.4, verdict(F.lit(True), tail, 1 - tail, F.lit(0.1)))
    return staged.withColumn("extreme", F.coalesce(skewed, plain)).drop("_ranked")


def group_representatives(flagged: DataFrame) -> DataFrame:
    """Representative values of the groups inside a column: ``column, rule, group, value``."""
    odd = F.col("concentrated") | F.col("skew_extreme")
    count = F.size("validated")
    by_peaks = (count >= 3) | ((count == 2) & ((F.col("bimodal_score") == 1) | odd)) | ((count >= 2) & odd)
    positions = F.transform("validated", lambda i: F.col("low") + i * F.col("step"))
    rule = (
        F.when(by_peaks, "peaks")
        .when(odd & (F.col("zero5") >= 0.5), "zero_and_rest")
        .when(odd & (F.col("le20") >= 0.5), "low_end_and_rest")
        .when(odd & (F.col("ge80") >= 0.5), "high_end_and_rest")
    )
    values = (
        F.when(F.col("rule") == "peaks", positions)
        .when(F.col("rule") == "zero_and_rest", F.array_compact(F.array(F.lit(0.0), F.col("mean_above_zero5"))))
        .when(F.col("rule") == "low_end_and_rest", F.array_compact(F.array(F.col("mean_le20"), F.col("mean_gt20"))))
        .when(F.col("rule") == "high_end_and_rest", F.array_compact(F.array(F.col("mean_lt80"), F.col("mean_ge80"))))
    )
    return (
        flagged.withColumn("rule", rule)
        .where(F.col("rule").isNotNull())
        .select("column", "rule", F.posexplode(values).alias("group", "value"))
    )


#: Half-width of a peak's group, as a share of the column's range.
GROUP_WIDTH = 0.1
#: Representatives that the window counts may ask for at most: a few per column, known before the scan.
MOST_GROUPS = 100_000


def group_counts(df: DataFrame, flagged: DataFrame, width: float = GROUP_WIDTH) -> DataFrame:
    """Rows around every peak of the columns whose groups are told by peaks: ``column, group, value, low, high, n_rows, share``.

    A group holds the non-NULL values within ``width`` times the column's range (max - min) of its peak, both ends included; groups
    of one column may overlap. ``share`` is ``n_rows`` over the column's non-NULL count. Columns whose groups come from another
    rule, or have none, give no rows. The peaks are few per column (at most the histogram's bins) and are read first, their number
    checked; then all windows are counted in one aggregate over ``df``.
    """
    reps = group_representatives(flagged).where(F.col("rule") == "peaks").join(
        flagged.select("column", "n", "min", "max"), "column")
    spread = (F.col("max") - F.col("min")) * F.lit(width)
    windows = reps.select("column", "group", "value", (F.col("value") - spread).alias("low"), (F.col("value") + spread).alias("high"), "n")
    if windows.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} peak groups")
    found = windows.collect()
    spark = df.sparkSession
    if not found:
        return spark.createDataFrame([], "column string, group int, value double, low double, high double, n_rows long, share double")
    counts = df.agg(*[
        F.count_if(clean(F.col(f"`{w['column']}`")).between(F.lit(w["low"]), F.lit(w["high"]))).alias(f"g{k}") for k, w in enumerate(found)
    ])
    rows = [F.struct(F.lit(w["column"]).alias("column"), F.lit(w["group"]).cast("int").alias("group"), F.lit(w["value"]).alias("value"),
                     F.lit(w["low"]).alias("low"), F.lit(w["high"]).alias("high"), F.col(f"g{k}").cast("long").alias("n_rows"),
                     (F.col(f"g{k}") / F.lit(float(w["n"]))).alias("share")) for k, w in enumerate(found)]
    return counts.select(F.inline(F.array(*rows)))


def suitability(checked: DataFrame, signed: bool = False) -> DataFrame:
    """Adds ``penalties`` (array of code and points), ``score`` and ``grade``."""
    size, out, cv = F.abs("skew"), F.col("out15") * 100, variation(signed)

    def fine(code: str, points: int) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"))

    penalties = F.array_compact(
        F.array(
            F.when(size > 1.5, fine("skew_strong", 15)).when(size > 0.8, fine("skew_some", 10)),
            F.when(out > 30, fine("outliers_very_many", 20))
            .when(out > 15, fine("outliers_many", 15))
            .when(out > 8, fine("outliers_some", 5)),
            F.when(cv < 0.02, fine("variation_too_small", 15))
            .when(cv < 0.05, fine("variation_small", 10))
            .when(cv > 3, fine("variation_too_large", 15)),
            F.when(F.col("extreme")["is_extreme"], fine("extreme_split", 25)),
        )
    )
    lost = F.aggregate(F.col("penalties"), F.lit(0), lambda total, p: total + p["points"])
    return (
        checked.withColumn("penalties", penalties)
        .withColumn("score", F.lit(100) - lost)
        .withColumn("grade", band(F.col("score"), GRADE_CUTS, GRADE_LABELS))
    )


def improvement_plan(scored: DataFrame) -> DataFrame:
    """One row per penalty: what to do, points to win, and the transform hint of the column's grade."""
    action = (
        F.when(F.col("p.code").startswith("skew"), "normalize_distribution")
        .when(F.col("p.code").startswith("outliers"), "treat_outliers")
        .when(F.col("p.code").startswith("variation"), "rescale")
        .otherwise("analyze_groups")
    )
    return scored.select(
        "column", F.explode("penalties").alias("p"), band(F.col("score"), GRADE_CUTS, HINT_LABELS).alias("hint")
    ).select("column", F.col("p.code").alias("code"), action.alias("action"), F.col("p.points").alias("points"), "hint")


# --- categorical columns ------------------------------------------------------------------------


def category_frequency(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count and percent of each value of each column, NULL left out.

    Totals come from their own aggregate, so no task sees all values of a column.
    """
    totals = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    marks = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"),
                     F.lit(totals[f"n{i}"]).alias("total"))
            for i, c in enumerate(cols)
        ]
    )
    return (
        df.select(F.inline(marks))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value", "total")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("column", "value", "count", (F.col("count") * 100.0 / F.col("total")).alias("pct"))
    )


def category_concentration(frequency: DataFrame) -> DataFrame:
    """Top three values of each column, their shares, and the concentration class."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    top = frequency.withColumn("rank", rank).where(F.col("rank") <= 3)
    aggs = []
    for k in (1, 2, 3):
        here = F.col("rank") == k
        aggs += [F.max(F.when(here, F.col("value"))).alias(f"top{k}"), F.max(F.when(here, F.col("pct"))).alias(f"pct{k}")]
    wide = top.groupBy("column").agg(*aggs)
    together = F.col("pct1") + F.coalesce("pct2", F.lit(0.0)) + F.coalesce("pct3", F.lit(0.0))
    kind = (
        F.when(F.col("pct1") >= 70, "extremely_concentrated")
        .when(F.col("pct1") >= 50, "very_concentrated")
        .when((together >= 80) & F.col("pct3").isNotNull(), "top_three")
        .when(F.col("pct1") >= 30, "slightly_skewed")
        .otherwise("even")
    )
    return wide.select("*", together.alias("top3_pct"), kind.alias("concentration"))


def category_counts(frequency: DataFrame, sparse_below: float = 5.0) -> DataFrame:
    """Values per column, how many are sparse, and the diversity band."""
    counts = frequency.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("pct") < sparse_below).alias("n_sparse")
    )
    return counts.select(
        "*",
        (F.col("n_sparse") * 100.0 / F.col("n_values")).alias("sparse_pct"),
        band(F.col("n_values"), (3, 7, 15), ("simple", "fair", "many", "very_many"), True).alias("diversity"),
    )
