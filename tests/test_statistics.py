import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantscope.operators import association as assoc
from plantscope.operators import distribution as dist
from plantscope.operators.quantiles import exact_quantiles
from plantscope.session import local_table

TIGHT = {"cells_per_bucket": 20, "rows_per_bucket": 9, "broadcast_rows": 3, "hot_rows": 60}


def frame(spark, pdf):
    return local_table(spark, [tuple(None if v != v else v for v in row) for row in pdf.to_numpy().tolist()],
                       ", ".join(f"{c} double" for c in pdf.columns))


def brute_dcor(a, b):
    x, y = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
    x = x - x.mean(0) - x.mean(1, keepdims=True) + x.mean()
    y = y - y.mean(0) - y.mean(1, keepdims=True) + y.mean()
    return np.sqrt(max((x * y).mean(), 0)) / np.sqrt(np.sqrt((x * x).mean() * (y * y).mean()))


def brute_tau(a, b):
    s, t = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    return (s * t).sum() / np.sqrt((s != 0).sum() * (t != 0).sum())


@pytest.fixture(scope="module")
def tied():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 500).astype(float)
    x[:170] = 7.0  # one value holds a third of the rows
    return pd.DataFrame({"x": x, "y": np.round(x * 0.3 + rng.normal(size=500) * 3, 1), "z": rng.integers(0, 5, 500).astype(float)})


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_four_correlations_against_brute_force(spark, tied, limits):
    pairs = assoc.column_pairs(["x", "y", "z"])
    got = assoc.association_pairs(frame(spark, tied), pairs, **limits).toPandas()
    for a, b in pairs:
        row = got[(got.x == a) & (got.y == b)].set_index("method").value
        u, v = tied[a].to_numpy(), tied[b].to_numpy()
        assert row["pearson"] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-12)
        assert row["spearman"] == pytest.approx(tied[a].rank().corr(tied[b].rank()), abs=1e-12)
        assert row["kendall"] == pytest.approx(brute_tau(u, v), abs=1e-12)
        assert row["dcor"] == pytest.approx(brute_dcor(u, v), abs=1e-10)


def test_pairs_with_missing_cells_are_complete_by_pair(spark, tied):
    holes = tied.iloc[100:260].reset_index(drop=True)
    holes.loc[::7, "x"] = np.nan
    holes.loc[::5, "y"] = np.nan
    pairs = [("x", "y"), ("y", "z")]
    got = assoc.association_pairs(frame(spark, holes), pairs).toPandas()
    for a, b in pairs:
        both = holes[[a, b]].dropna()
        row = got[(got.x == a) & (got.y == b)].set_index("method")
        assert set(row.n) == {len(both)}
        assert row.value["pearson"] == pytest.approx(both[a].corr(both[b]), abs=1e-12)
        assert row.value["spearman"] == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-12)
        assert row.value["kendall"] == pytest.approx(brute_tau(both[a].to_numpy(), both[b].to_numpy()), abs=1e-12)
        assert row.value["dcor"] == pytest.approx(brute_dcor(both[a].to_numpy(), both[b].to_numpy()), abs=1e-10)


def test_a_constant_column_gives_null_not_an_error(spark):
    df = frame(spark, pd.DataFrame({"c": [2.0] * 5, "x": [1.0, 2, 3, 4, 5]}))
    got = {r["method"]: r["value"] for r in assoc.association_pairs(df, [("c", "x")]).collect()}
    assert got == {"pearson": None, "spearman": None, "kendall": None, "dcor": 0.0}


def test_two_rows_have_no_distance_correlation(spark):
    df = frame(spark, pd.DataFrame({"a": [1.0, 2.0], "b": [3.0, 1.0]}))
    got = {r["method"]: r["value"] for r in assoc.association_pairs(df, [("a", "b")]).collect()}
    assert got["dcor"] is None and got["kendall"] == -1.0


def test_consensus_and_verdicts(spark):
    table = local_table(
        spark,
        [("a", 0.5, 0.5, 0.4, 0.5), ("b", -0.5, None, None, None), ("c", None, None, None, None), ("d", 0.001, 0.0, 0.0, 0.01)],
        "variable string, pearson double, spearman double, kendall double, dcor double",
    )
    out = {r["variable"]: r for r in assoc.consensus(table).collect()}
    assert out["a"]["consensus"] == pytest.approx(0.2 + 0.1 + 0.04 + 0.15)
    assert out["b"]["consensus"] == pytest.approx(-0.2)
    assert out["c"]["sign"] == 0
    terms = local_table(spark, [("a", 50.0), ("b", 30.0), ("d", 20.0)], "term string, ratio double")
    verdict = {r["variable"]: r for r in assoc.association_notes(assoc.compare_with_regression(assoc.consensus(table), terms)).collect()}
    assert {k: v["verdict"] for k, v in verdict.items()} == {"a": "agree", "b": "direction_conflict", "c": "unclear", "d": "unclear"}
    assert verdict["a"]["notes"] == ["maybe_nonlinear"] and verdict["c"]["notes"] == ["both_weak"]
    assert verdict["d"]["notes"] == ["association_weak"]


@pytest.mark.parametrize("sizes", [{}, {"cells": 4, "list_at_most": 3}])
def test_quantiles_are_exact(spark, sizes):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "tail": np.exp(rng.normal(size=400) * 5), "ties": rng.integers(0, 3, 400).astype(float), "same": np.full(400, 2.5),
        "holes": np.where(rng.random(400) < 0.3, np.nan, rng.normal(size=400)), "huge": rng.normal(size=400) * 1e307,
    })
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    got = exact_quantiles(frame(spark, pdf), list(pdf.columns), probs, **sizes)
    for c in pdf.columns:
        assert [got[c][p] for p in probs] == pytest.approx(list(pdf[c].quantile(probs)), rel=1e-12)
    assert exact_quantiles(frame(spark, pdf.head(0)), ["tail"], [0.5]) == {"tail": {0.5: None}}


def test_moments_follow_the_corrected_forms(spark):
    pdf = pd.DataFrame({"a": np.random.default_rng(2).exponential(size=300), "one": [1.0] + [np.nan] * 299})
    got = {r["column"]: r for r in dist.describe_moments(frame(spark, pdf), ["a", "one"]).collect()}
    assert got["a"]["skew"] == pytest.approx(pdf.a.skew(), rel=1e-9)
    assert got["a"]["kurtosis"] == pytest.approx(pdf.a.kurtosis(), rel=1e-9)
    assert got["a"]["sd"] == pytest.approx(pdf.a.std(), rel=1e-9)
    assert (got["one"]["n"], got["one"]["sd"], got["one"]["skew"]) == (1, None, None)


def test_histogram_edges_match_numpy(spark):
    pdf = pd.DataFrame({"d": np.arange(11) / 100, "c": [4.0] * 11})
    rows = dist.histogram(frame(spark, pdf), ["d", "c"], 30).orderBy("column", "bin").collect()
    for c in pdf.columns:
        assert [r["count"] for r in rows if r["column"] == c] == list(np.histogram(pdf[c], bins=30)[0])


def test_two_groups_are_seen(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.r_[rng.normal(0, 1, 300), rng.normal(20, 1, 300)], "n": rng.normal(50, 5, 600)})
    df = frame(spark, pdf)
    table = dist.validated_peaks(df, dist.with_modality(dist.with_peaks(dist.shape_table(df, ["g", "n"]))))
    table = dist.with_shape_class(dist.with_flags(table))
    got = {r["column"]: r for r in table.collect()}
    assert got["g"]["shape"] == "bimodal" and got["g"]["bimodal_score"] == 1
    assert got["n"]["shape"] in ("near_normal", "normal_like")
    groups = dist.group_representatives(table).orderBy("group").collect()
    assert [r["rule"] for r in groups] == ["peaks", "peaks"] and groups[1]["value"] - groups[0]["value"] > 15


def test_category_classes(spark):
    rows = [("a",)] * 72 + [("b",)] * 25 + [("c",)] * 3 + [(None,)] * 10
    frequency = dist.category_frequency(local_table(spark, rows, "k string"), ["k"])
    top = dist.category_concentration(frequency).first()
    assert (top["top1"], top["concentration"], top["pct1"]) == ("a", "extremely_concentrated", 72.0)
    counts = dist.category_counts(frequency).first()
    assert (counts["n_values"], counts["n_sparse"], counts["diversity"]) == (3, 1, "simple")


def test_results_do_not_depend_on_partitioning(spark, tied):
    df = frame(spark, tied)
    pairs = [("x", "y")]
    left = assoc.association_pairs(df, pairs, ["kendall", "dcor"], **TIGHT).collect()
    right = assoc.association_pairs(df.repartition(7, F.col("z")), pairs, ["kendall", "dcor"], **TIGHT).collect()
    assert [r["value"] for r in left] == pytest.approx([r["value"] for r in right], abs=1e-12)


def test_continuous_queries_compare_all_pairs(spark, tmp_path):
    from plantscope.plans import relations, views

    rng = np.random.default_rng(11)
    rows = [(k, k % 4, float(p), float(q), float(d), float(t), "A", "F") for k, (p, q, d, t) in enumerate(zip(
        rng.normal(100, 20, 120).round(1), rng.integers(1, 20, 120), rng.integers(0, 10, 120) / 100, rng.integers(0, 8, 120) / 100))]
    local_table(spark, rows, "l_orderkey long, l_linenumber long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    data = views.process(spark, str(tmp_path)).toPandas()
    for query, brute in ((relations.kendall_continuous, brute_tau), (relations.distance_correlation_continuous, brute_dcor)):
        got = {(r["x"], r["y"]): r["value"] for r in query(spark, str(tmp_path)).collect()}
        assert len(got) == 10
        for (a, b), value in got.items():
            assert value == pytest.approx(brute(data[a].to_numpy(), data[b].to_numpy()), abs=1e-7)


def test_group_counts_count_rows_around_each_peak(spark):
    import numpy as np

    from plantscope.operators import distribution as dist

    r = np.random.default_rng(2)
    two = np.concatenate([r.normal(10, 1, 3000), r.normal(30, 1, 2000)])
    rows = [(float(v), 1.0) for v in two] + [(None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "two double, flat double")
    shaped = dist.with_modality(dist.with_peaks(dist.shape_table(df, ["two", "flat"])))
    found = dist.group_counts(df, dist.with_flags(dist.validated_peaks(df, shaped))).collect()
    assert {f.column for f in found} == {"two"} and len(found) == 2
    clean = two[~np.isnan(two)]
    for f in found:
        assert f.high - f.value == pytest.approx(0.1 * (clean.max() - clean.min()))
        assert f.n_rows == int(((clean >= f.low) & (clean <= f.high)).sum())
        assert f.share == pytest.approx(f.n_rows / len(clean))
    assert sorted(round(f.value) for f in found) in ([10, 30], [10, 29], [11, 30], [9, 30], [10, 31])


def test_inversions_shuffle_rows_once_per_column_not_per_pair(spark):
    from plantscope.operators.inversions import inversion_sums
    from plantscope.operators.ranks import column_sizes

    rng = np.random.default_rng(8)
    n = 400
    data = pd.DataFrame({"u": rng.normal(size=n).round(2), "v": rng.normal(size=n).round(1), "k": rng.integers(0, 4, n) - 0.0, "one": np.ones(n)})
    data.loc[:150, "u"] = 0.25  # a value of more than a third of the rows
    data.loc[::9, "v"] = -0.0
    data.loc[1::9, "v"] = 0.0
    data = pd.concat([data, data[:50]], ignore_index=True)
    pairs = assoc.column_pairs(list(data.columns))
    df = frame(spark, data)
    for limit in (7, 60, 100_000):
        found = inversion_sums(df, pairs, column_sizes(df, list(data.columns)), limit)
        rows = {r["pair"]: r for r in found.collect()}
        for i, (p, q) in enumerate(pairs):
            x, y = data[p].to_numpy(), data[q].to_numpy()
            dx, dy = x[None, :] - x[:, None], y[None, :] - y[:, None]
            crossing = (dx > 0) & (dy < 0)
            assert rows[i]["weight"] == crossing.sum()
            assert rows[i]["tied"] == (((dx == 0) & (dy == 0)).sum() - len(x)) / 2
            assert rows[i]["cross"] == pytest.approx((dx * dy)[crossing].sum(), abs=1e-8)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsInPandas") <= len(data.columns) + 1 and "RepartitionByExpression" not in plan
