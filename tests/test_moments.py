import numpy as np
import pandas as pd
import pytest

from plantscope.operators import moments


def test_a_hundred_columns_with_gaps_equal_pairwise_complete_pearson(spark):
    r = np.random.default_rng(3)
    n, p = 700, 100
    x = r.normal(size=(n, p)) @ r.normal(size=(p, p)) * 0.1 + 1e6 * (np.arange(p) % 3)
    x[r.random(size=(n, p)) < 0.2] = np.nan
    x[:, 7] = 5.0  # a constant column
    x[:, 8] = np.nan
    x[: n // 2, 9] = np.nan
    x[n // 2 :, 10] = np.nan  # never present together with column 9
    x[3, 11] = np.inf  # counts as missing
    cols = [f"c{k}" for k in range(p)]
    pdf = pd.DataFrame(x, columns=cols)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in cols)).repartition(4)
    pairs = [(cols[i], cols[j]) for i in range(p) for j in range(p) if i != j and (i + j) % 3 == 0] + [("c1", "c1"), ("c7", "c7")]
    got = {(r.x, r.y): r for r in moments.pearson_masked(df, pairs).collect()}
    assert len(got) == len(pairs)
    clean = pdf.replace([np.inf, -np.inf], np.nan)
    for a, b in pairs:
        both = clean[[a, b]].dropna() if a != b else clean[[a]].dropna()
        row = got[(a, b)]
        assert row.n == len(both) and row.method == "pearson"
        if a == b:
            assert row.value == (1.0 if both[a].std() > 0 else None)
            continue
        want = both[a].corr(both[b]) if len(both) and both[a].std() > 0 and both[b].std() > 0 else None
        if want is None or np.isnan(want):
            assert row.value is None, (a, b)
        else:
            assert row.value == pytest.approx(want, abs=1e-9), (a, b)


def test_empty_table_gives_no_links_and_zero_counts(spark):
    df = spark.createDataFrame([], "a double, b double, `a.b` double")
    rows = moments.pearson_masked(df, [("a", "b"), ("b", "a.b")]).collect()
    assert sorted((r.x, r.y, r.value, r.n) for r in rows) == [("a", "b", None, 0), ("b", "a.b", None, 0)]
