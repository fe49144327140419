import numpy as np
import pytest

from plantscope.operators import huber, huber_bands

GRID = (1e-4, 1.0), (1.1, 1.35, 2.0)


@pytest.fixture(scope="module")
def df(spark):
    r = np.random.default_rng(21)
    n = 12_000
    x = r.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 10.0, -1.0]
    x[:, 1] += 4 * x[:, 0]
    y = (x @ [2.0, -0.5, 4.0] + 1.0 + r.standard_t(3, size=n) * (1 + 0.3 * np.abs(x[:, 0]))) * 100
    rows = [(*map(float, v), float(t), i % 5, i % 7 == 0) for i, (v, t) in enumerate(zip(x, y))]
    rows.append((None, 1.0, 1.0, 1.0, 0, False))
    return spark.createDataFrame(rows, "a double, b double, c double, y double, fold int, is_test boolean").repartition(3).persist()


@pytest.fixture(scope="module")
def plain(df):
    return huber.huber_search(df, "y", ["a", "b", "c"], *GRID)


def same(model, plain):
    assert (model.settings["alpha"], model.settings["epsilon"]) == (plain.settings["alpha"], plain.settings["epsilon"])
    assert model.settings["cv_r2"] == pytest.approx(plain.settings["cv_r2"], rel=1e-9)
    assert model.settings["scale"] == pytest.approx(plain.settings["scale"], rel=1e-6)
    assert [model.intercept, *model.coef.values()] == pytest.approx([plain.intercept, *plain.coef.values()], rel=1e-6)


def banded(monkeypatch, df, sample=6000, **change):
    monkeypatch.setattr(huber, "MOST_SCANNED", 1000)
    monkeypatch.setattr(huber_bands, "SAMPLE", sample)
    for name, value in change.items():
        monkeypatch.setattr(huber_bands, name, value)
    return huber.huber_search(df, "y", ["a", "b", "c"], *GRID)


@pytest.mark.filterwarnings("error::UserWarning")
def test_bands_find_what_scans_of_all_rows_find_and_few_rows_are_looked_at_again(df, plain, monkeypatch):
    left, settle = [], huber_bands._settle

    def seen(rows, *a):
        out = settle(rows, *a)
        left.append((rows.count(), out[0].count()))
        return out

    same(banded(monkeypatch, df, _settle=seen), plain)
    assert left[0][0] > 10_000 and left[-1][1] < 0.5 * left[0][0]
    assert all(rows < left[0][0] for rows, _ in left[1::2])  # only what was left open is scanned again


@pytest.mark.filterwarnings("error::UserWarning")
def test_a_sample_that_misleads_costs_scans_and_changes_nothing(df, plain, monkeypatch):
    good, calls = huber_bands._sample_region, []

    def off(pdf, shape, alphas, wide):
        taken, region = good(pdf, shape, alphas, wide)
        calls.append(wide)
        shift = 0.0 if len(calls) > 1 else 0.3
        return taken, huber_bands.Region(region.centre + shift * region.sigma[:, None], region.sigma * (1 + shift), region.root, region.room)

    same(banded(monkeypatch, df, _sample_region=off), plain)
    assert calls == [1.0, 2.0]


def test_all_rows_are_scanned_where_no_region_is_found(df, plain, monkeypatch):
    with pytest.warns(UserWarning, match="all rows are scanned"):
        same(banded(monkeypatch, df, ROUNDS=1), plain)


def test_sums_of_settled_and_open_rows_are_those_of_all(df, monkeypatch):
    r = np.random.default_rng(2)
    rows = df.where("a is not null").selectExpr("cast(fold as long) _fold", "y _y", "a _x0", "b _x1", "c _x2")
    pdf = rows.toPandas()
    shape = huber_bands.Shape(("_x0", "_x1", "_x2"), np.array([0.1, 10.0, -1.0]), np.array([1.0, 6.0, 0.2]), r.normal(size=4), np.array([1.1, 2.0]), (0, 1, 2, 3, 4))
    centre, sigma = r.normal(size=(2, 4)) * 30 - shape.taken + [200, -300, 80, -600], np.array([200.0, 150.0])
    region = huber_bands.Region(centre, sigma, np.array([np.eye(4) * 3.0] * 2), np.array([5.0, 4.0]))
    near, base, every = huber_bands._settle(rows.selectExpr("*", "cast(3 as long) _open"), shape, region)
    assert 0 < near.count() < len(pdf)
    theta = centre[[0, 1, 1]] + r.uniform(-1, 1, size=(3, 4))
    of, held, limit = np.array([0, 1, 1]), np.array([2, -1, 0]), shape.epsilons[[0, 1, 1]] * (sigma[[0, 1, 1]] + [4.0, -3.0, 0.0])
    assert region.holds(theta, sigma[of], of)
    got = huber_bands._near(near, shape, theta, limit, of, held)
    u1, y, fold = shape.read(pdf)
    products = shape.products(u1, y)
    for g in range(3):
        used = fold != held[g]
        res = y - u1 @ theta[g]
        inside = used & (np.abs(res) <= limit[g])
        sign = np.where(used & ~inside, np.sign(res), 0.0)
        want = np.concatenate([products[inside].sum(axis=0), sign @ u1, [np.abs(sign).sum()]])
        settled = base[[f for f in range(5) if f != held[g]], of[g]].sum(axis=0)
        np.testing.assert_allclose(settled + got[g], want, rtol=1e-9, atol=1e-6)
    np.testing.assert_allclose(every[:, : products.shape[1]].sum(axis=0), products.sum(axis=0), rtol=1e-9, atol=1e-6)
