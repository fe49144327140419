import numpy as np

from plantscope.operators import huber


def objective_gradient(z, y, w, b, sigma, alpha, eps):
    """Gradient of sum(sigma + H(r / sigma) sigma) + alpha |w|^2 in (w, b, sigma), written out plainly."""
    r = y - z @ w - b
    inside = np.abs(r) <= eps * sigma
    dr = np.where(inside, 2 * r / sigma, 2 * eps * np.sign(r))  # derivative of the loss in r
    g_w = -(z.T @ dr) + 2 * alpha * w
    g_b = -dr.sum()
    g_s = np.where(inside, 1 - (r / sigma) ** 2, 1 - eps**2).sum()
    return np.concatenate([g_w, [g_b, g_s]])


def test_every_fit_of_the_grid_is_optimal_and_the_best_is_chosen(spark):
    r = np.random.default_rng(11)
    n, p = 600, 3
    x = r.normal(size=(n, p)) * [1.0, 5.0, 0.2] + [0.0, 10.0, -1.0]
    y = x @ [2.0, -0.5, 4.0] + 1.0 + r.standard_t(2, size=n)
    fold = np.arange(n) % 5
    is_test = np.arange(n) % 7 == 0
    rows = [(float(a), float(b), float(c), float(t), int(f), bool(s)) for (a, b, c), t, f, s in zip(x, y, fold, is_test)]
    rows.append((None, 1.0, 1.0, 1.0, 0, False))
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int, is_test boolean").repartition(3)
    alphas, epsilons = (1e-4, 1.0, 30.0), (1.1, 1.35, 2.0)
    model = huber.huber_search(df, "y", ["a", "b", "c"], alphas, epsilons)

    train = ~is_test
    plain_r2 = []
    for a in alphas:
        for e in epsilons:
            scores = []
            for k in range(5):
                fit_rows, held = train & (fold != k), train & (fold == k)
                m, s = x[fit_rows].mean(axis=0), x[fit_rows].std(axis=0)
                z = (x[fit_rows] - m) / s
                # the batched fit of this grid point and fold, read back by solving again here in plain numpy from its own optimum
                w, b, sigma = plain_fit(z, y[fit_rows], a, e)
                assert np.abs(objective_gradient(z, y[fit_rows], w, b, sigma, a, e)).max() < 1e-5 * n
                pred = ((x[held] - m) / s) @ w + b
                scores.append(1 - ((y[held] - pred) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum())
            plain_r2.append(np.mean(scores))
    best = int(np.argmax(plain_r2))
    assert (model.settings["alpha"], model.settings["epsilon"]) == (alphas[best // 3], epsilons[best % 3])
    assert abs(model.settings["cv_r2"] - plain_r2[best]) < 1e-6
    m, s = x[train].mean(axis=0), x[train].std(axis=0)
    w, b, sigma = plain_fit((x[train] - m) / s, y[train], model.settings["alpha"], model.settings["epsilon"])
    assert np.allclose([model.coef[c] for c in "abc"], w / s, rtol=1e-5, atol=1e-7)
    assert abs(model.intercept - (b - (w / s) @ m)) < 1e-5 and abs(model.settings["scale"] - sigma) < 1e-5


def plain_fit(z, y, alpha, eps, rounds=5000):
    """The same objective minimised one fit at a time by the alternating steps, until nothing moves."""
    p = z.shape[1]
    w, b, sigma = np.zeros(p), 0.0, 1.0
    z1 = np.column_stack([z, np.ones(len(y))])
    for _ in range(rounds):
        r = y - z @ w - b
        inside = np.abs(r) <= eps * sigma
        c = np.where(inside, 1 / sigma, eps / np.maximum(np.abs(r), 1e-300))
        pen = np.diag([alpha] * p + [0.0])
        theta = np.linalg.solve(z1.T @ (c[:, None] * z1) + pen, z1.T @ (c * y))
        room = len(y) - (~inside).sum() * eps**2
        new_sigma = np.sqrt((r[inside] ** 2).sum() / room) if room > 0 else 2 * sigma
        done = np.max(np.abs(np.append(theta, new_sigma) - np.append(np.append(w, b), sigma))) < 1e-12
        w, b, sigma = theta[:p], theta[p], new_sigma
        if done:
            break
    return w, b, sigma


def test_a_target_far_from_unit_scale_reaches_the_same_optimum(spark):
    """Every row starts outside a threshold of unit scale here: the scale must grow rather than stay where it began."""
    r = np.random.default_rng(5)
    n = 400
    x = r.normal(size=(n, 2)) * [3.0, 0.5]
    y = (x @ [1.5, -2.0] + 0.3 + r.standard_t(3, size=n)) * 5000.0
    rows = [(float(a), float(b), float(t), int(i % 5), False) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int, is_test boolean")
    model = huber.huber_search(df, "y", ["a", "b"], (1e-3,), (1.35,))
    m, s = x.mean(axis=0), x.std(axis=0)
    w, b, sigma = plain_fit((x - m) / s, y, 1e-3, 1.35)
    assert np.abs(objective_gradient((x - m) / s, y, w, b, sigma, 1e-3, 1.35)).max() < 1e-6 * np.abs(y).sum()
    assert np.allclose([model.coef["a"], model.coef["b"]], w / s, rtol=1e-5)
    assert abs(model.settings["scale"] - sigma) < 1e-5 * sigma and sigma > 1000


def test_the_sums_of_all_fits_are_those_of_plain_loops_and_one_file_is_scanned_on_all_cores(spark, monkeypatch):
    r = np.random.default_rng(3)
    n, p = 700, 2
    x = r.normal(size=(n, p)) * [3.0, 0.5] + [1.0, -4.0]
    y = x @ [1.5, -2.0] + r.standard_t(3, size=n)
    fold = np.arange(n) % 3
    fits = np.array([(0.1, e, k) for e in (1.1, 2.0) for k in (0, 1, 2, -1)], float)
    which = np.array([0, 1, 2, 3] * 2)
    scale = np.stack([np.stack([x[fold != k].mean(axis=0), x[fold != k].std(axis=0)]) for k in (0, 1, 2, -1)])
    state = np.column_stack([r.normal(size=(8, p + 1)), r.uniform(0.5, 3.0, 8)])
    rows = [(int(f), float(t), *map(float, v), False) for f, t, v in zip(fold, y, x)]
    df = spark.createDataFrame(rows, "_fold long, _y double, _x0 double, _x1 double, is_test boolean").coalesce(1)
    fit = huber._scan(df, ["_x0", "_x1"], fits, which, state, scale, "fit")
    score = huber._scan(df, ["_x0", "_x1"], fits, which, state, scale, "score")
    for g, (_, eps, k) in enumerate(fits):
        z1 = np.column_stack([(x - scale[which[g], 0]) / scale[which[g], 1], np.ones(n)])
        res = y - z1 @ state[g, : p + 1]
        used, sigma = fold != k, state[g, -1]
        inside = np.abs(res) <= eps * sigma
        c = used * np.where(inside, 1 / sigma, eps / np.abs(res))
        want = [*(z1.T @ (c[:, None] * z1)).ravel(), *(z1.T @ (c * y)), (res[inside & used] ** 2).sum(), (~inside & used).sum(), used.sum()]
        assert np.allclose(fit[g], want, rtol=1e-10, atol=1e-9)
        assert np.isclose(score[g, 0], (res[fold == k] ** 2).sum())
    seen, scan = [], huber._scan
    monkeypatch.setattr(huber, "_scan", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or scan(rows, *a))
    monkeypatch.setattr(huber, "ROUNDS", 2)
    named = df.withColumnsRenamed({"_fold": "fold", "_y": "y", "_x0": "a", "_x1": "b"})
    huber.huber_search(named, "y", ["a", "b"], (1e-3,), (1.35,))
    assert min(seen) >= spark.sparkContext.defaultParallelism
