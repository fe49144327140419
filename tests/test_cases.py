import re

import numpy as np
import pytest

from plantscope.operators import cases
from plantscope.session import local_table


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    some = [(i, float(rng.integers(0, 50)), None if i % 40 == 0 else float(rng.normal()), "ab"[i % 2]) for i in range(3000)]
    return local_table(spark, some * 2, "id long, a double, b double, c string")


def asked(spark, n=12):
    some = [(i % 9, None if i % 4 == 0 else float(i * 3), float("nan") if i % 5 == 1 else i / 10, [None, "a", "b"][i % 3]) for i in range(n)]
    return local_table(spark, some, "scenario_id long, a double, b double, c string")


def plain(rows, scenario, scale, metric):
    out = []
    for r in rows:
        gaps, away = [], 0.0
        for k in ("a", "b"):
            q = scenario[k]
            if q is None or q != q:
                continue
            gaps.append(None if r[k] is None else (r[k] - q) / scale[k])
        if scenario["c"] is not None:
            away = float(r["c"] != scenario["c"])
        known = None not in gaps
        out.append((sum(map(abs, gaps)) if metric == "L1" else sum(g * g for g in gaps) ** 0.5) + away if known else None)
    return out


@pytest.mark.parametrize("metric", ["L2", "L1"])
def test_distances_against_plain_ones(spark, rows, metric, monkeypatch):
    monkeypatch.setattr(cases, "SCENARIOS_AT_ONCE", 5)
    scale = cases.case_scale(rows, ["a", "b"])
    want = sorted(
        (s["scenario_id"], -1.0 if d is None else d) for s in asked(spark).collect() for d in plain(rows.collect(), s, scale, metric))
    got = cases.case_distances(rows, asked(spark), ["a", "b"], ["c"], keep=["id"], metric=metric)
    assert got.columns == ["id", "scenario_id", "distance"]
    got = sorted((r["scenario_id"], -1.0 if r["distance"] is None else r["distance"]) for r in got.collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-12)


def test_generated_code_holds_one_distance_however_many_scenarios(spark, rows):
    for table in (cases.case_distances(rows, asked(spark, 30), ["a", "b"], ["c"], keep=["id"]), cases.nearest_cases(rows, asked(spark, 30), ["a", "b"], ["c"])):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert 1 <= len(re.findall(r"SQRT\(", plan)) <= 2  # a filter may repeat it


def test_presets_together_are_presets_one_by_one(spark, rows):
    scenarios, order = asked(spark, 6), ["id", "a", "b", "c"]
    together = cases.nearest_by_preset(rows, scenarios, ["a", "b"], ["c"], order=order)
    assert list(together) == list(cases.PRESETS)
    for name, found in together.items():
        alone = cases.nearest_cases(rows, scenarios, ["a", "b"], ["c"], order=order, **cases.exploration_preset(name))
        assert found.columns == alone.columns
        assert sorted(map(repr, found.collect())) == sorted(map(repr, alone.collect()))
        assert found.count() > 6
