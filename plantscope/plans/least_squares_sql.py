"""SQL text for least squares with any number of columns, by successive orthogonalization.

Used only as the counterpart the Spark results are compared with.
"""

from __future__ import annotations

from collections.abc import Sequence


def least_squares(name: str, source: str, y: str, xs: Sequence[str]) -> str:
    """CTEs ending in ``name`` with ``b0`` (intercept), ``b1`` … and ``res`` (residual sum of squares).

    The text starts with a comma, to follow other CTEs.
    """
    d = len(xs)
    p = f"_{name}"
    out = f", {p}src as materialized ({source})"
    out += (
        f", {p}m as (select avg({y}) as my, " + ", ".join(f"avg({x}) as m{i}" for i, x in enumerate(xs, 1)) + f" from {p}src)"
    )
    out += (
        f", {p}0 as (select {y} - my as vy, " + ", ".join(f"{x} - m{i} as v{i}" for i, x in enumerate(xs, 1)) + f" from {p}src, {p}m)"
    )
    for k in range(1, d + 1):
        rest = [f"{i}" for i in range(k + 1, d + 1)] + ["y"]
        out += (
            f", {p}g{k} as (select " + ", ".join(f"sum(v{k} * v{j}) / sum(v{k} * v{k}) as g{k}_{j}" for j in rest) + f" from {p}{k - 1})"
        )
        out += f", {p}{k} as materialized (select " + ", ".join(f"v{j} - g{k}_{j} * v{k} as v{j}" for j in rest) + f" from {p}{k - 1}, {p}g{k})"
    coef: dict[int, str] = {}
    steps = ""
    last = f"(select * from {p}m, " + ", ".join(f"{p}g{k}" for k in range(1, d + 1)) + ")"
    for k in range(d, 0, -1):
        minus = "".join(f" - g{k}_{j} * b{j}" for j in range(k + 1, d + 1))
        coef[k] = f"g{k}_y{minus} as b{k}"
        steps += f", {p}b{k} as (select *, {coef[k]} from {last})"
        last = f"{p}b{k}"
    out += steps
    intercept = "my" + "".join(f" - b{i} * m{i}" for i in range(1, d + 1))
    out += f", {name} as materialized (select {intercept} as b0, " + ", ".join(f"b{i}" for i in range(1, d + 1))
    out += f", (select sum(vy * vy) from {p}{d}) as res, (select sum(vy * vy) from {p}0) as tot from {last})"
    return out
