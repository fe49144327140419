"""Exact quantiles of many columns without sorting or shuffling the rows.

Each round counts values in equal-width cells of the interval that still holds
a wanted rank, all columns and ranks in one scan; partial aggregation keeps the
shuffle at a few thousand rows per task. A rank is settled when its cell holds
one single value, or few enough values to be listed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.functions.numeric import clean

CELLS = 2048
LIST_AT_MOST = 4096


@dataclass
class _Search:
    column: int
    rank: int  # 0-based position in the sorted column
    low: float
    high: float
    before: int  # values below the interval
    inside: int
    answer: float | None = None


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], cells: int = CELLS, list_at_most: int = LIST_AT_MOST,
    extent: dict[str, tuple[int, float, float]] | None = None,
) -> dict[str, dict[float, float | None]]:
    """Linear-interpolated quantiles of each column, NULL and NaN left out.

    ``extent`` gives count, minimum and maximum per column when they are known already.
    """
    values = {i: clean(F.col(f"`{c}`")) for i, c in enumerate(cols)}
    base = df.select(*[v.alias(f"v{i}") for i, v in values.items()])
    if extent:
        first = {f"{k}{i}": extent[c][j] for i, c in enumerate(cols) for j, k in enumerate(("n", "lo", "hi"))}
    else:
        first = base.agg(
            *[
                agg(F.col(f"v{i}")).alias(f"{name}{i}")
                for i in values
                for name, agg in (("n", F.count), ("lo", F.min), ("hi", F.max))
            ]
        ).first()
    searches: dict[tuple[int, int], _Search] = {}
    for i in values:
        n = first[f"n{i}"]
        for p in probs if n else ():
            at = p * (n - 1)
            for rank in {int(at), min(int(at) + 1, n - 1)}:
                searches.setdefault((i, rank), _Search(i, rank, first[f"lo{i}"], first[f"hi{i}"], 0, n))
    for s in searches.values():
        if s.low == s.high:
            s.answer = s.low
    while open_searches := [s for s in searches.values() if s.answer is None]:
        small = [s for s in open_searches if s.inside <= list_at_most]
        if small and len(small) == len(open_searches):
            _settle(base, small)
        else:
            _narrow(base, [s for s in open_searches if s.inside > list_at_most], cells)
    out: dict[str, dict[float, float | None]] = {}
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        out[c] = {}
        for p in probs:
            if not n:
                out[c][p] = None
                continue
            at = p * (n - 1)
            lower = searches[(i, int(at))].answer
            upper = searches[(i, min(int(at) + 1, n - 1))].answer
            out[c][p] = lower + (upper - lower) * (at - int(at))
    return out


def _intervals(searches: Sequence[_Search]) -> list[tuple[int, float, float]]:
    return sorted({(s.column, s.low, s.high) for s in searches})


def _cell(column: int, low: float, high: float, cells: int):
    # Halves before subtracting: a span above the largest double must not overflow.
    value = F.col(f"v{column}")
    place = (value / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
    return F.least(F.floor(place * F.lit(cells)), F.lit(cells - 1)).cast("int")


def _tagged(base: DataFrame, spans: Sequence[tuple[int, float, float]], cells: int | None) -> DataFrame:
    """Rows (span, cell, value) for the values inside the intervals; a column's intervals are disjoint."""
    per_column: dict[int, object] = {}
    for k, (c, low, high) in enumerate(spans):
        cell = _cell(c, low, high, cells) if cells else F.lit(0)
        mark = F.struct(F.lit(k).alias("span"), cell.alias("cell"), F.col(f"v{c}").alias("value"))
        inside = F.col(f"v{c}").between(low, high)
        per_column[c] = per_column[c].when(inside, mark) if c in per_column else F.when(inside, mark)
    return base.select(F.inline(F.array(*per_column.values()))).where(F.col("span").isNotNull())


def _narrow(base: DataFrame, searches: Sequence[_Search], cells: int) -> None:
    spans = _intervals(searches)
    counted = (
        _tagged(base, spans, cells)
        .groupBy("span", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        .collect()  # at most cells rows per interval
    )
    by_span: dict[int, list] = {k: [] for k in range(len(spans))}
    for row in counted:
        by_span[row["span"]].append(row)
    for rows in by_span.values():
        rows.sort(key=lambda r: r["cell"])
    numbers = {span: k for k, span in enumerate(spans)}
    for s in searches:
        seen = s.before
        for row in by_span[numbers[(s.column, s.low, s.high)]]:
            if s.rank < seen + row["n"]:
                s.before, s.inside, s.low, s.high = seen, row["n"], row["lo"], row["hi"]
                s.answer = s.low if s.low == s.high else None
                break
            seen += row["n"]


def _settle(base: DataFrame, searches: Sequence[_Search]) -> None:
    """List the few values left in each open interval."""
    spans = _intervals(searches)
    listed = (
        _tagged(base, spans, None)
        .groupBy("span", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most LIST_AT_MOST rows per interval
    )
    by_span: dict[int, list] = {k: [] for k in range(len(spans))}
    for row in listed:
        by_span[row["span"]].append((row["value"], row["n"]))
    for rows in by_span.values():
        rows.sort()
    numbers = {span: k for k, span in enumerate(spans)}
    for s in searches:
        seen = s.before
        for value, n in by_span[numbers[(s.column, s.low, s.high)]]:
            seen += n
            if s.rank < seen:
                s.answer = value
                break
