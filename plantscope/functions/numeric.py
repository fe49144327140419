"""Column expressions for guarded arithmetic, banding and binning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(top: Column, bottom: Column) -> Column:
    """NULL instead of an error when the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def clean(col: Column) -> Column:
    """NaN and infinities become NULL, so they cannot leak into a sum."""
    value = col.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def band(value: Column, cuts: Sequence[float], labels: Sequence[str], inclusive: bool = False) -> Column:
    """Label of the first cut that ``value`` stays below (or reaches, if inclusive).

    NULL stays NULL.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("one more label than cuts")
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        out = out.when(value <= cut if inclusive else value < cut, label)
    return out.otherwise(labels[-1])


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows meeting ``condition``; rows where it is NULL are left out."""
    return F.avg(F.when(condition, 1.0).when(~condition, 0.0))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def equal_width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Index of the equal-width bin, last bin closed on the right.

    A constant column gets the range half a unit around its value. The first
    guess is compared with the bin edges, so a value sitting on an edge always
    belongs to the bin that starts there, whatever the rounding.
    """
    low, high = bin_range(low, high)
    return bin_between(value, F.lit(low), F.lit(high), bins)


def bin_range(low: float, high: float) -> tuple[float, float]:
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def bin_between(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin for limits given as columns, ``low`` below ``high``."""
    step = (high - low) / bins
    guess = F.least(F.floor((value - low) / (high - low) * F.lit(bins)), F.lit(bins - 1))
    below = value < low + guess * step
    above = (value >= low + (guess + 1) * step) & (guess < bins - 1)
    return F.when(below, guess - 1).when(above, guess + 1).otherwise(guess).cast("int")
