"""Numeric functions on columns: probabilities, log sums, schedules, rates, numbers for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16  # of a double


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array of doubles, shifted by its greatest; null for an empty array."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(F.transform(values, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def finite(x: Column) -> Column:
    """Whether a double is a number and not infinite; null counts as not."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def rate(n: Column, d: Column) -> Column:
    """n / d to 12 digits; null where d is 0."""
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), 12)


def warmup(step: Column, steps: int, share: float) -> Column:
    """Learning-rate factor: linear rise over the first share of the steps, linear fall to 0 after."""
    w = max(1, int(steps * share))
    return F.least((step + 1) / F.lit(float(w)), F.greatest(F.lit(0.0), (F.lit(float(steps)) - step) / F.lit(float(max(1, steps - w)))))


def signed3(x: Column) -> Column:
    """A signed number of three decimals with a true minus sign."""
    return F.concat(F.when(x < 0, F.lit("−")).otherwise(F.lit("+")), F.format_number(F.abs(x), 3))


def whole_percent(x: Column) -> Column:
    return F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))


def marker(x: Column) -> Column:
    """A position from 0 to 100 of a margin clamped to -1..1."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) * 50
