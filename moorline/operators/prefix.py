"""Sums below each distinct value, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4096


def slice_of(value: Column) -> Column:
    """A rising step function of any number, 0 to SLICES - 1."""
    v = value.cast("double")
    squashed = 0.5 + F.atan(v) / F.lit(3.141592653589793)
    inside = (v >= 0) & (v <= 1)  # probabilities get half of the slices to themselves
    half = SLICES // 2
    return F.when(inside, F.lit(SLICES // 4) + F.floor(v * (half - 1))).when(v < 0, F.floor(squashed * (SLICES // 4 - 1) * 2)).otherwise(F.lit(3 * SLICES // 4) + F.floor((squashed - 0.75) * 4 * (SLICES // 4 - 1))).cast("int")


def sums_below(df: DataFrame, by: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """by, value and for each sum s the sum at the value and s_below, over all smaller values of the group.

    Rows are first added up per distinct value. Values fall into at most SLICES slices of a rising function; running
    sums are made within slices, side by side, and over the slices' totals, of which a group has SLICES at most.
    """
    at = df.groupBy(*by, value).agg(*(c.alias(s) for s, c in sums.items())).withColumn("_slice", slice_of(F.col(value)))
    totals = at.groupBy(*by, "_slice").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_slice", *(F.coalesce(F.sum(f"_{s}").over(over), F.lit(0)).alias(f"_{s}") for s in sums))
    within = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = at.select(*by, value, "_slice", *sums, *(F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"{s}_in") for s in sums))
    return run.join(totals, [*by, "_slice"]).select(*by, value, *sums, *((F.col(f"{s}_in") + F.col(f"_{s}")).alias(f"{s}_below") for s in sums))
