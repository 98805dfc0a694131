"""Operators over time-step grids ``(site, r, c, step, ...)`` and monthly rain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAIN_FACTOR = 0.264
# Shares of the displayed maximum at which classes begin.
BREAK_SHARES = {"depth": [2, 5, 8, 12, 20], "time": [2, 4, 7, 10, 20]}
SIGNED_SHARES = [5, 10, 15]


def r_factor_monthly(monthly: DataFrame, by: Sequence[str] = ("cell_id",), value: str = "prec") -> DataFrame:
    """0.264 * sum(p^2) / sum(p) over the months of each cell; 0 if undefined."""
    p = F.col(value).cast("double")
    total = F.sum(p)
    return monthly.groupBy(*by).agg(
        F.when(total != 0, F.lit(RAIN_FACTOR) * F.sum(p * p) / total).otherwise(F.lit(0.0)).alias("r_factor")
    )


def running_max(steps: DataFrame, values: Sequence[str], by: Sequence[str] = ("cell_id",), step: str = "step") -> DataFrame:
    """Cell-wise maximum up to each step (a cell has one row per stored step)."""
    w = W.partitionBy(*by).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumns({f"{v}_max": F.max(v).over(w) for v in values})


def final_max(steps: DataFrame, values: Sequence[str], by: Sequence[str] = ("cell_id",)) -> DataFrame:
    return steps.groupBy(*by).agg(*[F.max(v).alias(f"{v}_max") for v in values])


def wet_cells(steps: DataFrame, h: str = "h", limit: float = 0.001, by: Sequence[str] = ("step",)) -> DataFrame:
    return steps.groupBy(*by).agg(F.sum(F.when(F.col(h) > limit, 1).otherwise(0)).alias("wet_cells"))


def time_of_reach(steps: DataFrame, threshold: float, h: str = "h", by: Sequence[str] = ("cell_id",)) -> DataFrame:
    """First step at or above the threshold; NULL where it is never reached."""
    return steps.groupBy(*by).agg(F.min(F.when(F.col(h) >= threshold, F.col("step"))).alias("reach_step"))


def breaks(dmax: Column, kind: str = "depth", digits: int = 2) -> Column:
    """Upper class limits at fixed shares of the displayed maximum."""
    return F.array(*[F.round(dmax * s / 20, digits) for s in BREAK_SHARES[kind]])


def depth_class(value: Column, limits: Column, minimum: Column) -> Column:
    """0 up to the minimum, then 1 .. 5 with the upper limit included; the last
    class is open."""
    out = (value > minimum).cast("int")
    for i in range(4):
        out = out + (value > limits[i]).cast("int")
    return out


def time_class(value: Column, limits: Column, minimum: Column) -> Column:
    """As :func:`depth_class` with a sixth class above the last limit."""
    return depth_class(value, limits, minimum) + (value > limits[4]).cast("int")


def signed_class(value: Column, limits: Column, minimum: Column) -> Column:
    """1 .. 9 for change of either sign: three classes below, three around zero
    and three above; ``limits`` are the positive class limits in ascending order."""
    edges = [-limits[2], -limits[1], -limits[0], -minimum, minimum, limits[0], limits[1], limits[2]]
    out = F.lit(1)
    for e in edges:
        out = out + (value > e).cast("int")
    return out
