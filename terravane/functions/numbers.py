"""Small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """``x`` limited to the range; NULL stays NULL (``greatest`` and ``least``
    alone would skip it and return the limit)."""
    out = x
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(x.isNotNull(), out)
