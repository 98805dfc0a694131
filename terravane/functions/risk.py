"""Column expressions of risk levels, weather severity and palettes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------
NODATA = -9999.0
# Rain intensity (mm/h) and severity at the corners of the piecewise line.
SEVERITY_CORNERS = [(2.0, 0.10), (7.0, 0.25), (15.0, 0.40), (30.0, 0.60), (50.0, 0.80), (100.0, 1.0)]
RISK_LEVELS = [(20.0, "LOW"), (40.0, "MODERATE"), (60.0, "HIGH"), (80.0, "VERY HIGH")]
TOP_RISK_LEVEL = "CRITICAL"
# Red, green, blue, opacity of classes 1..5.
RISK_PALETTE = {
    1: (46, 204, 113, 140),
    2: (168, 224, 108, 150),
    3: (241, 196, 15, 170),
    4: (230, 126, 34, 185),
    5: (231, 76, 60, 200),
}
SILT_PALETTE = {1: (241, 196, 15, 200), 2: (230, 126, 34, 220), 3: (192, 57, 43, 240)}
CLASS_NAMES = {1: "Very Low", 2: "Low", 3: "Moderate", 4: "High", 5: "Very High"}


def weather_severity(rain: Column) -> Column:
    """Multiplier 0.10 .. 1.0, linear between the corners."""
    first_rain, first = SEVERITY_CORNERS[0]
    out = F.when(rain < first_rain, F.lit(first))
    for (x0, y0), (x1, y1) in zip(SEVERITY_CORNERS, SEVERITY_CORNERS[1:]):
        out = out.when(rain < x1, F.lit(y0) + (rain - F.lit(x0)) * F.lit(y1 - y0) / F.lit(x1 - x0))
    return out.otherwise(F.lit(SEVERITY_CORNERS[-1][1]))


def risk_level(score: Column) -> Column:
    out = None
    for upper, name in RISK_LEVELS:
        test = score < upper
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(TOP_RISK_LEVEL))


def gauge_level(score: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(score, F.lit(0.0))))
    return F.when(s >= 70, F.lit("critical")).when(s >= 30, F.lit("moderate")).otherwise(F.lit("low"))


def class_by_breaks(value: Column, breaks: Column, n_breaks: int) -> Column:
    """1 + number of breaks strictly below ``value`` (upper break included)."""
    out = F.lit(1)
    for i in range(n_breaks):
        out = out + (value > breaks[i]).cast("int")
    return out


def palette_channel(cls: Column, palette: dict, channel: int) -> Column:
    """Channel 0..3 of the class colour; 0 (transparent) for other classes."""
    out = None
    for k, rgba in palette.items():
        test = cls == k
        out = F.when(test, F.lit(rgba[channel])) if out is None else out.when(test, F.lit(rgba[channel]))
    return out.otherwise(F.lit(0))
