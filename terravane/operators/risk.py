"""Risk maps and per-site risk scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.numbers import clip
from terravane.functions.risk import (
    CLASS_NAMES, NODATA, RISK_PALETTE, SILT_PALETTE, class_by_breaks, palette_channel, risk_level, weather_severity,
)
from terravane.operators.components import connected_components
from terravane.operators.joins import attach
from terravane.operators.ranks import quantiles
from terravane.session import settle

QUINTILES = [0.2, 0.4, 0.6, 0.8]
TERCILES = [0.33, 0.66]
# Fixed values
WATER_ROUGHNESS = (0.018, 0.030)
MIN_WATER_CELLS = 10


def valid(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & (F.abs(p) != F.lit(float("inf"))) & (p != NODATA)


def _clamp(p: Column) -> Column:
    return clip(p, 0, 1)


def _rgba(df: DataFrame, cls: str, palette: dict) -> DataFrame:
    return df.withColumns({k: palette_channel(F.col(cls), palette, i) for i, k in enumerate(("red", "green", "blue", "alpha"))})


def relative_overlay(df: DataFrame, multiplier: Column | float | None = None, p: str = "p") -> DataFrame:
    """Quintile class and colour per site; nodata is class 0 and transparent.

    With a ``multiplier`` the scaled values are compared with the quintiles of the
    unscaled ones (the active-risk map).
    """
    flat = df.withColumn("_p", F.when(valid(F.col(p)), _clamp(F.col(p))))
    cuts = quantiles(flat, ["site"], "_p", QUINTILES, "_q").select("site", "_q")
    value = F.col("_p")
    if multiplier is not None:
        # Products are compared at nine decimals, so that equality with a break holds.
        scaled = value * (multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier)))
        value = F.round(_clamp(scaled), 9)
        cuts = cuts.withColumn("_q", F.transform("_q", lambda q: F.round(q, 9)))
    out = attach(flat, cuts, ["site"], "left").withColumn(
        "risk_class", F.when(F.col("_p").isNotNull(), class_by_breaks(value, F.col("_q"), 4)).otherwise(F.lit(0))
    )
    return _rgba(out, "risk_class", RISK_PALETTE).drop("_p", "_q")


def active_overlay(df: DataFrame, multiplier: Column | float, p: str = "p") -> DataFrame:
    return relative_overlay(df, multiplier, p)


def water_mask(df: DataFrame, roughness: str = "manning_n") -> DataFrame:
    """Add ``water``: roughness of open water, only at sites with more than 10
    such cells."""
    hit = F.col(roughness).between(*WATER_ROUGHNESS)
    counts = df.groupBy("site").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("_k"))
    return attach(df, counts, ["site"]).withColumn("water", F.coalesce(hit & (F.col("_k") > MIN_WATER_CELLS), F.lit(False))).drop("_k")


def siltation_overlay(df: DataFrame, p: str = "p", roughness: str = "manning_n") -> DataFrame:
    """Terciles of the scores on connected water cells; land is transparent."""
    masked = settle(water_mask(df, roughness))
    kept = connected_components(masked.filter("water")).select("site", "r", "c", F.lit(True).alias("_kept"))
    on = masked.join(kept, ["site", "r", "c"], "left").withColumn(
        "_p", F.when(valid(F.col(p)) & F.col("_kept"), _clamp(F.col(p)))
    )
    # Read for the cuts and the result.
    on = settle(on)
    cuts = quantiles(on, ["site"], "_p", TERCILES, "_q").select("site", "_q")
    out = attach(on, cuts, ["site"], "left").withColumn(
        "silt_class", F.when(F.col("_p").isNotNull(), class_by_breaks(F.col("_p"), F.col("_q"), 2)).otherwise(F.lit(0))
    )
    return _rgba(out, "silt_class", SILT_PALETTE).drop("_p", "_q", "_kept")


def site_scores(df: DataFrame, p: str = "p") -> DataFrame:
    """Per site the terrain risk score and the confidence, both 0..100.

    A site without valid scores gets 0 for both.
    """
    v = F.when(valid(F.col(p)) & F.col(p).between(0.0, 1.0), F.col(p))
    on = df.select("site", v.alias("_p"))
    high = F.col("_p") > 0.5
    stats = on.groupBy("site").agg(
        F.max("_p").alias("_max"), F.avg(F.when(high, F.col("_p"))).alias("_mean_high"),
        F.avg(F.when(F.col("_p").isNotNull(), high.cast("double"))).alias("_share"),
        F.avg(F.abs(F.col("_p") - 0.5) * 2).alias("_sure"),
    )
    p90 = quantiles(on, ["site"], "_p", [0.9], "_q").select("site", F.col("_q")[0].alias("_p90"))
    score = (
        F.col("_p90") * 0.3 + F.col("_max") * 0.2 + F.coalesce("_mean_high", F.lit(0.0)) * 0.3 + F.col("_share") * 0.2
    ) * 100
    cap = lambda e: F.coalesce(clip(e, high=100), F.lit(0.0))
    return stats.join(p90, "site", "left").select(
        "site", cap(score).alias("score"), cap(F.col("_sure") * 100).alias("confidence")
    )


def active_risk(scores: DataFrame, rain: DataFrame, rain_col: str = "rainfall_mm_h") -> DataFrame:
    """Terrain score times weather severity, with its level."""
    j = scores.join(rain.select("site", rain_col), "site")
    return j.withColumn("severity", weather_severity(F.col(rain_col))).withColumn(
        "active_score", F.col("score") * F.col("severity")
    ).withColumn("risk_level", risk_level(F.col("active_score")))


def probability_summary(df: DataFrame, by: Sequence[str] = ("site",), p: str = "p") -> DataFrame:
    v = F.when(valid(F.col(p)), F.col(p))
    return df.groupBy(*by).agg(F.min(v).alias("p_min"), F.max(v).alias("p_max"), F.avg(v).alias("p_mean"))


def layer_summary(df: DataFrame, value: str, by: Sequence[str] = ("site",), nodata: float = NODATA) -> DataFrame:
    """Range, mean and count of valid cells; ``no_valid`` flags empty layers."""
    x = F.col(value)
    v = F.when(x.isNotNull() & ~F.isnan(x) & (x != nodata), x)
    return df.groupBy(*by).agg(
        F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.count(v).alias("valid")
    ).withColumn("no_valid", F.col("valid") == 0)


def quantile_classes(df: DataFrame, p: str = "p") -> DataFrame:
    """Susceptibility class 1..5 by the site's quintiles of positive scores;
    0 is nodata."""
    ok = valid(F.col(p)) & (F.col(p) >= 0)
    on = df.withColumn("_v", F.when(ok & (F.col(p) > 0), F.col(p)))
    cuts = quantiles(on, ["site"], "_v", QUINTILES, "_q").select("site", "_q")
    return attach(on, cuts, ["site"], "left").withColumn(
        "risk_class", F.when(ok & F.col("_q").isNotNull(), class_by_breaks(F.col(p), F.col("_q"), 4)).otherwise(F.lit(0))
    ).drop("_v", "_q")


def class_histogram(classes: DataFrame, cls: str = "risk_class") -> DataFrame:
    """Cells per site and class with the class name."""
    names = F.lit("No data")
    for k, n in CLASS_NAMES.items():
        names = F.when(F.col(cls) == k, F.lit(n)).otherwise(names)
    return classes.groupBy("site", cls).agg(F.count(F.lit(1)).alias("cells")).withColumn("class_name", names)
