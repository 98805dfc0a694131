"""Event labels from image scenes: one plan over all sites, each with its own windows of time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators import imagery as I
from terravane.operators.joins import attach
from terravane.operators.ranks import group_medians
from terravane.session import settle

KEY = ["site", "r", "c"]
WINDOWS = ("pre_start", "pre_end", "post_start", "post_end")


def in_windows(scenes: DataFrame, windows: DataFrame) -> DataFrame:
    """Observations inside the windows ``(site, pre_start, pre_end, post_start, post_end)`` of their site, with ``period``
    'pre' or 'post'; starts belong to a window, ends do not.  One inside both counts as 'pre'."""
    at = attach(scenes, windows.select("site", *[F.col(w).cast("timestamp").alias(f"_{w}") for w in WINDOWS]), ["site"])
    t = F.col("acquired").cast("timestamp")
    inside = lambda k: (t >= F.col(f"_{k}_start")) & (t < F.col(f"_{k}_end"))
    period = F.when(inside("pre"), F.lit("pre")).when(inside("post"), F.lit("post"))
    return at.withColumn("period", period).filter("period IS NOT NULL").drop(*[f"_{w}" for w in WINDOWS])


def composite_change(scenes: DataFrame, windows: DataFrame, value: str, strict: Column, relaxed: Column,
                     smooth: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(site, r, c, diff)``: median before minus median after.

    Per site and period the scenes that pass ``strict``, or ``relaxed`` where none does, each passed through ``smooth``; both medians in
    one aggregation.
    """
    used = I.with_fallback(in_windows(scenes, windows), strict, relaxed, by=("site", "period"), on_empty="drop")
    used = smooth(used) if smooth else used
    side = lambda p: F.when(F.col("period") == p, F.col(value))
    both = group_medians(used, KEY, {"_pre": side("pre"), "_post": side("post")})
    return both.select(*KEY, (F.col("_pre") - F.col("_post")).alias("diff"))


def event_extent(diff: DataFrame, excluded: DataFrame, threshold, conditions: Sequence[Column]) -> DataFrame:
    """Add ``label``: change above ``threshold`` where all ``conditions`` over ``diff`` joined with ``excluded`` hold,
    opened with the plus-shaped kernel.  Cells without change are 0."""
    on = diff.join(excluded, KEY, "left")
    mask = I.keep_where(I.above(F.col("diff"), threshold), *conditions)
    return I.morph_open(on.select(*KEY, mask.alias("label")), "label")


def flood_labels(scenes: DataFrame, windows: DataFrame, layers: DataFrame, adaptive: bool = True, fixed: float = I.BACKSCATTER_DROP_DB,
                 value: str = "vh", polarisation: str = "VH", dx: float = 10.0, dy: float = 10.0, speckle: float = I.SPECKLE_RADIUS) -> DataFrame:
    """Flooded cells from radar scenes ``(site, r, c, acquired, mode, orbit, pols, vh)``.

    Wide-swath scenes with the polarisation, of descending passes; of ascending ones where a site's window has none, never of both.  Each
    scene loses its speckle by the median of the cells within ``speckle`` metres (``dx, dy``: metres of a cell).  Permanent water of
    ``layers`` (``water_occurrence``) is left out.  The threshold is found per site, or ``fixed`` (also for a site without change values).
    """
    usable = (F.col("mode") == "IW") & F.array_contains("pols", polarisation)
    smooth = lambda d: I.focal_median(d, value, speckle, dx, dy, by=("site", "period", "acquired"))
    diff = composite_change(scenes, windows, value, usable & (F.col("orbit") == "DESCENDING"), usable & (F.col("orbit") == "ASCENDING"), smooth)
    cut: Column | float = fixed
    if adaptive:
        # Read for its range, its buckets, its sites and the result.
        diff = settle(diff)
        found = I.otsu_threshold(I.histogram(diff, "diff"))
        diff = attach(diff, I.complete_thresholds(found, diff.select("site").distinct(), fixed), ["site"])
        cut = F.col("threshold")
    return event_extent(diff, layers.select(*KEY, "water_occurrence"), cut, [I.not_permanent_water(F.col("water_occurrence"))])


def scar_labels(scenes: DataFrame, windows: DataFrame, layers: DataFrame, fixed: float = 0.15, cloud: float = 20.0, cloud_relaxed: float = 50.0,
                steep: float = 10.0) -> DataFrame:
    """Landslide scars from optical scenes ``(site, r, c, acquired, cloud_pct, qa60, b8, b4)``: loss of the vegetation index.

    Cloudy cells are left out; ``layers`` gives ``landcover`` (water and towns excluded) and ``slope`` (above ``steep``).
    """
    clear = scenes.filter(I.cloud_free(F.col("qa60"))).withColumn("index", I.normalized_difference(F.col("b8"), F.col("b4")))
    diff = composite_change(clear, windows, "index", F.col("cloud_pct") < cloud, F.col("cloud_pct") < cloud_relaxed)
    return event_extent(diff, layers.select(*KEY, "landcover", "slope"), fixed, [I.natural_land(F.col("landcover")), F.col("slope") > steep])
