"""Event labels, masks and buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.joins import attach
from terravane.operators.lines import line_extreme

WATER, URBAN = 80, 50
BUFFER_CELLS = 3
# Fixed value: label sources in order of preference.
LABEL_SOURCES = ["flood_extent", "landslide_scars", "flood_extent_2018", "landslide_inventory_2024", "safe_label"]


def _flag(test: Column) -> Column:
    return F.when(test, F.lit(1)).otherwise(F.lit(0))


def proxy_flood(z: Column, slope: Column, landcover: Column) -> Column:
    dry = landcover != WATER
    return _flag(dry & (((z < 3.0) & (slope < 5.0)) | (z < 1.0)))


def proxy_flood_relaxed(z: Column, slope: Column, landcover: Column) -> Column:
    return _flag((z < 5.0) & (slope < 10.0) & (landcover != WATER))


def proxy_landslide(fs: Column, slope: Column, landcover: Column, fs_limit: float = 1.0, min_slope: float = 10.0) -> Column:
    return _flag((fs < fs_limit) & (fs > 0) & (slope > min_slope) & ~landcover.isin(WATER, URBAN))


def proxy_landslide_relaxed(fs: Column, slope: Column, landcover: Column) -> Column:
    return proxy_landslide(fs, slope, landcover, 1.5, 5.0)


def relax_if_empty(df: DataFrame, strict: Column, relaxed: Column, name: str = "label", by: Sequence[str] = ("site",)) -> DataFrame:
    """``strict`` labels; groups without a single positive take ``relaxed``."""
    both = df.withColumn("_strict", strict).withColumn("_relaxed", relaxed)
    any_hit = both.groupBy(*by).agg(F.max("_strict").alias("_any"))
    return attach(both, any_hit, by).withColumn(
        name, F.when(F.col("_any") == 1, F.col("_strict")).otherwise(F.col("_relaxed"))
    ).drop("_strict", "_relaxed", "_any")


def blank_label(grid: DataFrame) -> DataFrame:
    return grid.select("site", "r", "c").withColumn("label", F.lit(0))


def binarise(value: Column) -> Column:
    return _flag(value > 0.5)


def resolve_label_source(sites: DataFrame, available: DataFrame, order: Sequence[str] = tuple(LABEL_SOURCES), blank: str = "blank") -> DataFrame:
    """Per site the first source of ``order`` it has, else ``blank``."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(order):
        rank = F.when(F.col("source") == name, F.lit(i)).otherwise(rank)
    best = available.withColumn("_rank", rank).filter("_rank IS NOT NULL").groupBy("site").agg(
        F.min_by("source", "_rank").alias("source")
    )
    return sites.select("site").join(best, "site", "left").withColumn("source", F.coalesce("source", F.lit(blank)))


def valid_cell(landcover: Column, z: Column) -> Column:
    """Not water, and an elevation that is neither missing nor 0."""
    return (landcover != WATER) & z.isNotNull() & (z != 0)


def boundary_buffer(df: DataFrame, label: str = "label", cells: int = BUFFER_CELLS, name: str = "buffer") -> DataFrame:
    """1 on non-event cells at most ``cells`` steps (8-connected) from an event.

    The square is separable: a maximum along rows, then along columns.
    """
    near = df.withColumn("_near", F.col(label))
    near = line_extreme(line_extreme(near, "c", cells, "_near", F.max), "r", cells, "_near", F.max)
    return near.withColumn(name, _flag((F.col("_near") == 1) & (F.col(label) == 0))).drop("_near")
