"""Terrain derivatives over complete grids ``(site, r, c, z)``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terravane.functions.numbers import clip
from terravane.operators.joins import attach
from terravane.operators.lines import SEGMENT, neighbours
from terravane.operators.ranks import quantiles
from terravane.session import settle

CURVATURE_LIMIT = 10.0
TWI_RANGE = (-5.0, 30.0)


def number(x) -> Column:
    """A number as a literal, a Column (a step that differs by site) as it is."""
    return x if isinstance(x, Column) else F.lit(float(x))


def derivative(df: DataFrame, axis: str, values: dict[str, str], step, by: Sequence[str] = ("site",)) -> DataFrame:
    """Add ``values[v]`` = derivative of ``v`` along ``axis``: central inside,
    one-sided at the edge of the grid.  ``step`` is a number or a Column."""
    out = neighbours(df, axis, list(values), by)
    h = number(step)
    for v, name in values.items():
        prev, here, nxt = F.col(f"_prev.{v}"), F.col(v), F.col(f"_next.{v}")
        both = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
        out = out.withColumn(
            name,
            F.when(both, (nxt - prev) / (h * 2))
            .when(F.col("_next").isNotNull(), (nxt - here) / h)
            .when(F.col("_prev").isNotNull(), (here - prev) / h),
        )
    return out.drop("_prev", "_next")


def gradient(df: DataFrame, dx, dy, value: str = "z", by: Sequence[str] = ("site",)) -> DataFrame:
    """Add ``dzdx`` (along columns) and ``dzdy`` (along rows, southwards).

    ``dx``/``dy`` in metres give true slopes; degrees may be passed as well.
    """
    return derivative(derivative(df, "c", {value: "dzdx"}, dx, by), "r", {value: "dzdy"}, dy, by)


def slope_deg(dzdx: Column, dzdy: Column) -> Column:
    return F.degrees(F.atan(F.hypot(dzdx, dzdy)))


def aspect_deg(dzdx: Column, dzdy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(-dzdy, dzdx)), F.lit(360.0))


def slope_aspect(df: DataFrame, dx, dy, value: str = "z") -> DataFrame:
    g = gradient(df, dx, dy, value)
    return g.withColumn("slope", slope_deg(F.col("dzdx"), F.col("dzdy"))).withColumn(
        "aspect", aspect_deg(F.col("dzdx"), F.col("dzdy"))
    )


def curvatures(df: DataFrame, dx, dy, value: str = "z") -> DataFrame:
    """Add plan and profile curvature, limited to +/-10, 0 on flat ground."""
    g = gradient(df, dx, dy, value)
    g = derivative(g, "c", {"dzdx": "_xx"}, dx)
    g = derivative(g, "r", {"dzdx": "_xy", "dzdy": "_yy"}, dy)
    zx, zy, xx, yy, xy = (F.col(n) for n in ("dzdx", "dzdy", "_xx", "_yy", "_xy"))
    p = zx * zx + zy * zy
    q = p + 1.0
    lim = CURVATURE_LIMIT
    along = -(zx * zx * xx + zx * zy * xy * 2 + zy * zy * yy) / (p * F.sqrt(q * q * q))
    across = -(zy * zy * xx - zx * zy * xy * 2 + zx * zx * yy) / (p * F.sqrt(p))
    return (
        g.withColumn("profile_curvature", F.when(p > 1e-10, clip(along, -lim, lim)).when(p.isNotNull(), F.lit(0.0)))
        .withColumn("plan_curvature", F.when(p > 1e-10, clip(across, -lim, lim)).when(p.isNotNull(), F.lit(0.0)))
        .drop("_xx", "_xy", "_yy")
    )


def twi(acc: Column, slope: Column, dx, dy) -> Column:
    """Topographic wetness index, limited to -5 .. 30."""
    dx, dy = number(dx), number(dy)
    area = acc * (dx * dy) / ((dx + dy) / 2.0)
    steep = clip(F.tan(F.radians(slope)), 0.001)
    return clip(F.log(area / steep), *TWI_RANGE)


def streams(df: DataFrame, acc: str = "acc", top_percent: float = 5.0) -> DataFrame:
    """Add boolean ``stream``: accumulation in the top ``top_percent`` of its site."""
    cut = quantiles(df.filter(F.col(acc) > 0), ["site"], acc, [1 - top_percent / 100.0], "_q")
    cut = cut.select("site", F.col("_q")[0].alias("stream_threshold"))
    return attach(df, cut, ["site"], "left").withColumn("stream", F.coalesce(F.col(acc) >= F.col("stream_threshold"), F.lit(False)))


def _nearest_in_column(df: DataFrame, stream: str, tall: bool, segment: int) -> DataFrame:
    """``(site, r, c, _up, _down)``: rows of the nearest stream cells of the same
    column at or above and at or below each cell.

    Columns taller than a segment are scanned by segment; the last and first hit of
    every segment (one row each) carry over to the segments below and above.
    """
    hit = F.when(F.col(stream), F.col("r"))
    cells = df.select("site", "r", "c", hit.alias("_hit"), F.floor(F.col("r") / segment).alias("_s"))
    line = ["site", "c", "_s"]
    down = W.partitionBy(*line).orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy(*line).orderBy(F.col("r").desc()).rowsBetween(W.unboundedPreceding, 0)
    near = cells.withColumn("_up", F.max("_hit").over(down)).withColumn("_down", F.min("_hit").over(up))
    if not tall:
        return near.drop("_hit", "_s")
    ends = cells.groupBy(*line).agg(F.max("_hit").alias("_last"), F.min("_hit").alias("_first"))
    over = W.partitionBy("site", "c").orderBy("_s")
    ends = ends.withColumn("_above", F.max("_last").over(over.rowsBetween(W.unboundedPreceding, -1))).withColumn(
        "_below", F.min("_first").over(over.rowsBetween(1, W.unboundedFollowing)))
    return near.join(ends.drop("_last", "_first"), line).select(
        "site", "r", "c", F.coalesce("_up", "_above").alias("_up"), F.coalesce("_down", "_below").alias("_down"))


def row_distance(squares: np.ndarray, step: float) -> np.ndarray:
    """For every place of every row the minimum over places q of ``squares[q] + (step * (place - q))^2``.

    Lower envelope of parabolas, all rows at once: linear in the length of a row.  Infinite squares are no source.
    """
    n, width = squares.shape
    lines = np.arange(n)
    top = np.full(n, -1)  # place of the last parabola of each row's envelope
    source = np.zeros((n, width), dtype=np.int64)
    begin = np.full((n, width + 1), np.inf)
    for q in range(width):
        height = squares[:, q]
        open_rows = np.isfinite(height)
        cut = np.full(n, -np.inf)
        rows = lines[open_rows & (top >= 0)]
        while len(rows):
            v = source[rows, top[rows]]
            meet = (height[rows] - squares[rows, v]) / (2.0 * step * step * (q - v)) + (q + v) / 2.0
            behind = meet <= begin[rows, top[rows]]
            cut[rows] = np.where(behind, -np.inf, meet)
            rows = rows[behind]
            top[rows] -= 1
            rows = rows[top[rows] >= 0]
        rows = lines[open_rows]
        top[rows] += 1
        source[rows, top[rows]] = q
        begin[rows, top[rows]] = cut[rows]
        begin[rows, top[rows] + 1] = np.inf
    out = np.full_like(squares, np.inf)
    at = np.zeros(n, dtype=np.int64)
    rows = lines[top >= 0]
    for q in range(width):
        ahead = rows[begin[rows, at[rows] + 1] < q]
        while len(ahead):
            at[ahead] += 1
            ahead = ahead[begin[ahead, at[ahead] + 1] < q]
        v = source[rows, at[rows]]
        out[rows, q] = squares[rows, v] + (step * (q - v)) ** 2
    return out


def dist_to_stream(df: DataFrame, dx, dy, stream: str = "stream", cells_per_task: int = 1 << 18, segment: int = SEGMENT) -> DataFrame:
    """Add exact Euclidean distance ``dist`` to the nearest stream cell; ``dx, dy`` are numbers or Columns fixed per site.

    The transform is separable: first the nearest stream of the same column (running
    windows down a column), then the minimum along each row.  The row step runs on
    blocks of whole rows of at most about ``cells_per_task`` cells.
    """
    # Keys and flag only are read more than once.
    flags = settle(df.select("site", "r", "c", F.col(stream).alias("_stream"), number(dx).cast("double").alias("_dx"), number(dy).cast("double").alias("_dy")))
    shape = settle(flags.groupBy("site").agg(
        (F.max("c") + 1).alias("_width"), F.max("r").alias("_height"), F.first("_dx").alias("_dx"), F.first("_dy").alias("_dy")))
    tall = not shape.filter(F.col("_height") >= segment).isEmpty()
    gap = _nearest_in_column(flags, "_stream", tall, segment)
    rows = attach(gap, shape.drop("_height"), ["site"])
    rows = rows.select(
        "site", "r", "c", (F.least(F.col("r") - F.col("_up"), F.col("_down") - F.col("r")) * F.col("_dy")).alias("v"), "_dx",
        F.floor(F.col("r") / F.greatest(F.lit(1), F.floor(F.lit(cells_per_task) / F.col("_width")))).alias("_block"))

    def along_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["r"].min(), pdf["c"].min()
        shape = (pdf["r"].max() - r0 + 1, pdf["c"].max() - c0 + 1)
        ri, ci = (pdf["r"] - r0).to_numpy(), (pdf["c"] - c0).to_numpy()
        v = pdf["v"].astype("float64").to_numpy()
        sq = np.full(shape, np.inf)
        sq[ri, ci] = np.where(np.isnan(v), np.inf, v * v)
        dist = np.sqrt(row_distance(sq, float(pdf["_dx"].iloc[0]))[ri, ci])
        return pdf[["site", "r", "c"]].assign(dist=np.where(np.isinf(dist), np.nan, dist))

    site_type = df.schema["site"].dataType.simpleString()
    dist = rows.groupBy("site", "_block").applyInPandas(along_rows, f"site {site_type}, r int, c int, dist double")
    return df.join(dist.withColumn("dist", F.nanvl("dist", F.lit(None).cast("double"))), ["site", "r", "c"])


def hillshade(slope: Column, aspect: Column, altitude: float = 30.0, azimuth: float = 270.0) -> Column:
    """Illumination 0..255; ``aspect`` counts from east, counter-clockwise."""
    zenith = F.radians(F.lit(90.0 - altitude))
    sun = F.radians(F.lit((450.0 - azimuth) % 360.0))
    s, a = F.radians(slope), F.radians(aspect)
    light = F.cos(zenith) * F.cos(s) + F.sin(zenith) * F.sin(s) * F.cos(sun - a)
    return clip(light * 255.0, 0)


def grey(shade: Column) -> Column:
    return (shade + 255.0) / 2.0


def lowest_edge(df: DataFrame, value: str = "z") -> DataFrame:
    """Per site the edge with the lowest mean elevation.

    The first row counts as 'bottom'; ties go to bottom, top, left, right.
    """
    extent = df.groupBy("site").agg(*[f(x).alias(f"_{f.__name__}_{x}") for f in (F.min, F.max) for x in ("r", "c")])
    on = attach(df.select("site", "r", "c", value), extent, ["site"])
    edge = {
        "bottom": F.col("r") == F.col("_min_r"),
        "top": F.col("r") == F.col("_max_r"),
        "left": F.col("c") == F.col("_min_c"),
        "right": F.col("c") == F.col("_max_c"),
    }
    on = on.filter((edge["bottom"]) | (edge["top"]) | (edge["left"]) | (edge["right"]))
    means = on.groupBy("site").agg(*[F.avg(F.when(t, F.col(value))).alias(f"{n}_mean") for n, t in edge.items()])
    options = F.array(*[
        F.struct(F.col(f"{n}_mean").alias("m"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(edge)
    ])
    best = F.array_min(F.filter(options, lambda x: x["m"].isNotNull()))
    return means.withColumn("outlet_edge", best["n"]).withColumn("outlet_mean", best["m"])


def scarp_surface(df: DataFrame, planes: Sequence[tuple[float, float, float, float, float]], x: str = "x", y: str = "y",
                  z: str = "z", perimeter: str = "perimeter") -> DataFrame:
    """Add ``scarp`` and ``release``.  Each plane is (x, y, z, dip direction in
    degrees, slope in degrees); the surface is the highest plane, but not above
    the terrain, inside the perimeter and the terrain outside."""
    surfaces = []
    for px, py, pz, dip, steep in planes:
        tilt = np.tan(np.radians(steep))
        bx, by = float(tilt * np.cos(np.radians(dip))), float(tilt * np.sin(np.radians(dip)))
        surfaces.append(F.lit(float(pz)) + (F.col(y) - F.lit(float(py))) * F.lit(by) - (F.col(x) - F.lit(float(px))) * F.lit(bx))
    top = surfaces[0] if len(surfaces) == 1 else F.greatest(*surfaces)
    scarp = F.when((F.col(perimeter) > 0) & F.col(z).isNotNull(), F.least(F.col(z), top)).otherwise(F.col(z))
    return df.withColumn("scarp", scarp).withColumn("release", F.col(z) - F.col("scarp"))
