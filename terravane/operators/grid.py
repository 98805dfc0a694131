"""Alignment of layers to a reference grid, filling and neighbourhoods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.grids import col_of, row_of
from terravane.operators.joins import attach
from terravane.operators.lines import block, neighbours
from terravane.operators.ranks import medians
from terravane.session import settle

KEY = ("site", "r", "c")
# What stands in for a layer a site lacks.
LAYER_DEFAULTS = {"flood": {"landcover": 40}, "landslide": {"landcover": 10}}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def cell_size(grid: DataFrame) -> DataFrame:
    """Grid table ``(site, dx, dy, south, north)`` in degrees -> ``dx_m, dy_m``."""
    from terravane.functions.grids import cell_height_m, cell_width_m

    centre = (F.col("south") + F.col("north")) / 2
    return grid.withColumn("dx_m", cell_width_m(F.col("dx"), centre)).withColumn("dy_m", cell_height_m(F.col("dy")))


def clip(df: DataFrame, west, south, east, north, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside the box, borders included; pushed to the Parquet scan."""
    return df.filter(F.col(x).between(west, east) & F.col(y).between(south, north))


def align_nearest(target: DataFrame, source: DataFrame, value: str, geometry: Mapping) -> DataFrame:
    """Value of the source cell that contains each target cell's centre ``(x, y)``.

    ``geometry`` has ``x0, y0, dx, dy`` of the source grid, numbers or Columns
    of the target (for instance joined from a grid table).
    """
    g = {k: _c(v) for k, v in geometry.items()}
    at = target.withColumn("_sr", row_of(F.col("y"), g["y0"], g["dy"])).withColumn(
        "_sc", col_of(F.col("x"), g["x0"], g["dx"])
    )
    src = source.select("site", F.col("r").alias("_sr"), F.col("c").alias("_sc"), value)
    return at.join(src, ["site", "_sr", "_sc"], "left").drop("_sr", "_sc")


def same_grid(a: Mapping, b: Mapping) -> bool:
    """True if two geometries given as numbers describe the same cells."""
    return all(isinstance(a[k], (int, float)) and a[k] == b.get(k) for k in ("x0", "y0", "dx", "dy"))


def align_bilinear(
    target: DataFrame, source: DataFrame, value: str, geometry: Mapping, target_geometry: Mapping | None = None, rim: bool = True,
) -> DataFrame:
    """Bilinear value at each target ``(x, y)``; NULL source cells carry no weight.

    Up to one cell beyond the outermost centres the value is that of the rim, or NULL without ``rim``.

    Every source cell is packed with its right, lower and lower-right neighbour,
    so a target needs one equi-join and no regrouping.  On an identical grid the
    layer is joined as it is.
    """
    if target_geometry is not None and same_grid(geometry, target_geometry):
        return target.join(source.select(*KEY, value), list(KEY), "left")
    g = {k: _c(v) for k, v in geometry.items()}
    fx = (F.col("x") - g["x0"]) / g["dx"] - F.lit(0.5)
    fy = (g["y0"] - F.col("y")) / g["dy"] - F.lit(0.5)
    right = neighbours(source.select(*KEY, value), "c", [value]).withColumn("_r", F.col(f"_next.{value}"))
    full = neighbours(right.drop("_prev", "_next"), "r", [value, "_r"])
    packed = full.select(
        "site", F.col("r").alias("_sr"), F.col("c").alias("_sc"),
        F.col(value).alias("_v00"), F.col("_r").alias("_v01"),
        F.col(f"_next.{value}").alias("_v10"), F.col("_next._r").alias("_v11"),
    )
    # Half a cell before the first row or column the base cell is 0 with weight 0.
    base_x, base_y = F.floor(fx), F.floor(fy)
    before_x, before_y = (fx > -1) & (fx < 0), (fy > -1) & (fy < 0)
    at = (
        target.withColumn("_sc", F.when(before_x, F.lit(0)).otherwise(base_x).cast("int"))
        .withColumn("_sr", F.when(before_y, F.lit(0)).otherwise(base_y).cast("int"))
        .withColumn("_wx", F.when(before_x, F.lit(0.0)).otherwise(fx - base_x))
        .withColumn("_wy", F.when(before_y, F.lit(0.0)).otherwise(fy - base_y))
    )
    joined = at.join(packed, ["site", "_sr", "_sc"], "left")
    wx, wy = F.col("_wx"), F.col("_wy")
    parts = [("_v00", (1 - wx) * (1 - wy)), ("_v01", wx * (1 - wy)), ("_v10", (1 - wx) * wy), ("_v11", wx * wy)]
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in parts:
        total = total + F.when(F.col(name).isNotNull(), w * F.col(name)).otherwise(F.lit(0.0))
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(F.lit(0.0))
    enough = (weight > 0) if rim else (weight > 1 - 1e-9) & ~before_x & ~before_y
    return joined.withColumn(value, F.when(enough, total / weight)).drop(
        "_sr", "_sc", "_wx", "_wy", *[n for n, _ in parts]
    )


def align_average(source: DataFrame, value: str, geometry: Mapping, threshold: float | None = 0.05) -> DataFrame:
    """Mean of the fine cells ``(site, x, y)`` in each coarse cell; with a
    threshold also ``flag`` = mean above it."""
    g = {k: _c(v) for k, v in geometry.items()}
    coarse = source.withColumn("r", row_of(F.col("y"), g["y0"], g["dy"])).withColumn(
        "c", col_of(F.col("x"), g["x0"], g["dx"])
    )
    out = coarse.groupBy(*KEY).agg(F.avg(value).alias(value))
    if threshold is None:
        return out
    return out.withColumn("flag", F.when(F.col(value) > threshold, F.lit(1)).otherwise(F.lit(0)))


def fill_missing_layer(grid: DataFrame, layer: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Left join of a layer; cells (or whole sites) without it get the default."""
    joined = grid.join(layer.select(*KEY, *defaults), list(KEY), "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def fill_nulls(df: DataFrame, values: Sequence[str], mode: str = "median", by: Sequence[str] = ("site",)) -> DataFrame:
    """NULL and NaN -> the group's exact median, or 0."""
    clean = df.withColumns({v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in values})
    if mode == "zero":
        return clean.withColumns({v: F.coalesce(F.col(v), F.lit(0.0)) for v in values})
    if mode != "median":
        raise ValueError(f"unknown mode {mode}")
    med = medians(clean, by, values).withColumnsRenamed({v: f"_med_{v}" for v in values})
    return attach(clean, med, by, "left").withColumns(
        {v: F.coalesce(F.col(v), F.col(f"_med_{v}")) for v in values}
    ).drop(*[f"_med_{v}" for v in values])


def fill_nulls_neighbour(df: DataFrame, value: str, reach: int = 1) -> DataFrame:
    """NULL -> mean of the valid cells around it; valid cells keep their value."""
    near = block(df, reach, [value], "_near")
    valid = F.filter(F.transform("_near", lambda x: x[value]), lambda v: v.isNotNull())
    total = F.aggregate(valid, F.lit(0.0), lambda s, v: s + v)
    return near.withColumn(value, F.coalesce(F.col(value), F.when(F.size(valid) > 0, total / F.size(valid)))).drop("_near")


def _halved(level: DataFrame) -> DataFrame:
    """The next coarser level: 2 x 2 cells to one, ``x`` their weighted mean, ``w`` the sum of their weights up to 1."""
    half = [F.floor(F.col(k) / 2).cast("int").alias(k) for k in ("r", "c")]
    sums = level.select("site", *half, "w", (F.col("w") * F.coalesce("x", F.lit(0.0))).alias("_wx")).groupBy(*KEY).agg(F.sum("w").alias("_w"), F.sum("_wx").alias("_wx"))
    return sums.select(*KEY, F.when(F.col("_w") > 0, F.col("_wx") / F.col("_w")).alias("x"), F.least(F.lit(1.0), "_w").alias("w"))


def _spread(level: DataFrame, coarse: DataFrame) -> DataFrame:
    """A level with its holes filled from the filled coarser level: each takes the bilinear value of the four coarse cells around it for
    the weight it lacks.  Coarse cells that do not exist or stayed empty are left out."""
    own = {k: F.floor(F.col(k) / 2).cast("int") for k in ("r", "c")}
    beside = {k: own[k] + F.when(F.pmod(F.col(k), F.lit(2)) == 1, 1).otherwise(-1) for k in ("r", "c")}
    four = F.array(*[
        F.struct(a.cast("int").alias("r"), b.cast("int").alias("c"), F.lit(share).alias("s"))
        for a, b, share in ((own["r"], own["c"], 0.5625), (own["r"], beside["c"], 0.1875), (beside["r"], own["c"], 0.1875), (beside["r"], beside["c"], 0.0625))
    ])
    holes = level.filter("w < 1").select("*", F.explode(four).alias("f"))
    near = coarse.select("site", F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("x").alias("_up"))
    met = holes.alias("h").join(near.alias("n"), F.col("h.site").eqNullSafe(F.col("n.site")) & (F.col("h.f.r") == F.col("n._r")) & (F.col("h.f.c") == F.col("n._c")), "left")
    sums = met.groupBy(*[F.col(f"h.{k}").alias(k) for k in KEY], F.col("h.x").alias("x"), F.col("h.w").alias("w")).agg(
        F.sum(F.when(F.col("_up").isNotNull(), F.col("h.f.s"))).alias("_s"), F.sum(F.col("h.f.s") * F.col("_up")).alias("_sx"))
    up = F.col("_sx") / F.col("_s")
    filled = F.coalesce(F.col("w") * F.coalesce("x", F.lit(0.0)) + (1 - F.col("w")) * up, F.col("x"))
    return level.filter("w >= 1").select(*KEY, "x").unionByName(sums.select(*KEY, filled.alias("x")))


def fill_holes(df: DataFrame, value: str, levels: list[int] | None = None) -> DataFrame:
    """Holes of any size are filled from around them by a pull-push pyramid; valid cells keep their value.

    Pull: 2 x 2 cells become one, level by level, until no cell lacks weight or nothing is left to join: log2 of the widest hole.  Push: back
    down each cell takes what it lacks from the coarser level, bilinearly.  All levels together hold a third more rows than the grid, each is
    settled.  NULL and NaN are holes; a site without any value stays empty; ``levels``, if given, receives the rows of every level.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    start = settle(df.select(*KEY, x.alias("x"), x.isNotNull().cast("double").alias("w")))
    pyramid = [start]
    while True:
        rows, holes = pyramid[-1].agg(F.count(F.lit(1)), F.count(F.when(F.col("w") < 1, 1))).head()
        if levels is not None:
            levels.append(rows)
        if not holes or (len(pyramid) > 1 and rows == before):
            break
        before = rows
        pyramid.append(settle(_halved(pyramid[-1])))
    filled = pyramid[-1].select(*KEY, "x")
    for level in reversed(pyramid[:-1]):
        filled = _spread(level, filled)
    same = F.col("d.site").eqNullSafe(F.col("f.site")) & (F.col("d.r") == F.col("f.r")) & (F.col("d.c") == F.col("f.c"))
    joined = df.alias("d").join(filled.alias("f"), same, "left")
    return joined.select(*[(F.coalesce(F.nanvl(F.col(f"d.{c}").cast("double"), F.lit(None).cast("double")), F.col("f.x")).alias(c) if c == value else F.col(f"d.{c}"))
                           for c in df.columns])


def sample_at_points(points: DataFrame, source: DataFrame, value: str, geometry: Mapping) -> DataFrame:
    """Bilinear value at points ``(site, x, y)`` of a grid whose gaps take the site median, which also stands beyond the
    outermost cell centres."""
    med = settle(medians(source, ["site"], [value]).withColumnRenamed(value, "_med"))
    filled = attach(source, med, ["site"], "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.col("_med"))).drop("_med")
    hit = align_bilinear(points, filled, value, geometry, rim=False)
    return attach(hit, med, ["site"], "left").withColumn(value, F.coalesce(F.col(value), F.col("_med"))).drop("_med")


def points_to_grid(points: DataFrame, grid: DataFrame, value: str, geometry: Mapping) -> DataFrame:
    """Mean of the points in each cell of ``grid``; 0 in cells without points."""
    cells = align_average(points, value, geometry, threshold=None)
    return grid.select(*KEY).join(cells, list(KEY), "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def neighbourhood(df: DataFrame, value: str, reach: int = 1) -> DataFrame:
    """One row per cell and existing cell of its square neighbourhood."""
    return block(df, reach, [value], "_near").select(*KEY, F.inline("_near"))
