"""Change detection over stacks of satellite observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.operators.joins import attach
from terravane.operators.lines import block, neighbours
from terravane.operators.ranks import group_medians
from terravane.session import settle

# Fixed values
CLOUD_BITS = (10, 11)
WATER_OCCURRENCE = 80
WATER_CLASS, URBAN_CLASS, SCENE_WATER = 80, 50, 6
BACKSCATTER_DROP_DB = 3.0
SPECKLE_RADIUS = 50.0
NDVI_DROP = {"default": 0.3, "batch": 0.15}
HISTOGRAM_BUCKETS, HISTOGRAM_MIN_WIDTH = 255, 0.1
# Kernels that reach further than so many cells slide over tiles of this side.
FOCAL_REACH, FOCAL_TILE = 2, 128


def scene_filter(start, end, mode: str | None = None, orbit: str | None = None, polarisation: str | None = None,
                 max_cloud: float | None = None) -> Column:
    """Predicate on scene metadata: ``start <= acquired < end`` and the given properties."""
    test = (F.col("acquired") >= F.lit(start)) & (F.col("acquired") < F.lit(end))
    if mode is not None:
        test = test & (F.col("mode") == mode)
    if orbit is not None:
        test = test & (F.col("orbit") == orbit)
    if polarisation is not None:
        test = test & F.array_contains("pols", polarisation)
    if max_cloud is not None:
        test = test & (F.col("cloud_pct") < max_cloud)
    return test


def select_scenes(df: DataFrame, bands: Sequence[str], **filters) -> DataFrame:
    """Observations of the matching scenes, cut to keys and ``bands``."""
    keys = [k for k in ("site", "r", "c", "cell_id", "acquired") if k in df.columns]
    return df.filter(scene_filter(**filters)).select(*keys, *bands)


def with_fallback(df: DataFrame, strict: Column, relaxed: Column, by: Sequence[str] = ("site",), on_empty: str = "error") -> DataFrame:
    """Rows passing ``strict``; for groups without any, rows passing ``relaxed``.

    A group with neither is an error, or is dropped with ``on_empty='drop'``.
    """
    flags = df.groupBy(*by).agg(F.max(F.coalesce(strict, F.lit(False))).alias("_strict"),
                                F.max(F.coalesce(relaxed, F.lit(False))).alias("_relaxed"))
    if on_empty == "error":
        flags = flags.withColumn(
            "_strict", F.when(F.col("_strict") | F.col("_relaxed"), F.col("_strict")).otherwise(
                F.raise_error(F.lit("no scenes for a group under either filter")).cast("boolean"))
        )
    use = attach(df, flags, by)
    return use.filter(F.when(F.col("_strict"), strict).otherwise(relaxed)).drop("_strict", "_relaxed")


def cloud_free(qa: Column) -> Column:
    """Neither the cloud bit nor the cirrus bit is set."""
    return qa.bitwiseAND(F.lit(sum(1 << b for b in CLOUD_BITS))) == 0


def normalized_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.when(a + b != 0, a + b)


def median_composite(df: DataFrame, bands: Sequence[str], by: Sequence[str] = ("site", "r", "c")) -> DataFrame:
    """Per-cell median over scenes; cells with very many scenes are split off."""
    return group_medians(df, by, {b: F.col(b) for b in bands})


def index_composite(df: DataFrame, a: str, b: str, name: str, by: Sequence[str], order: str = "index_first") -> DataFrame:
    """Normalised difference per scene then median, or of the median bands."""
    if order == "index_first":
        return median_composite(df.withColumn(name, normalized_difference(F.col(a), F.col(b))), [name], by)
    return median_composite(df, [a, b], by).withColumn(name, normalized_difference(F.col(a), F.col(b))).drop(a, b)


def change(pre: DataFrame, post: DataFrame, value: str, by: Sequence[str], name: str = "diff") -> DataFrame:
    """``pre - post`` per cell; NULL where either side is missing."""
    a = pre.select(*by, F.col(value).alias("_pre"))
    b = post.select(*by, F.col(value).alias("_post"))
    return a.join(b, list(by), "full").select(*by, (F.col("_pre") - F.col("_post")).alias(name))


def windowed_change(df: DataFrame, value: str, split, by: Sequence[str], name: str = "diff") -> DataFrame:
    """Median before minus median from ``split`` on, in one aggregation (the
    pre- and post-event composites share one scan and one shuffle)."""
    before = F.col("acquired") < F.lit(split)
    both = group_medians(df, by, {"_pre": F.when(before, F.col(value)), "_post": F.when(~before, F.col(value))})
    return both.select(*by, (F.col("_pre") - F.col("_post")).alias(name))


def above(value: Column, threshold) -> Column:
    """1 above the threshold, else 0; missing is 0."""
    return F.when(value > threshold, F.lit(1)).otherwise(F.lit(0))


def keep_where(mask: Column, *conditions: Column) -> Column:
    """Mask cleared where any condition fails; missing conditions do not fail."""
    ok = F.lit(True)
    for cond in conditions:
        ok = ok & F.coalesce(cond, F.lit(True))
    return F.when(ok, mask).otherwise(F.lit(0))


def not_permanent_water(occurrence: Column) -> Column:
    return ~(occurrence > WATER_OCCURRENCE)


def natural_land(landcover: Column) -> Column:
    return ~landcover.isin(WATER_CLASS, URBAN_CLASS)


def _plus(df: DataFrame, value: str, pick, by: Sequence[str]) -> DataFrame:
    """Replace ``value`` by its extreme over the cell and its 4 neighbours."""
    a = neighbours(df, "c", [value], by).withColumn(
        "_h", pick(F.col(value), F.col(f"_prev.{value}"), F.col(f"_next.{value}"))
    ).drop("_prev", "_next")
    b = neighbours(a, "r", [value], by)
    return b.withColumn(value, pick("_h", F.col(f"_prev.{value}"), F.col(f"_next.{value}"))).drop("_h", "_prev", "_next")


def morph_open(df: DataFrame, value: str, by: Sequence[str] = ("site",)) -> DataFrame:
    """Erosion then dilation with the plus-shaped kernel; missing cells are ignored."""
    return _plus(_plus(df, value, F.least, by), value, F.greatest, by)


def focal_median(df: DataFrame, value: str, radius: float, dx: float, dy: float, by: Sequence[str] = ("site",), tile: int = FOCAL_TILE) -> DataFrame:
    """Median of the cells within ``radius`` (same unit as ``dx``, ``dy``); NULL and NaN are left out, a cell without any is NULL.

    Small kernels are collected by windows.  Kernels that reach further than :data:`FOCAL_REACH` cells slide over tiles: a histogram of the tile's
    ranks moves along the columns for all rows at once, so a step costs what enters and leaves at the kernel's rim, not its area.
    """
    reach = int(radius // min(dx, dy))
    if reach > FOCAL_REACH:
        return _sliding_median(df, value, radius, dx, dy, by, tile)
    near = block(df, reach, [value], "_near", by)
    inside = F.filter(
        "_near",
        lambda x: (x["dr"] * F.lit(dy)) * (x["dr"] * F.lit(dy)) + (x["dc"] * F.lit(dx)) * (x["dc"] * F.lit(dx))
        <= F.lit(radius * radius),
    )
    v = F.array_sort(F.filter(F.transform(inside, lambda x: F.nanvl(x[value].cast("double"), F.lit(None).cast("double"))), lambda x: x.isNotNull()))
    n = F.size(v)
    low = F.try_element_at(v, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(v, (F.floor(n / 2) + 1).cast("int"))
    return near.withColumn(value, F.when(n > 0, (low + high) / 2)).drop("_near")


class SlidingRanks:
    """Histograms of ranks, one for each row of centres, with sums over stretches of ranks to find an order statistic quickly."""

    def __init__(self, rows: int, ranks: int):
        import numpy as np

        self.width = max(1, int(np.ceil(ranks**0.5)))
        parts = -(-max(ranks, 1) // self.width)
        self.fine, self.coarse = np.zeros((rows, parts * self.width), dtype=np.int32), np.zeros((rows, parts), dtype=np.int32)
        self.rows = np.arange(rows)

    def move(self, rows, ranks, step: int) -> None:
        import numpy as np

        np.add.at(self.fine, (rows, ranks), step)
        np.add.at(self.coarse, (rows, ranks // self.width), step)

    def count(self):
        return self.coarse.sum(axis=1)

    def pick(self, place):
        """The rank at ``place`` (from 0) of each row's sorted contents; any rank where there are too few."""
        import numpy as np

        upto = np.cumsum(self.coarse, axis=1)
        part = np.minimum((upto <= place[:, None]).sum(axis=1), self.coarse.shape[1] - 1)
        before = upto[self.rows, part] - self.coarse[self.rows, part]
        inside = self.fine.reshape(len(self.rows), -1, self.width)[self.rows, part]
        at = (np.cumsum(inside, axis=1) <= (place - before)[:, None]).sum(axis=1)
        return part * self.width + np.minimum(at, self.width - 1)


def sliding_medians(r, c, v, wanted, radius: float, dx: float, dy: float):
    """Medians at the wanted cells over all cells ``r, c, v`` within ``radius``; several values may stand in one cell, NaN is left out."""
    import numpy as np

    out = np.full(len(r), np.nan)
    if not wanted.any():
        return out
    top, bottom, left, right = r[wanted].min(), r[wanted].max(), c[wanted].min(), c[wanted].max()
    known = np.flatnonzero(~np.isnan(v))
    values, rank = np.unique(v[known], return_inverse=True)
    if not len(values):
        return out
    order = np.argsort(c[known], kind="stable")
    row, column, rank = r[known][order] - top, c[known][order], rank[order]
    held = SlidingRanks(int(bottom - top) + 1, len(values))
    tall = int(radius // dy)
    reach = {d: int(np.floor((max(0.0, radius * radius - (d * dy) ** 2)) ** 0.5 / dx + 1e-9)) for d in range(-tall, tall + 1)}
    # The rim as the windowed form tests it: squares, without a root.
    for d in reach:
        while (d * dy) * (d * dy) + ((reach[d] + 1) * dx) * ((reach[d] + 1) * dx) <= radius * radius:
            reach[d] += 1
        while reach[d] > 0 and (d * dy) * (d * dy) + (reach[d] * dx) * (reach[d] * dx) > radius * radius:
            reach[d] -= 1

    def shift(d: int, first: int, until: int, step: int) -> None:
        lo, hi = np.searchsorted(column, [first, until])
        to = row[lo:hi] + d
        ok = (to >= 0) & (to < len(held.rows))
        held.move(to[ok], rank[lo:hi][ok], step)

    at = np.flatnonzero(wanted)
    at = at[np.argsort(c[at], kind="stable")]
    cuts = np.searchsorted(c[at], np.arange(left, right + 2))
    for x in range(int(left), int(right) + 1):
        for d, w in reach.items():
            if x == left:
                shift(d, x - w, x + w + 1, 1)
            else:
                shift(d, x + w, x + w + 1, 1)
                shift(d, x - w - 1, x - w, -1)
        mine = at[cuts[x - int(left)] : cuts[x - int(left) + 1]]
        if len(mine):
            n = held.count()
            low, high = held.pick(np.maximum(n - 1, 0) // 2), held.pick(n // 2)
            line = r[mine] - top
            middle = (values[np.minimum(low, len(values) - 1)] + values[np.minimum(np.where(n % 2, low, high), len(values) - 1)]) / 2
            out[mine] = np.where(n[line] > 0, middle[line], np.nan)
    return out


def _sliding_median(df: DataFrame, value: str, radius: float, dx: float, dy: float, by: Sequence[str], tile: int) -> DataFrame:
    """Each cell goes to its tile and to those whose rim reaches it; a task holds one tile with its rim."""
    import pyarrow as pa

    tall, wide = int(radius // dy), int(radius // dx)
    own = [F.floor(F.col(k) / tile).cast("int") for k in ("r", "c")]
    touched = [F.sequence(F.floor((F.col(k) - reach) / tile).cast("int"), F.floor((F.col(k) + reach) / tile).cast("int")) for k, reach in (("r", tall), ("c", wide))]
    keep = [k for k in df.columns if k != value]
    seen = df.select(*keep, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias(value)).withColumn("_tr", F.explode(touched[0])).withColumn(
        "_tc", F.explode(touched[1])).withColumn("_own", (F.col("_tr") == own[0]) & (F.col("_tc") == own[1]))

    def medians_of(table: pa.Table) -> pa.Table:
        import numpy as np

        wanted = table.column("_own").to_numpy()
        r, c = (table.column(k).to_numpy().astype(np.int64) for k in ("r", "c"))
        m = sliding_medians(r, c, table.column(value).to_numpy().astype(np.float64), wanted, radius, dx, dy)[wanted]
        rows = table.select(keep).filter(pa.array(wanted))
        return rows.append_column(value, pa.array(m, mask=np.isnan(m)))

    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField(value, T.DoubleType())])
    return seen.groupBy(*by, "_tr", "_tc").applyInArrow(medians_of, schema).select(*df.columns)


def histogram(df: DataFrame, value: str, by: Sequence[str] = ("site",), max_buckets: int = HISTOGRAM_BUCKETS,
              min_width: float = HISTOGRAM_MIN_WIDTH) -> DataFrame:
    """Counts and means of equal buckets over each group's range."""
    # Read for the range and for the buckets.
    src = settle(df.filter(F.col(value).isNotNull()).select(*by, value))
    span = src.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = span.withColumn("_width", F.greatest(F.lit(min_width), (F.col("_hi") - F.col("_lo")) / F.lit(float(max_buckets))))
    at = F.least(F.lit(max_buckets - 1), F.floor((F.col(value) - F.col("_lo")) / F.col("_width"))).cast("int")
    return (
        attach(src, span.drop("_hi"), by)
        .groupBy(*by, at.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    )


def otsu_threshold(hist: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """Bucket mean with the largest between-class variance, the first if several."""
    # At most 255 buckets per group, so these windows are small.
    upto = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    mass = F.col("n") * F.col("mean")
    h = (
        hist.withColumn("_wb", F.sum("n").over(upto)).withColumn("_w", F.sum("n").over(whole))
        .withColumn("_sb", F.sum(mass).over(upto)).withColumn("_s", F.sum(mass).over(whole))
        .withColumn("_wf", F.col("_w") - F.col("_wb"))
    )
    gap = F.col("_sb") / F.col("_wb") - (F.col("_s") - F.col("_sb")) / F.nullif(F.col("_wf"), F.lit(0))
    h = h.withColumn("_var", F.coalesce(F.col("_wb") * F.col("_wf") * gap * gap, F.lit(0.0)))
    return h.groupBy(*by).agg(F.max_by("mean", F.struct("_var", -F.col("bucket"))).alias("threshold"))


def complete_thresholds(found: DataFrame, groups: DataFrame, fixed: float, by: Sequence[str] = ("site",)) -> DataFrame:
    """Thresholds of all ``groups``: the one found, ``fixed`` for a group whose histogram is empty."""
    return groups.join(found, list(by), "left").withColumn("threshold", F.coalesce("threshold", F.lit(float(fixed))))


def turbidity(red: Column, green: Column, scl: Column) -> Column:
    """(red - green) / (red + green) over water, rescaled from [-.2, .2] to [0, 1]."""
    index = (red - green) / F.when((red + green > 0) & (scl == SCENE_WATER), red + green)
    return F.when(index.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (index + 0.2) / 0.4)))


def extent_summary(df: DataFrame, label: str, by: Sequence[str] = ("site",)) -> DataFrame:
    """Positive cells, cells with data and percentage per group."""
    return df.groupBy(*by).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("positive"), F.count(label).alias("total")
    ).withColumn("percent", F.when(F.col("total") > 0, F.col("positive") * 100.0 / F.col("total")).otherwise(F.lit(0.0)))
