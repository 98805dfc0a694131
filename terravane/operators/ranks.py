"""Exact order statistics without gathering a group in one task.

Values are placed into buckets by a fixed monotone function.  Totals per bucket
give every bucket its offset in the sorted order (few rows per group), and only
inside a bucket that is needed are values shuffled and sorted.  All levels are
deterministic functions of the data, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terravane.operators.joins import BROADCAST_ROWS
from terravane.session import settle

# Buckets per natural-log unit; a bucket spans about 0.1 % of a value.
DETAIL = 1024
# Parts of a bucket, equal in width between its smallest and largest value.
PARTS = 1024
_SCALE = float(2**20)
# Cells along the side of a tile.
TILE = 16
# Rows from which a group counts as hot.
HOT_GROUP = 100_000


def order_bucket(value: Column, detail: int = DETAIL) -> Column:
    """Monotone bucket number: linear near zero, logarithmic beyond."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * F.lit(_SCALE)) * F.lit(float(detail))).cast("long")


def _group(by: Sequence[str]) -> list[str]:
    return list(by) if by else ["_all"]


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """Per group the array ``name`` of exact quantiles, linearly interpolated,
    and the number ``n`` of non-null values."""
    keys = _group(by)
    src = df if by else df.withColumn("_all", F.lit(0))
    probs = [float(p) for p in probs]
    values = (
        src.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_b", order_bucket(F.col("_v")))
    )
    # First only rows per bucket are counted: partial aggregation leaves little to shuffle.
    hist = values.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bn"), F.min("_v").alias("_vmin"), F.max("_v").alias("_vmax"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0))).withColumn("_total", F.sum("_bn").over(W.partitionBy(*keys)))
    # Ranks such as 0.1 * 30 are whole numbers; rounding removes the float noise.
    spot = [F.round(F.lit(p) * (F.col("_total") - 1), 6) for p in probs]
    low = [F.floor(x) for x in spot]
    high = [F.ceil(x) for x in spot]

    def inside(rank: Column, start: Column, n: Column) -> Column:
        return (rank >= start) & (rank < start + n)

    def wanted(start: Column, n: Column) -> Column:
        hit = F.lit(False)
        for rank in [*low, *high]:
            hit = hit | inside(rank, start, n)
        return hit

    # Then the values of the few buckets that hold a wanted rank, cut once more by their own range, so that many
    # values in one bucket do not meet in one task; again only the parts with a wanted rank are sorted.
    kept = hist.filter(wanted(F.col("_before"), F.col("_bn")))
    width = F.col("_vmax") - F.col("_vmin")
    part = F.when(width > 0, F.least(F.lit(PARTS - 1), F.floor((F.col("_v") - F.col("_vmin")) / width * PARTS).cast("int"))).otherwise(0)
    carried = ["_before", "_total"]
    counts = values.join(kept.select(*keys, "_b", "_vmin", "_vmax", *carried), [*keys, "_b"]).withColumn("_s", part).groupBy(
        *keys, "_b", "_s", "_v").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in carried])
    earlier = W.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    sums = counts.groupBy(*keys, "_b", "_s").agg(F.sum("_n").alias("_sn"), *[F.first(c).alias(c) for c in carried])
    sums = sums.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_sn").over(earlier), F.lit(0)))
    sums = sums.filter(wanted(F.col("_from"), F.col("_sn"))).select(*keys, "_b", "_s", "_from")
    order = W.partitionBy(*keys, "_b", "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.join(sums, [*keys, "_b", "_s"]).withColumn("_start", F.col("_from") + F.sum("_n").over(order) - F.col("_n"))
    aggs = [F.first("_total").alias("n")]
    for i, (lo, hi) in enumerate(zip(low, high)):
        aggs.append(F.max(F.when(inside(lo, F.col("_start"), F.col("_n")), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(inside(hi, F.col("_start"), F.col("_n")), F.col("_v"))).alias(f"_hi{i}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    place = [F.round(F.lit(p) * (F.col("n") - 1), 6) for p in probs]
    frac = [x - F.floor(x) for x in place]
    values = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac[i] for i in range(len(probs))
    ]
    return out.select(*(keys if by else []), F.array(*values).alias(name), "n")


def melt(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row ``(by, k, x)`` per cell and column; ``k`` is the column's position."""
    xs = F.array(*[F.col(v).cast("double") for v in values])
    return df.select(*by, F.posexplode(xs).alias("k", "x"))


def medians(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians of several columns per group: one long pass, one row per group."""
    keys = list(by)
    med = quantiles(melt(df, keys, values), [*keys, "k"], "x", [0.5], "m")
    aggs = [F.max(F.when(F.col("k") == i, F.col("m")[0])).alias(v) for i, v in enumerate(values)]
    return med.groupBy(*keys).agg(*aggs) if keys else med.agg(*aggs)


def _tiles(keys: Sequence[str], df: DataFrame, side: int = TILE) -> dict[str, Column]:
    """Columns that name the tile of a cell: a square of rows and columns, or a stretch of cell numbers, of ``side`` squared cells."""
    if {"r", "c"} <= set(keys):
        rest = {f"_t{i}": F.col(k) for i, k in enumerate(keys) if k not in ("r", "c")}
        return {**rest, "_tr": F.floor(F.col("r") / side).cast("int"), "_tc": F.floor(F.col("c") / side).cast("int")}
    whole = [k for k in keys if df.schema[k].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")]
    if whole:
        rest = {f"_t{i}": F.col(k) for i, k in enumerate(keys) if k != whole[-1]}
        return {**rest, "_tr": F.floor(F.col(whole[-1]) / (side * side))}
    return {"_tr": F.pmod(F.xxhash64(*keys), F.lit(side * side))}


def _tile_medians(keys: Sequence[str], names: Sequence[str]):
    """Medians of every cell of one tile, from arrays of its values; missing values are left out."""
    import pyarrow as pa

    def medians_of(table: pa.Table) -> pa.Table:
        import numpy as np
        import pandas as pd

        code = np.zeros(table.num_rows, dtype=np.int64)
        for k in keys:
            part, seen = pd.factorize(table.column(k).to_pandas(), use_na_sentinel=False)
            code = code * (len(seen) + 1) + part
            code = np.unique(code, return_inverse=True)[1]
        _, first, size = np.unique(code, return_index=True, return_counts=True)
        start = np.cumsum(size) - size
        columns = [table.column(k).take(pa.array(first)) for k in keys]
        for name in names:
            v = table.column(name).to_numpy().astype(np.float64)
            v = v[np.lexsort((v, code))]  # missing values come last in their cell
            n = size - np.add.reduceat(np.isnan(v), start).astype(np.int64)
            low, high = start + np.maximum(n - 1, 0) // 2, start + np.minimum(n // 2, size - 1)
            columns.append(pa.array(np.where(n > 0, (v[low] + v[high]) / 2, 0.0), mask=n == 0))
        return pa.Table.from_arrays(columns, names=[*keys, *names])

    return medians_of


def group_medians(df: DataFrame, by: Sequence[str], values: dict[str, Column], hot_rows: int = HOT_GROUP) -> DataFrame:
    """Medians per small group (a cell's scenes): rows are dealt by tile, and a tile's medians are taken over its arrays at once.

    Only tiles are counted.  A tile of more than ``4 * hot_rows`` rows is cut into parts of about ``hot_rows``; inside such tiles cells are
    counted, and those above ``hot_rows`` ranked by :func:`quantiles`.  NULL and NaN are missing; a group without any value keeps its row.
    """
    keys, names = list(by), list(values)
    # NaN counts as missing, whichever way a group takes.
    src = df.select(*keys, *[F.nanvl(e.cast("double"), F.lit(None).cast("double")).alias(n) for n, e in values.items()])
    tile = _tiles(keys, src)
    dealt = src.withColumns(tile)
    schema = ", ".join([*[f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys], *[f"`{n}` double" for n in names]])
    crowded = settle(dealt.groupBy(*tile).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > 4 * hot_rows))
    found = crowded.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return dealt.groupBy(*tile).applyInArrow(_tile_medians(keys, names), schema)
    # NULL names a tile like any other value.
    same = functools.reduce(lambda a, b: a & b, [F.col(f"d.{t}").eqNullSafe(F.col(f"k.{t}")) for t in tile])
    parts = F.ceil(F.col("_k") / hot_rows)
    side = F.broadcast(crowded) if found <= BROADCAST_ROWS else crowded
    cut = dealt.alias("d").join(side.alias("k"), same, "left").select("d.*", "_k").withColumn(
        "_part", F.when(F.col("_k").isNull(), 0).otherwise(F.pmod(F.xxhash64(*keys), parts)))
    cells = cut.filter("_k IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = settle(cells.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]))
    many = hot.limit(BROADCAST_ROWS + 1).count()
    if many == 0:
        return cut.groupBy(*tile, "_part").applyInArrow(_tile_medians(keys, names), schema)
    hot = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
    is_hot = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
    cold = cut.join(hot, is_hot, "left_anti").groupBy(*tile, "_part").applyInArrow(_tile_medians(keys, names), schema)
    own = [F.col(f"_h{i}").alias(k) for i, k in enumerate(keys)]
    ranked = medians(src.join(hot, is_hot, "left_semi"), keys, names)
    # A group without any value keeps its row.
    named = hot.select(*own).alias("h").join(ranked.alias("m"), functools.reduce(
        lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]), "left")
    return cold.unionByName(named.select(*[F.col(f"h.{k}") for k in keys], *[F.col(f"m.{n}") for n in names]))


def running_sums(
    df: DataFrame, by: Sequence[str], order: str, sums: dict[str, Column], descending: bool = True
) -> DataFrame:
    """Per distinct value of ``order``: the sums of its rows, the sums
    ``cum_*`` up to and including it in sort order and the group's ``all_*``."""
    keys = _group(by)
    src = df if by else df.withColumn("_all", F.lit(0))
    sign = -1.0 if descending else 1.0
    per_value = (
        src.filter(F.col(order).isNotNull())
        .groupBy(*keys, order)
        .agg(*[F.sum(e).alias(k) for k, e in sums.items()])
        .withColumn("_b", order_bucket(F.col(order).cast("double")) * F.lit(int(sign)))
        .filter(F.col("_b").isNotNull())
    )
    # Read for the buckets, their parts and the result.
    per_value = settle(per_value)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    place = F.col(order).cast("double")
    hist = per_value.groupBy(*keys, "_b").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums], F.min(place).alias("_vmin"), F.max(place).alias("_vmax"))
    for k in sums:
        hist = hist.withColumn(f"_o_{k}", F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)))
        hist = hist.withColumn(f"all_{k}", F.sum(f"_t_{k}").over(W.partitionBy(*keys)))
    hist = hist.drop(*[f"_t_{k}" for k in sums])
    # Inside a bucket: parts of equal width, so that no task sorts all values of a crowded bucket.
    width = F.col("_vmax") - F.col("_vmin")
    part = F.when(width > 0, F.least(F.lit(PARTS - 1), F.floor((place - F.col("_vmin")) / width * PARTS).cast("int"))).otherwise(0)
    out = per_value.join(hist, [*keys, "_b"]).withColumn("_part", part * int(sign))
    earlier = W.partitionBy(*keys, "_b").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = out.groupBy(*keys, "_b", "_part").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums])
    parts = parts.select(*keys, "_b", "_part", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_p_{k}") for k in sums])
    out = out.join(parts, [*keys, "_b", "_part"])
    key = F.col(order).desc() if descending else F.col(order).asc()
    inner = W.partitionBy(*keys, "_b", "_part").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    for k in sums:
        out = out.withColumn(f"cum_{k}", F.col(f"_o_{k}") + F.col(f"_p_{k}") + F.sum(k).over(inner))
    drop = ["_b", "_part", "_vmin", "_vmax", *[f"_o_{k}" for k in sums], *[f"_p_{k}" for k in sums], *([] if by else ["_all"])]
    return out.drop(*drop)
