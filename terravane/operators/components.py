"""Connected regions of cells.

Cells are labelled inside square tiles first (Arrow batches, one tile per group).
Only labels that touch across a tile border enter the graph that is then reduced
by repeated minimum and pointer jumping in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.joins import attach
from terravane.session import settle

TILE = 256
# A region's label is the code of its first cell in row order.
ROW_CODE = 2**31
MIN_REGION = 8


def cell_code(r: Column, c: Column) -> Column:
    return r.cast("long") * F.lit(ROW_CODE) + c.cast("long")


def _tile_labels(connectivity: int):
    shifts = [(0, 1), (1, 0)] if connectivity == 4 else [(0, 1), (1, 0), (1, 1), (1, -1)]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
        shape = (int(pdf["r"].max()) - r0 + 1, int(pdf["c"].max()) - c0 + 1)
        n = len(pdf)
        at = np.full((shape[0] + 2, shape[1] + 2), -1)
        ri, ci = (pdf["r"] - r0 + 1).to_numpy(), (pdf["c"] - c0 + 1).to_numpy()
        at[ri, ci] = np.arange(n)
        a, b = [], []
        for dr, dc in shifts:
            other = at[ri + dr, ci + dc]
            own = np.flatnonzero(other >= 0)
            a.append(own)
            b.append(other[own])
        a, b = np.concatenate(a), np.concatenate(b)
        root = np.arange(n)
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for end in (a, b, root[a], root[b]):
                np.minimum.at(new, end, low)
            while not np.array_equal(new, jumped := new[new]):
                new = jumped
            if np.array_equal(new, root):
                break
            root = new
        code = pdf["r"].to_numpy("int64") * ROW_CODE + pdf["c"].to_numpy("int64")
        return pdf[["site", "r", "c"]].assign(label=code[root])

    return label


def label_regions(mask: DataFrame, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """Mask cells ``(site, r, c)`` -> the same with ``label``, the code of the first
    cell of the 4- or 8-connected region."""
    site_type = mask.schema["site"].dataType.simpleString()
    tiles = mask.select(
        "site", "r", "c",
        F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"),
    )
    local = settle(
        tiles.groupBy("site", "tr", "tc").applyInPandas(
            _tile_labels(connectivity), f"site {site_type}, r int, c int, label long"
        )
    )
    # All sites within the tile at the origin; negative indices lie in other tiles.
    if local.filter((F.floor(F.col("r") / tile) != 0) | (F.floor(F.col("c") / tile) != 0)).isEmpty():
        return local
    pr, pc = F.pmod(F.col("r"), F.lit(tile)), F.pmod(F.col("c"), F.lit(tile))
    rim = local.filter((pr == 0) | (pr == tile - 1) | (pc == 0) | (pc == tile - 1))
    steps = [(0, 1), (1, 0)] if connectivity == 4 else [(0, 1), (1, 0), (1, 1), (1, -1)]
    moves = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])
    sent = (
        rim.withColumn("_m", F.explode(moves))
        .withColumn("r2", F.col("r") + F.col("_m.dr"))
        .withColumn("c2", F.col("c") + F.col("_m.dc"))
        .filter(
            (F.floor(F.col("r2") / tile) != F.floor(F.col("r") / tile))
            | (F.floor(F.col("c2") / tile) != F.floor(F.col("c") / tile))
        )
        .select("site", F.col("r2").alias("r"), F.col("c2").alias("c"), F.col("label").alias("u"))
    )
    edges = (
        sent.join(rim.select("site", "r", "c", F.col("label").alias("v")), ["site", "r", "c"])
        .filter("u <> v").select("site", "u", "v").distinct()
    )
    edges = settle(edges)
    if edges.limit(1).count() == 0:
        return local
    roots = _reduce_graph(edges)
    return (
        local.join(roots, ["site", "label"], "left")
        .select("site", "r", "c", F.coalesce("root", "label").alias("label"))
    )


def _reduce_graph(edges: DataFrame) -> DataFrame:
    """Smallest label reachable from each label, as ``(site, label, root)``.

    Each round hangs every root under the smallest root it touches, shortens all
    paths by pointer jumping and keeps only edges between different roots.
    """
    both = edges.union(edges.select("site", F.col("v"), F.col("u"))).toDF("site", "u", "v")
    roots = settle(both.select("site", F.col("u").alias("label")).distinct().withColumn("root", F.col("label")))
    live = both
    while True:
        hang = live.groupBy("site", "u").agg(F.min("v").alias("v")).filter("v < u")
        hang = settle(hang)
        if hang.limit(1).count() == 0:
            return roots
        while True:
            onward = hang.select("site", F.col("u").alias("v"), F.col("v").alias("v2"))
            jumped = settle(hang.join(onward, ["site", "v"], "left").select("site", "u", F.coalesce("v2", "v").alias("v"), F.col("v2").isNotNull().alias("moved")))
            hang = jumped.select("site", "u", "v")
            if jumped.filter("moved").limit(1).count() == 0:
                break
        up = hang.select("site", F.col("u").alias("root"), F.col("v").alias("_up"))
        roots = settle(roots.join(up, ["site", "root"], "left").select("site", "label", F.coalesce("_up", "root").alias("root")))
        a = hang.select("site", F.col("u"), F.col("v").alias("_a"))
        b = hang.select("site", F.col("u").alias("v"), F.col("v").alias("_b"))
        live = settle(
            live.join(a, ["site", "u"], "left").join(b, ["site", "v"], "left")
            .select("site", F.coalesce("_a", "u").alias("u"), F.coalesce("_b", "v").alias("v"))
            .filter("u <> v").distinct()
        )


def connected_components(mask: DataFrame, min_size: int = MIN_REGION, tile: int = TILE) -> DataFrame:
    """4-connected regions of at least ``min_size`` cells; a site where no region
    is that large keeps all of them.  Adds ``label`` and ``size``."""
    labelled = label_regions(mask, 4, tile)
    sizes = labelled.groupBy("site", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("site").agg(F.max("size").alias("_largest"))
    kept = attach(sizes, largest, ["site"]).filter((F.col("size") >= min_size) | (F.col("_largest") < min_size))
    # One region may hold a third of all cells: sizes are attached, not co-shuffled.
    return attach(labelled, kept.drop("_largest"), ["site", "label"])


def flood_fill_below(df: DataFrame, seeds: DataFrame, level: float, value: str = "z", tile: int = TILE) -> DataFrame:
    """Depth ``level - z`` of the cells below ``level`` that are 8-connected to the
    site's seed cell; ``seeds`` has one row ``(site, r, c)`` per site."""
    low = df.filter(F.col(value) < level).select("site", "r", "c", F.col(value).alias("_z"))
    labelled = label_regions(low, 8, tile)
    wanted = labelled.join(seeds.select("site", "r", "c"), ["site", "r", "c"]).select("site", "label")
    lake = attach(labelled, wanted, ["site", "label"])
    return lake.join(low, ["site", "r", "c"]).select("site", "r", "c", (F.lit(float(level)) - F.col("_z")).alias("depth"))
