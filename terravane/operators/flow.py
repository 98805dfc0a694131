"""Flow routing: D8 receivers and flow accumulation.

Accumulation works on square tiles.  One pass over the tiles reduces each to its
rim: for every rim cell the end of its path inside the tile.  The paths that
leave tiles form a small graph (about 4 / tile of the cells) that pointer doubling
over the exits still under way sums up in log2(path length) rounds; a second pass over the tiles adds the inflow.
The whole grid is shuffled twice, however long the rivers are.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators.lines import neighbours
from terravane.session import settle

TILE = 256


def d8_receiver(df: DataFrame, value: str = "z") -> DataFrame:
    """Add ``rr, rc``: the lowest of the 8 neighbours if strictly lower, else NULL.

    Ties go to the first of NW, N, NE, W, E, SW, S, SE.
    """
    across = neighbours(df, "c", [value])
    packed = (
        across.withColumn("_w", F.col(f"_prev.{value}"))
        .withColumn("_e", F.col(f"_next.{value}"))
        .drop("_prev", "_next")
    )
    full = neighbours(packed, "r", ["_w", value, "_e"])
    spots = [
        ("_prev._w", -1, -1), (f"_prev.{value}", -1, 0), ("_prev._e", -1, 1),
        ("_w", 0, -1), ("_e", 0, 1),
        ("_next._w", 1, -1), (f"_next.{value}", 1, 0), ("_next._e", 1, 1),
    ]
    options = F.array(*[
        F.struct(F.col(name).alias("z"), F.lit(i).alias("i"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
        for i, (name, dr, dc) in enumerate(spots)
    ])
    lower = F.filter(options, lambda o: o["z"] < F.col(value))
    best = F.array_min(lower)
    return (
        full.withColumn("_best", best)
        .withColumn("rr", F.col("r") + F.col("_best.dr"))
        .withColumn("rc", F.col("c") + F.col("_best.dc"))
        .drop("_best", "_w", "_e", "_prev", "_next")
    )


def _local_pointers(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat index of each cell, local receiver index or -1, and the lookup grid."""
    r0, c0 = pdf["r"].min(), pdf["c"].min()
    shape = (int(pdf["r"].max() - r0 + 1), int(pdf["c"].max() - c0 + 1))
    grid = np.full(shape, -1)
    grid[pdf["r"] - r0, pdf["c"] - c0] = np.arange(len(pdf))
    rr = pdf["rr"].to_numpy("float64", na_value=np.nan) - r0
    rc = pdf["rc"].to_numpy("float64", na_value=np.nan) - c0
    inside = (rr >= 0) & (rr < shape[0]) & (rc >= 0) & (rc < shape[1])
    ptr = np.full(len(pdf), -1)
    ptr[inside] = grid[rr[inside].astype(int), rc[inside].astype(int)]
    return ptr, inside, grid


def _accumulate(ptr: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of weights over everything that flows into each cell (itself included)."""
    total, jump = weight.astype("float64").copy(), ptr.copy()
    while (live := np.flatnonzero(jump >= 0)).size:
        added = np.bincount(jump[live], weights=total[live], minlength=len(total))
        nxt = np.full_like(jump, -1)
        nxt[live] = jump[jump[live]]
        total, jump = total + added, nxt
    return total


def _path_ends(ptr: np.ndarray) -> np.ndarray:
    end = np.where(ptr >= 0, ptr, np.arange(len(ptr)))
    while not np.array_equal(end, nxt := end[end]):
        end = nxt
    return end


def flow_accumulation(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells ``(site, r, c, rr, rc)`` -> ``(site, r, c, acc)``: the number of cells
    draining through each cell, itself included."""
    site_type = df.schema["site"].dataType.simpleString()
    cells = settle(
        df.select("site", "r", "c", "rr", "rc")
        .withColumn("tr", F.floor(F.col("r") / tile).cast("int"))
        .withColumn("tc", F.floor(F.col("c") / tile).cast("int"))
    )

    def rim(pdf: pd.DataFrame) -> pd.DataFrame:
        ptr, _, _ = _local_pointers(pdf)
        acc, end = _accumulate(ptr, np.ones(len(pdf))), _path_ends(ptr)
        r, c = pdf["r"] % tile, pdf["c"] % tile
        on_rim = ((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)).to_numpy()
        leaves = pdf["rr"].notna().to_numpy() & (ptr < 0)
        at = np.flatnonzero(on_rim)
        e = end[at]
        return pd.DataFrame({
            "site": pdf["site"].to_numpy()[at], "r": pdf["r"].to_numpy()[at], "c": pdf["c"].to_numpy()[at],
            "er": pdf["r"].to_numpy()[e], "ec": pdf["c"].to_numpy()[e],
            "leaves": leaves[e], "rr": pdf["rr"].to_numpy()[at], "rc": pdf["rc"].to_numpy()[at],
            "is_exit": leaves[at], "w": acc[at],
        })

    schema = (
        f"site {site_type}, r int, c int, er int, ec int, leaves boolean, "
        "rr double, rc double, is_exit boolean, w double"
    )
    leaving = (F.floor(F.col("rr") / tile) != F.col("tr")) | (F.floor(F.col("rc") / tile) != F.col("tc"))
    crossing = cells.filter(leaving)
    if crossing.limit(1).count() == 0:
        inflow = crossing.select("site", F.col("rr").alias("r"), F.col("rc").alias("c"), F.lit(0.0).alias("inflow"))
    else:
        rims = settle(cells.groupBy("site", "tr", "tc").applyInPandas(rim, schema))
        exits = rims.filter("is_exit").select(
            "site", "r", "c", F.col("rr").cast("int").alias("rr"), F.col("rc").cast("int").alias("rc"), "w"
        )
        totals = _sum_paths(exits, rims)
        inflow = totals.groupBy("site", F.col("rr").alias("r"), F.col("rc").alias("c")).agg(F.sum("w").alias("inflow"))
    inflow = inflow.withColumn("tr", F.floor(F.col("r") / tile).cast("int")).withColumn(
        "tc", F.floor(F.col("c") / tile).cast("int")
    )

    def final(pdf: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        ptr, _, grid = _local_pointers(pdf)
        weight = np.ones(len(pdf))
        if len(extra):
            weight[grid[extra["r"] - pdf["r"].min(), extra["c"] - pdf["c"].min()]] += extra["inflow"].to_numpy()
        return pdf[["site", "r", "c"]].assign(acc=_accumulate(ptr, weight))

    return (
        cells.groupBy("site", "tr", "tc")
        .cogroup(inflow.groupBy("site", "tr", "tc"))
        .applyInPandas(final, f"site {site_type}, r int, c int, acc double")
    )


def _sum_paths(exits: DataFrame, rims: DataFrame, live_rows: list[int] | None = None) -> DataFrame:
    """Exits with ``w`` raised by everything upstream: pointer doubling over the live exits only.

    An exit is live while a later exit lies ahead of it.  Each round a live exit adds its sum to the exit its pointer leads to and
    takes over that one's pointer; one whose pointer leads to no live exit has told all and is dropped.  So what is joined
    shrinks each round and has no missing keys; the sums told in a round are kept apart and added once at the end.  At distance d at
    most about 8 d exits share one receiver, so no key of these joins grows with the table.

    ``live_rows``, if given, receives the number of live exits of every round.
    """
    ends = rims.filter("leaves").select(
        "site", F.col("r").alias("rr"), F.col("c").alias("rc"), F.col("er").alias("nr"), F.col("ec").alias("nc"))
    live = settle(exits.join(ends, ["site", "rr", "rc"]).select("site", "r", "c", "w", "nr", "nc"))
    told = [exits.select("site", "r", "c", "w")]
    while True:
        rows = live.count()
        if live_rows is not None:
            live_rows.append(rows)
        if not rows:
            break
        gain = settle(live.groupBy("site", F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.sum("w").alias("w")))
        told.append(gain)
        onward = live.select("site", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("nr").alias("_nr"), F.col("nc").alias("_nc"))
        live = settle(
            live.join(onward, ["site", "nr", "nc"]).join(gain.withColumnRenamed("w", "_gain"), ["site", "r", "c"], "left")
            .select("site", "r", "c", (F.col("w") + F.coalesce("_gain", F.lit(0.0))).alias("w"), F.col("_nr").alias("nr"), F.col("_nc").alias("nc"))
        )
    if len(told) == 1:
        return exits
    sums = functools.reduce(DataFrame.unionByName, told).groupBy("site", "r", "c").agg(F.sum("w").alias("w"))
    return exits.drop("w").join(sums, ["site", "r", "c"])
