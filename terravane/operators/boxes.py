"""Boxes of longitude and latitude: which boxes overlap, by covering cells of grids of growing size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = ("west", "south", "east", "north")
# Degrees of the finest cell; each level doubles it.  The last one is wider than the globe.
FINEST, LEVELS = 0.0625, 14


def level_of(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The finest level whose cells are at least as wide and high as the box, so that it touches at most four; NULL for no box."""
    side = F.greatest(east - west, north - south)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.when(side > 0, side) / FINEST))).cast("int")
    return F.when((west < east) & (south < north), F.least(level, F.lit(LEVELS - 1)))


def _cells(df: DataFrame, levels: Column) -> DataFrame:
    """A row per level and touched cell: at most four a level."""
    size = F.lit(FINEST) * F.pow(F.lit(2.0), F.col("level"))
    at = lambda x: F.floor(x / size).cast("long")
    return df.withColumn("level", F.explode(levels)).withColumn("cx", F.explode(F.sequence(at(F.col("west")), at(F.col("east"))))).withColumn(
        "cy", F.explode(F.sequence(at(F.col("south")), at(F.col("north")))))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of overlapping boxes: the columns of ``a`` and ``b`` as structs ``a`` and ``b``, and ``area`` of the overlap in square degrees.

    Both hold ``west, south, east, north``.  Two boxes meet at the level of the larger one: the smaller is written to the cells it touches
    on all coarser levels, the larger to those of its own level only, so no pair is looked at that does not share a cell of the larger one's
    size.  A pair is found in each cell they share and kept in the first.  Boxes without area, or with a missing edge, overlap nothing.
    """
    def sized(df: DataFrame) -> DataFrame:
        box = df.select(F.struct("*").alias("row"), *[F.col(e).cast("double").alias(e) for e in EDGES])
        return box.withColumn("own", level_of(*[F.col(e) for e in EDGES])).filter("own IS NOT NULL")

    x, y = sized(a), sized(b)
    own = F.array("own")
    from_own = F.sequence(F.col("own"), F.lit(LEVELS - 1))
    above = F.when(F.col("own") < LEVELS - 1, F.sequence(F.col("own") + 1, F.lit(LEVELS - 1)))

    def met(small: DataFrame, large: DataFrame) -> DataFrame:
        s, g = small.alias("s"), large.alias("g")
        same = (F.col("s.level") == F.col("g.level")) & (F.col("s.cx") == F.col("g.cx")) & (F.col("s.cy") == F.col("g.cy"))
        return s.join(g, same)

    def overlap(pairs: DataFrame, left: str, right: str) -> DataFrame:
        west, south = F.greatest("s.west", "g.west"), F.greatest("s.south", "g.south")
        east, north = F.least("s.east", "g.east"), F.least("s.north", "g.north")
        size = F.lit(FINEST) * F.pow(F.lit(2.0), F.col("s.level"))
        first = (F.floor(west / size) == F.col("s.cx")) & (F.floor(south / size) == F.col("s.cy"))
        return pairs.filter((west < east) & (south < north) & first).select(
            F.col(f"{left}.row").alias("a"), F.col(f"{right}.row").alias("b"), ((east - west) * (north - south)).alias("area"))

    a_small = overlap(met(_cells(x, from_own), _cells(y, own)), "s", "g")
    b_small = overlap(met(_cells(y, above), _cells(x, own)), "g", "s")
    return a_small.unionByName(b_small)


def site_of_box(boxes: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct boxes ``west, south, east, north`` with the ``site`` of the largest overlap (ties: the first site); without any, no row."""
    pairs = overlaps(boxes.select(*EDGES).distinct(), sites.select("site", *EDGES))
    best = pairs.select(*[F.col(f"a.{e}").alias(e) for e in EDGES], F.col("b.site").alias("site"), "area")
    area = best.groupBy(*EDGES, "site").agg(F.max("area").alias("area"))
    return area.groupBy(*EDGES).agg(F.min_by("site", F.struct(-F.col("area"), F.col("site"))).alias("site"))
