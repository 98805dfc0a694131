"""Neighbour access along grid lines.

A grid line is cut into segments; a window works on one segment plus a halo of
the few cells before and after it.  So the largest window partition has
``SEGMENT`` + halo rows, whatever the shape of the site, and each pass costs one
shuffle of the table.  Grids are complete: a cell without a value is a row with
NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = 4096


def with_halo(df: DataFrame, axis: str, reach: int, segment: int) -> DataFrame:
    """Add ``_own`` (segment of the row) and ``_seg`` (a segment that sees it): a row
    appears once in every segment that ``reach`` touches, however many they are."""
    pos = F.col(axis)
    own = F.floor(pos / F.lit(segment))
    touched = F.sequence(F.floor((pos - reach) / F.lit(segment)), F.floor((pos + reach) / F.lit(segment)))
    return df.withColumn("_own", own).withColumn("_seg", F.explode(touched))


def _across(axis: str) -> str:
    return "c" if axis == "r" else "r"


def neighbours(
    df: DataFrame, axis: str, values: Sequence[str], by: Sequence[str] = ("site",), segment: int = SEGMENT
) -> DataFrame:
    """Add struct columns ``_prev`` and ``_next`` holding ``values`` of the
    adjacent cells on ``axis`` ('r' or 'c'); NULL where no such cell exists."""
    w = W.partitionBy(*by, _across(axis), "_seg").orderBy(axis)
    item = F.struct(F.col(axis).alias("_pos"), *[F.col(v) for v in values])
    tagged = with_halo(df, axis, 1, segment)
    prev, nxt = F.lag(item).over(w), F.lead(item).over(w)
    out = tagged.withColumn("_prev", prev).withColumn("_next", nxt).filter("_seg = _own")
    here = F.col(axis)
    return (
        out.withColumn("_prev", F.when(F.col("_prev._pos") == here - 1, F.col("_prev")))
        .withColumn("_next", F.when(F.col("_next._pos") == here + 1, F.col("_next")))
        .drop("_seg", "_own")
    )


def line_extreme(
    df: DataFrame, axis: str, reach: int, value: str, fn, by: Sequence[str] = ("site",), segment: int = SEGMENT
) -> DataFrame:
    """Replace ``value`` by ``fn`` (``F.max`` / ``F.min``) over the cells at
    most ``reach`` positions away on ``axis``."""
    w = W.partitionBy(*by, _across(axis), "_seg").orderBy(axis).rangeBetween(-reach, reach)
    return (
        with_halo(df, axis, reach, segment)
        .withColumn(value, fn(value).over(w))
        .filter("_seg = _own")
        .drop("_seg", "_own")
    )


def block(df: DataFrame, reach: int, values: Sequence[str], name: str = "near", by: Sequence[str] = ("site",),
          segment: int = SEGMENT) -> DataFrame:
    """Add array ``name`` of structs ``(dr, dc, values...)``: every existing cell
    of the square of side ``2 * reach + 1`` around each cell (gaps tolerated).

    Each cell is copied to the ``2 * reach + 1`` columns it can be seen from, and
    one window down each column collects them: one shuffle, no copy per offset pair.
    """
    if reach >= segment:
        raise ValueError("reach must be below the segment length")
    seen = df.withColumn("_dc", F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1)]))).withColumn(
        "_tc", F.col("c") + F.col("_dc")
    )
    w = W.partitionBy(*by, "_tc", "_seg").orderBy("r").rangeBetween(-reach, reach)
    item = F.struct(F.col("r").alias("r"), F.col("c").alias("c"), *[F.col(v).alias(v) for v in values])
    near = F.transform(
        "_items",
        lambda x: F.struct((x["r"] - F.col("r")).alias("dr"), (x["c"] - F.col("c")).alias("dc"), *[x[v].alias(v) for v in values]),
    )
    return (
        with_halo(seen, "r", reach, segment)
        .withColumn("_items", F.collect_list(item).over(w))
        .filter("_seg = _own AND _dc = 0")
        .withColumn(name, near)
        .drop("_seg", "_own", "_dc", "_tc", "_items")
    )
