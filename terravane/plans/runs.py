"""Many sites in one job with the broken ones set aside: which cells fail, which sites fail and why, and the features of the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terravane.operators.joins import attach
from terravane.operators.terrain import number
from terravane.plans import flows
from terravane.session import settle

KEY = ["site", "r", "c"]
NUMBERS = ("sand_raw", "silt_raw", "clay_raw", "soc_raw", "landcover")


def numeric(value: Column, kind: str = "double") -> Column:
    """The value as a number, NULL where it is none; never an error."""
    return value.try_cast(kind)


def unreadable(value: Column) -> Column:
    """A value stands there, but it is no finite number."""
    n = numeric(value)
    return value.isNotNull() & (n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")))


def checked_cells(dem: DataFrame, layers: DataFrame, dx, dy, numbers: Sequence[str] = NUMBERS) -> DataFrame:
    """Every cell of both tables once: ``site, r, c, z``, the layers as numbers, ``rows`` and ``reason`` (NULL for a good cell).

    ``dem``: site, r, c, z; ``layers``: site, r, c and ``numbers``.  Values may be texts.  ``dx, dy`` are metres: numbers, or Columns of the
    key.  Reasons, the first that holds: the place is missing or negative, the cell is there twice, it has no elevation row, no layer row,
    an elevation or a layer that is no number, a step that is not positive.  NULL elevations and layers are gaps, not faults.
    """
    has = [n for n in numbers if n in layers.columns]
    d = dem.select(*KEY, F.struct("z").alias("_d")).groupBy(*KEY).agg(F.first("_d").alias("_d"), F.count(F.lit(1)).alias("_nd"))
    l = layers.select(*KEY, F.struct(*has).alias("_l")).groupBy(*KEY).agg(F.first("_l").alias("_l"), F.count(F.lit(1)).alias("_nl"))  # noqa: E741
    # NULL keys must meet too, or such a cell would count as two.
    same = F.col("d.site").eqNullSafe(F.col("l.site")) & F.col("d.r").eqNullSafe(F.col("l.r")) & F.col("d.c").eqNullSafe(F.col("l.c"))
    both = d.alias("d").join(l.alias("l"), same, "full").select(*[F.coalesce(f"d.{k}", f"l.{k}").alias(k) for k in KEY], "_d", "_nd", "_l", "_nl")
    bad_layers = [F.when(unreadable(F.col(f"_l.{n}")), F.lit(f"{n} is no number")) for n in has]
    bad_steps = [F.when(~F.coalesce(number(s) > 0, F.lit(False)), F.lit("cell size is not positive")) for s in (dx, dy)]
    reason = F.coalesce(
        F.when(F.col("site").isNull() | F.col("r").isNull() | F.col("c").isNull() | (F.col("r") < 0) | (F.col("c") < 0), F.lit("cell without a place")),
        F.when((F.col("_nd") > 1) | (F.col("_nl") > 1), F.lit("cell is there twice")),
        F.when(F.col("_nd").isNull(), F.lit("cell without elevation row")), F.when(F.col("_nl").isNull(), F.lit("cell without layer row")),
        F.when(unreadable(F.col("_d.z")), F.lit("elevation is no number")), *bad_layers, *bad_steps)
    return both.select(*KEY, numeric(F.col("_d.z")).alias("z"), *[numeric(F.col(f"_l.{n}")).alias(n) for n in has],
                       (F.coalesce("_nd", F.lit(0)) + F.coalesce("_nl", F.lit(0))).alias("rows"), reason.alias("reason"))


def site_status(cells: DataFrame) -> DataFrame:
    """``site, ok, reason, cells, bad_cells`` of checked cells.

    A site fails if a cell fails (``reason``: the most frequent one, then the first by name), if its grid has gaps, or if no cell has an elevation.
    """
    per = cells.groupBy("site", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count("z").alias("with_z"), *[f(k).alias(f"{n}_{k}") for k in ("r", "c") for n, f in (("lo", F.min), ("hi", F.max))])
    worst = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct(-F.col("n"), F.col("reason"))))
    site = per.groupBy("site").agg(
        F.sum("n").alias("cells"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("bad_cells"), worst.alias("_worst"),
        F.sum("with_z").alias("_z"), *[f(f"{n}_{k}").alias(f"{n}_{k}") for k in ("r", "c") for n, f in (("lo", F.min), ("hi", F.max))])
    area = (F.col("hi_r") - F.col("lo_r") + 1).cast("long") * (F.col("hi_c") - F.col("lo_c") + 1)
    reason = F.coalesce("_worst", F.when(F.col("cells") < area, F.lit("grid has gaps")), F.when(F.col("_z") == 0, F.lit("no cell has an elevation")))
    return site.select("site", reason.isNull().alias("ok"), reason.alias("reason"), "cells", "bad_cells")


def run_sites(dem: DataFrame, layers: DataFrame, dx, dy, numbers: Sequence[str] = NUMBERS) -> dict:
    """Features of all sites that can be computed, and what became of the others, in one job.

    Returns ``features`` (:func:`terravane.plans.flows.build_features` of the good sites), ``status`` (:func:`site_status`), ``quarantine`` (the failing
    cells with their reason) and ``seen`` (an Observation: rows read, cells, failing cells, counted while the cells are checked).
    """
    seen = Observation("cells of the run")
    cells = checked_cells(dem, layers, dx, dy, numbers).observe(
        seen, F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("cells"), F.count("reason").alias("failing"))
    cells = settle(cells)
    status = settle(site_status(cells))
    good = attach(cells, status.filter("ok").select("site"), ["site"]).drop("rows", "reason")
    has = [n for n in numbers if n in layers.columns]
    made = flows.build_features(good.select(*KEY, "z"), good.select(*KEY, *has), dx, dy)
    return {"features": made, "status": status, "quarantine": cells.filter("reason IS NOT NULL"), "seen": seen}
