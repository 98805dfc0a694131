"""Repeatable stratified sampling of training cells.

The random order of cells is the MD5 of seed and cell key, so a sample depends
neither on partitioning nor on retries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.joins import BROADCAST_ROWS, attach, top_n
from terravane.operators.ranks import medians, quantiles
from terravane.session import settle

# Ordered feature bands of the stack (fixed values: the models' contract).
FEATURES = [
    "elevation", "slope", "aspect", "plan_curvature", "profile_curvature", "twi", "dist_to_stream",
    "soil_depth", "cohesion", "phi", "k_factor", "c_factor", "r_factor", "manning_n",
    "rusle_soil_loss", "factor_of_safety", "avaflow_depth", "avaflow_velocity", "landcover",
]
STRATA = 10
OPEN_LOW, OPEN_HIGH = -999.0, 999.0


def draw(seed: int) -> Column:
    """Pseudo-random order key of a cell."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("site").cast("string"), F.col("r").cast("string"), F.col("c").cast("string")))


def sample_n(df: DataFrame, n: int, seed: int, by: Sequence[str] = ("site",)) -> DataFrame:
    """``n`` rows per group without replacement, all rows of smaller groups."""
    return top_n(df.withColumn("_draw", draw(seed)), by, ["_draw"], n).drop("_draw", "rn")


def quantile_edges(positives: DataFrame, value: str = "slope", strata: int = STRATA) -> DataFrame:
    """Per site ``edges``: quantiles of the positives with open ends."""
    q = quantiles(positives, ["site"], value, [i / strata for i in range(strata + 1)], "_q")
    # Nine decimals, so that a value equal to an interpolated edge falls above it.
    inner = F.transform(F.slice("_q", 2, strata - 1), lambda e: F.round(e, 9))
    return q.select("site", F.concat(F.array(F.lit(OPEN_LOW)), inner, F.array(F.lit(OPEN_HIGH))).alias("edges"))


def digitize(value: Column, edges: Column) -> Column:
    """Bin number: edges at or below the value, minus one."""
    return F.aggregate(edges, F.lit(0), lambda n, e: n + (value >= e).cast("int")) - 1


def stratified_sample(candidates: DataFrame, positives: DataFrame, n: int, seed: int, value: str = "slope", pool: DataFrame | None = None) -> DataFrame:
    """Negatives in the slope proportions of the positives: ``int(share * n)`` per
    bin as far as the bin has cells.  ``n`` is cut to the site's candidates, or to
    the rows of ``pool`` where candidates without a value count too.

    Both inputs are read several times and are therefore settled first.
    """
    positives, candidates = settle(positives), settle(candidates)
    edges = settle(quantile_edges(positives, value))
    counts = (
        attach(positives.select("site", value), edges, ["site"])
        .groupBy("site", digitize(F.col(value), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("_k"))
    )
    total = counts.groupBy("site").agg(F.sum("_k").alias("_all"))
    available = (candidates if pool is None else pool).groupBy("site").agg(F.count(F.lit(1)).alias("_m"))
    targets = (
        counts.join(total, "site").join(available, "site")
        .select("site", "bin", F.floor(F.col("_k") / F.greatest(F.col("_all"), F.lit(1)) * F.least(F.lit(n), F.col("_m"))).alias("_target"))
    )
    binned = attach(candidates, edges, ["site"]).withColumn("bin", digitize(F.col(value), F.col("edges"))).drop("edges")
    wanted = attach(binned.withColumn("_draw", draw(seed)), targets, ["site", "bin"])
    return top_n(wanted, ["site", "bin"], ["_draw"], n).filter("rn <= _target").drop("_draw", "_target", "rn")


def top_up(sampled: DataFrame, candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """Fill each site's sample up to ``n`` (or all candidates) from the rest."""
    key = ["site", "r", "c"]
    sampled, candidates = settle(sampled), settle(candidates)
    rest = candidates.join(sampled.select(*key), key, "left_anti")
    got = sampled.groupBy("site").agg(F.count(F.lit(1)).alias("_got"))
    extra = top_n(rest.withColumn("_draw", draw(seed)), ["site"], ["_draw"], n)
    extra = attach(extra, got, ["site"], "left").filter(F.col("rn") <= F.lit(n) - F.coalesce("_got", F.lit(0)))
    cols = candidates.columns
    return sampled.select(*cols).unionByName(extra.select(*cols))


def training_frame(sample: DataFrame, stack: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """``site, row, col, label`` and the ordered features; absent features are 0.

    The drawn cells are settled and counted: up to :data:`BROADCAST_ROWS` of them go to the stack, which is not shuffled.
    """
    have = [f for f in features if f in stack.columns]
    drawn = settle(sample.select("site", "r", "c", "label"))
    few = drawn.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = stack.select("site", "r", "c", *have).join(F.broadcast(drawn) if few else drawn, ["site", "r", "c"])
    return joined.select(
        "site", F.col("r").alias("row"), F.col("c").alias("col"), F.col("label").cast("int").alias("label"),
        *[F.col(f).cast("double").alias(f) if f in have else F.lit(0.0).alias(f) for f in features],
    )


def finite(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def impute_median(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("site",)) -> DataFrame:
    """Non-finite -> exact median of the finite values, 0 where there are none."""
    clean = df.withColumns({f: finite(F.col(f)) for f in features})
    med = medians(clean, by, features).withColumnsRenamed({f: f"_m_{f}" for f in features})
    return attach(clean, med, by, "left").withColumns(
        {f: F.coalesce(F.col(f), F.col(f"_m_{f}"), F.lit(0.0)) for f in features}
    ).drop(*[f"_m_{f}" for f in features])


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and sample deviation per feature (one wide pass)."""
    fns: Mapping = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    wide = df.agg(*[fn(f).alias(f"{f}__{k}") for f in features for k, fn in fns.items()])
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{k}").alias(k) for k in fns]) for f in features
    ])
    return wide.select(F.inline(rows))


def merge_sites(frames: Sequence[DataFrame], site_order: DataFrame | None = None) -> DataFrame:
    """Union of training frames with ``site_id``, the position of the site in
    ``site_order`` (``site, site_id``)."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f)
    if site_order is None:
        return merged
    return attach(merged, site_order.select("site", "site_id"), ["site"], "left")


def class_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").cast("long").alias("positive"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("negative"),
        F.countDistinct("site").alias("sites"),
    )


def site_sample_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").cast("long").alias("positive"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("negative"),
    )
