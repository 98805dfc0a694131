"""Feature preparation: encoding, transforms, imputation, scaling, blocks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.joins import attach, attach_single
from terravane.operators.ranks import medians, melt
from terravane.operators.sampling import FEATURES, finite

# Landcover classes of the indicators and the skewed features.
LANDCOVER_CLASSES = [10, 20, 30, 40, 50, 60, 80, 90, 95]
LOG_FEATURES = ["rusle_soil_loss", "twi", "dist_to_stream", "avaflow_depth", "avaflow_velocity"]
META = ["label", "row", "col", "site", "site_id"]
BLOCKS = 5


def one_hot(df: DataFrame, classes: Sequence[int] = tuple(LANDCOVER_CLASSES), source: str = "landcover") -> DataFrame:
    return df.withColumns(
        {f"{source}_{k}": F.coalesce((F.col(source) == k).cast("double"), F.lit(0.0)) for k in classes}
    ).drop(source)


def log1p_clip(df: DataFrame, features: Sequence[str] = tuple(LOG_FEATURES)) -> DataFrame:
    """log(1 + max(x, 0)) on the skewed features present."""
    have = [f for f in features if f in df.columns]
    return df.withColumns(
        {f: F.when(F.col(f).isNotNull(), F.log1p(F.greatest(F.col(f).cast("double"), F.lit(0.0)))) for f in have}
    )


def fit_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the exact median of the finite values of each feature."""
    return medians(df.select(*[finite(F.col(f)).alias(f) for f in features]), [], features)


def apply_medians(df: DataFrame, med: DataFrame, features: Sequence[str]) -> DataFrame:
    named = med.select(*[F.col(f).alias(f"_m_{f}") for f in features])
    return attach_single(df, named).withColumns(
        {f: F.coalesce(finite(F.col(f)), F.col(f"_m_{f}")) for f in features}
    ).drop(*[f"_m_{f}" for f in features])


def impute_inf_median(df: DataFrame, features: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    """Infinite, NaN and NULL -> median.  ``fitted`` medians come from training;
    without them the medians of ``df`` itself are used."""
    return apply_medians(df, fitted if fitted is not None else fit_medians(df, features), features)


def fit_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation (0 counts as 1) per feature.

    Aggregated in long form: two aggregates over (feature, value) compile to tight
    code, two per feature in one wide aggregate do not.
    """
    stats = melt(df, [], features).groupBy("k").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    pick = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    wide = stats.agg(
        *[pick(i, "mean").alias(f"{f}__mean") for i, f in enumerate(features)],
        *[pick(i, "sd").alias(f"{f}__sd") for i, f in enumerate(features)],
    )
    return wide.withColumns({f"{f}__sd": F.when(F.col(f"{f}__sd") > 0, F.col(f"{f}__sd")).otherwise(F.lit(1.0)) for f in features})


def standard_scale(df: DataFrame, features: Sequence[str], scaler: DataFrame | None = None) -> DataFrame:
    fit = scaler if scaler is not None else fit_scaler(df, features)
    return attach_single(df, fit).withColumns(
        {f: (F.col(f) - F.col(f"{f}__mean")) / F.col(f"{f}__sd") for f in features}
    ).drop(*[f"{f}__{k}" for f in features for k in ("mean", "sd")])


def split_features(df: DataFrame) -> list[str]:
    """Names of the feature columns, in table order."""
    return [c for c in df.columns if c not in META]


def model_features(classes: Sequence[int] = tuple(LANDCOVER_CLASSES)) -> list[str]:
    """The ordered model inputs: 18 continuous features and the indicators."""
    return [f for f in FEATURES if f != "landcover"] + [f"landcover_{k}" for k in classes]


def align_by_name(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add absent model inputs as 0; order is by name, never by position."""
    return df.withColumns({f: F.lit(0.0) for f in features if f not in df.columns}) if any(
        f not in df.columns for f in features) else df


def spatial_blocks(df: DataFrame, n: int = BLOCKS, row: str = "row", col: str = "col") -> DataFrame:
    """Add ``block``: cell of an n x n grid over the extent of all samples."""
    ext = df.agg(F.min(row).alias("_r0"), F.max(row).alias("_r1"), F.min(col).alias("_c0"), F.max(col).alias("_c1"))

    def part(x: str, lo: str, hi: str) -> Column:
        span = F.greatest(F.col(hi) - F.col(lo), F.lit(1))
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), ((F.col(x) - F.col(lo)) / span * n).cast("int")))

    out = attach_single(df, ext)
    return out.withColumn("block", part(row, "_r0", "_r1") * n + part(col, "_c0", "_c1")).drop("_r0", "_r1", "_c0", "_c1")


def group_folds(df: DataFrame, k: int = 5, group: str = "block") -> DataFrame:
    """Add ``fold``: whole groups, the largest first to the lightest fold.

    Only the group sizes meet in one task (at most n x n blocks).  ``k`` is cut to
    the number of groups.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_g", F.lit(0))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        load = [0] * min(k, len(pdf))
        out = {}
        for row in pdf.sort_values(["n", group], ascending=[False, True]).itertuples():
            lightest = load.index(min(load))
            load[lightest] += row.n
            out[getattr(row, group)] = lightest
        return pd.DataFrame({group: list(out), "fold": list(out.values())})

    kind = df.schema[group].dataType.simpleString()
    folds = sizes.groupBy("_g").applyInPandas(assign, f"{group} {kind}, fold int")
    return attach(df, folds, [group])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: negatives per positive and the balanced weight of both classes."""
    pos, neg = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg")).select(
        "n_pos", "n_neg",
        (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("pos_weight"),
        F.when(F.col("n_pos") > 0, (F.col("n_pos") + F.col("n_neg")) / (F.col("n_pos") * 2)).alias("balanced_pos"),
        F.when(F.col("n_neg") > 0, (F.col("n_pos") + F.col("n_neg")) / (F.col("n_neg") * 2)).alias("balanced_neg"),
    )


def with_class_weight(df: DataFrame, kind: str = "balanced", label: str = "label") -> DataFrame:
    """Add ``weight``: 'balanced' weighs both classes equally, 'positive' puts
    the ratio of negatives on the positives."""
    w = attach_single(df, class_weights(df, label).drop("n_pos", "n_neg"))
    if kind == "balanced":
        value = F.when(F.col(label) == 1, F.col("balanced_pos")).otherwise(F.col("balanced_neg"))
    else:
        value = F.when(F.col(label) == 1, F.col("pos_weight")).otherwise(F.lit(1.0))
    return w.withColumn("weight", value).drop("pos_weight", "balanced_pos", "balanced_neg")
