"""Evaluation of scored cells ``(y, p[, fold])``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.ranks import running_sums

THRESHOLD = 0.5


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", threshold: float = THRESHOLD) -> DataFrame:
    hit = F.col(p) >= threshold

    def count(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0))

    aggs = [count((F.col(y) == 0) & ~hit).alias("tn"), count((F.col(y) == 0) & hit).alias("fp"),
            count((F.col(y) == 1) & ~hit).alias("fn"), count((F.col(y) == 1) & hit).alias("tp")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def binary_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy, precision, recall and F1 (0 where undefined) and ``n_test``."""
    m = confusion_matrix(df, by, y, p)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return m.select(
        *by, _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        _ratio(prec * rec * 2, prec + rec).alias("f1"), (tn + fp + fn + tp).alias("n_test"),
    )


def overall_metrics(df: DataFrame, fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """Metrics and AUC over the rows of all folds, in the columns of :func:`fold_metrics` with NULL as the fold."""
    one = df.withColumn("_whole", F.lit(1))
    m = binary_metrics(one, ["_whole"], y, p).join(auc(one, ["_whole"], y, p), "_whole").drop("_whole")
    return m.select(F.lit(None).cast(df.schema[fold].dataType).alias(fold), "*", F.lit(None).cast("long").alias("n_train"))


def fold_metrics(df: DataFrame, fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """Metrics and AUC per fold, with the size of the other folds as ``n_train``."""
    # One row per fold: the total is a sum over few rows.
    from pyspark.sql import Window as W

    m = binary_metrics(df, [fold], y, p).join(auc(df, [fold], y, p), fold)
    return m.withColumn("n_train", F.sum("n_test").over(W.partitionBy()) - F.col("n_test"))


def _sums(y: str) -> dict[str, Column]:
    return {"pos": (F.col(y) == 1).cast("long"), "neg": (F.col(y) == 0).cast("long")}


def auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve, ties counted half; 0.5 with a single class."""
    s = running_sums(df, by, p, _sums(y))
    below = F.col("all_neg") - F.col("cum_neg")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    pairs = F.first("all_pos") * F.first("all_neg")
    value = F.when(pairs > 0, area / pairs).otherwise(F.lit(0.5)).alias("auc")
    return s.groupBy(*by).agg(value) if by else s.agg(value)


def roc_points(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """False and true positive rate at every distinct score."""
    s = running_sums(df, by, p, _sums(y))
    return s.select(*by, F.col(p).alias("threshold"), _ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
                    _ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"))


def cv_summary(folds: DataFrame, model: str = "model") -> DataFrame:
    """Mean and population deviation of the fold AUC per model."""
    return folds.groupBy(model).agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def best_model(summary: DataFrame, model: str = "model") -> DataFrame:
    """The model with the highest mean AUC; ties go to the first name."""
    return summary.agg(F.min_by(model, F.struct(-F.col("mean_auc"), F.col(model))).alias("best"))
