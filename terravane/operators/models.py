"""Tree ensembles: training, spatial cross-validation and scoring.  Forests are MLlib's, boosting is :mod:`terravane.operators.boosting`."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions.risk import NODATA
from terravane.operators import features as X
from terravane.operators.boosting import NewtonModel, Settings, fit_boosters
from terravane.session import checkpoint_root, settle

# The learners' defaults.
FOREST = {"numTrees": 500, "maxDepth": 20, "minInstancesPerNode": 10}
BOOSTING = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 8, "minChildWeight": 5.0, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
SEED = 42
ROWS_PER_PART = 200_000


def random_forest(features: Sequence[str], label: str = "label", weight: str | None = "weight", **params) -> Pipeline:
    tree = RandomForestClassifier(
        featuresCol="features", labelCol=label, seed=SEED, maxMemoryInMB=512, cacheNodeIds=True, **{**FOREST, **params})
    if weight:
        tree.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), tree])


@dataclass(frozen=True)
class Boosting:
    """Newton boosting that is still to be fitted."""

    features: list[str]
    label: str
    settings: Settings


# Parameters of boosting, named as those of the forest.
_SETTINGS = {"maxIter": "rounds", "stepSize": "rate", "maxDepth": "depth", "subsamplingRate": "rows", "featureSubsetStrategy": "columns",
             "minChildWeight": "child_weight", "regParam": "l2", "maxBins": "bins", "seed": "seed"}


def gradient_boosting(features: Sequence[str], label: str = "label", **params) -> Boosting:
    """Second-order boosting; ``params`` as in :data:`BOOSTING`, besides ``regParam``, ``maxBins`` and ``seed``."""
    given = {_SETTINGS[k]: v for k, v in {**BOOSTING, "seed": SEED, **params}.items()}
    return Boosting(list(features), label, Settings(**{**given, "columns": float(given["columns"])}))


def prepare(df: DataFrame, features: Sequence[str] | None = None, medians: DataFrame | None = None,
            scaler: DataFrame | None = None, refit_medians: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Encode, transform, impute and scale; returns the table and what was fitted.

    ``refit_medians`` imputes from the scored table even when ``medians`` is given.
    """
    inputs = list(features) if features else X.model_features()
    out = X.log1p_clip(X.one_hot(df))
    inputs = [f for f in inputs if f in out.columns]
    # The indicators are never missing, only the other inputs need a median.
    gaps = [f for f in inputs if not f.startswith("landcover_")]
    if medians is None or refit_medians:
        medians = settle(X.fit_medians(out, gaps))
    out = X.impute_inf_median(out, gaps, medians)
    if scaler is None:
        scaler = settle(X.fit_scaler(out, inputs))
    return X.standard_scale(out, inputs, scaler), {"medians": medians, "scaler": scaler}


def fit(pipeline: Pipeline | Boosting, train: DataFrame, weigh: str | None = "balanced", label: str = "label", dealt: bool = False) -> PipelineModel | NewtonModel:
    """Train on a materialised table, spread evenly: the learner reads it many times.  ``dealt`` says that ``train`` is such a table already.

    Boosting weighs events by the non-events per event, whichever ``weigh`` is given, or not at all.
    """
    if isinstance(pipeline, Boosting):
        return fit_boosters(train, pipeline.features, label, positive="balance" if weigh else 1.0, settings=pipeline.settings)[-1]
    columns = [*pipeline.getStages()[0].getInputCols(), label]
    data = train.select(*columns)
    if not dealt:
        data = _dealt(settle(data), columns)
    return _read_back(pipeline.fit(X.with_class_weight(data, weigh, label) if weigh else data), train.sparkSession)


def _dealt(data: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts of a size, not one per core, dealt by the rows' own values: a task run again gets the same rows."""
    parts = max(data.sparkSession.sparkContext.defaultParallelism, data.count() // ROWS_PER_PART)
    return settle(data.repartition(parts, *by))


def _read_back(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The same trees from files, without the summary of their training.

    A forest of two classes holds its session in the summary and takes both along to the tasks: once rows of the session were
    observed, the session cannot be serialised, and no task could score.
    """
    path = f"{checkpoint_root(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    return PipelineModel.load(path)


def probability(model: PipelineModel | NewtonModel, df: DataFrame, name: str = "p") -> DataFrame:
    """Add P(event); 0 if training saw a single class."""
    if isinstance(model, NewtonModel):
        return model.probability(df, name)
    scored = model.transform(df)
    # A model of one class has a single-column probability or gives class 0 all mass.
    p = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    return scored.withColumn(name, p).drop("features", "rawPrediction", "probability", "prediction")


def cross_validate(df: DataFrame, build: Callable[[], Pipeline], folds: int, fold: str = "fold", label: str = "label",
                   weigh: str | None = "balanced") -> DataFrame:
    """Out-of-fold probabilities: the driver loops over the few folds, each fit and
    transform is distributed.  Folds whose training part has one class score 0; with fewer
    groups than ``folds`` only the folds that were made are fitted."""
    return cross_fit(df, build, folds, fold, label, weigh, whole=False)[0]


def cross_fit(df: DataFrame, build: Callable[[], Pipeline | Boosting], folds: int, fold: str = "fold", label: str = "label", weigh: str | None = "balanced",
              whole: bool = True) -> tuple[DataFrame, PipelineModel | NewtonModel | None]:
    """:func:`cross_validate`, and the model over all rows.  Boosting fits all folds and that model in the same jobs."""
    learner = build()
    data = settle(df)
    parts = []
    made = [r[0] for r in data.select(fold).distinct().orderBy(fold).limit(folds + 1).collect()]
    if len(made) > folds:
        raise ValueError(f"more than {folds} folds in column {fold}")
    if not made:
        return data.withColumn("p", F.lit(0.0)), fit(learner, data, weigh, label) if whole else None
    if isinstance(learner, Boosting):
        # Folds may have any numbers: boosters count them from 0.
        number = F.array_position(F.array(*[F.lit(k) for k in made]), F.col(fold)).cast("int") - 1
        fitted = fit_boosters(data.withColumn("_booster", number), learner.features, label, "_booster", len(made), "balance" if weigh else 1.0, learner.settings)
        scored = [m.probability(data.filter(F.col(fold) == k), "p") for k, m in zip(made, fitted)]
        return functools.reduce(DataFrame.unionByName, scored), fitted[-1] if whole else None
    # Rows are dealt once for all folds: what a fold leaves out is missing evenly from all parts.
    columns = [*learner.getStages()[0].getInputCols(), label]
    rows = _dealt(data.select(*columns, F.col(fold).alias("_fold")), columns)
    for k in made:
        train, test = rows.filter(F.col("_fold") != k), data.filter(F.col(fold) == k)
        classes = train.select(label).distinct().limit(2).count()
        if classes < 2:
            parts.append(test.withColumn("p", F.lit(0.0)))
            continue
        model = fit(build(), train, weigh, label, dealt=True)
        parts.append(probability(model, test))
    return functools.reduce(DataFrame.unionByName, parts), fit(build(), rows, weigh, label, dealt=True) if whole else None


def feature_importance(model: PipelineModel | NewtonModel, features: Sequence[str], spark: SparkSession, top: int = 15, name: str = "model") -> DataFrame:
    """The ``top`` features by importance; the vector has one entry per feature."""
    values = model.importance() if isinstance(model, NewtonModel) else [float(x) for x in model.stages[-1].featureImportances.toArray()]
    ranked = sorted(zip(values, features), key=lambda t: (-t[0], t[1]))[:top]
    return spark.createDataFrame([(name, i + 1, f, v) for i, (v, f) in enumerate(ranked)],
                                 "model string, rank int, feature string, importance double")


def score_cells(model: PipelineModel | NewtonModel, stack: DataFrame, features: Sequence[str], raw: Sequence[str],
                fitted: dict[str, DataFrame] | None = None, refit_medians: bool = False, keys: Sequence[str] = ("site", "r", "c")) -> DataFrame:
    """P(event) for every cell, -9999 where any raw feature is not finite.

    Inputs the stack lacks are 0, and inputs are matched by name.
    """
    fitted = fitted or {}
    ok = F.lit(True)
    for f in raw:
        if f in stack.columns:
            ok = ok & X.finite(F.col(f)).isNotNull()
    flagged = stack.withColumn("_ok", ok)
    ready, _ = prepare(flagged, features, fitted.get("medians"), fitted.get("scaler"), refit_medians)
    ready = X.align_by_name(ready, features)
    ready = ready.withColumns({f: F.coalesce(X.finite(F.col(f)), F.lit(0.0)) for f in features})
    p = probability(model, ready)
    return p.select(*keys, F.when(F.col("_ok"), F.col("p")).otherwise(F.lit(NODATA)).alias("p"))


def save_model(model: PipelineModel | NewtonModel, fitted: dict[str, DataFrame], path: str) -> None:
    if isinstance(model, NewtonModel):
        model.save(SparkSession.active(), f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    for name, df in fitted.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | NewtonModel, dict[str, DataFrame]]:
    """A saved model with its fitted medians and scaler; missing is an error."""
    try:
        model = PipelineModel.load(f"{path}/model")
    except Exception:
        try:
            model = NewtonModel.load(spark, f"{path}/model")
        except Exception as e:
            raise FileNotFoundError(f"no saved model at {path}") from e
    return model, {k: spark.read.parquet(f"{path}/{k}") for k in ("medians", "scaler")}
