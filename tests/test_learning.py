import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.operators import features, metrics, models, risk, sampling


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 600
    pdf = pd.DataFrame({"site": rng.integers(0, 2, n), "row": rng.integers(0, 40, n), "col": rng.integers(0, 40, n)})
    for f in sampling.FEATURES:
        pdf[f] = rng.random(n)
    pdf["landcover"] = rng.choice([10, 20, 70, 95], n).astype(float)
    pdf["label"] = (pdf.slope + 0.2 * rng.random(n) > 0.6).astype(int)
    return spark.createDataFrame(pdf).withColumn("r", F.col("row")).withColumn("c", F.col("col"))


def test_folds_keep_blocks_whole_and_balanced(table):
    f = features.group_folds(features.spatial_blocks(table), 5)
    assert f.groupBy("block").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 600 and max(sizes) - min(sizes) < 60


def test_forest_learns_scores_and_round_trips(spark, table, tmp_path):
    names = features.model_features()
    ready, fitted = models.prepare(table)
    model = models.fit(models.random_forest(names, numTrees=10, maxDepth=4), ready)
    scored = models.score_cells(model, table.withColumn("twi", F.when(F.col("row") == 3, float("nan")).otherwise(F.col("twi"))),
                                names, sampling.FEATURES, fitted, keys=("row", "label"))
    assert scored.filter("(row = 3) <> (p = -9999)").count() == 0
    assert metrics.auc(scored.filter("p >= 0"), y="label").head()[0] > 0.9
    models.save_model(model, fitted, str(tmp_path))
    loaded, stored = models.load_model(spark, str(tmp_path))
    again = models.score_cells(loaded, table.drop("phi"), names, sampling.FEATURES, stored, keys=("row",))
    assert again.filter("p < 0").count() == 0
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "none"))
    top = models.feature_importance(model, names, spark, 3).collect()
    assert [r.rank for r in top] == [1, 2, 3] and top[0].feature == "slope"


def test_single_class_fold_scores_zero(table):
    names = features.model_features()
    ready, _ = models.prepare(table)
    data = ready.withColumn("fold", F.when(F.col("label") == 1, 0).otherwise(1))
    out = models.cross_validate(data, lambda: models.random_forest(names, numTrees=2, maxDepth=2), 2)
    assert out.agg(F.max("p")).head()[0] == 0.0
    m = {r.fold: r for r in metrics.fold_metrics(out, y="label").collect()}
    assert m[0].auc == 0.5 and m[0].f1 == 0.0 and m[0].n_train == m[1].n_test


def test_sample_is_repeatable_and_stratified(spark):
    cells = spark.range(4000).select((F.col("id") % 2).cast("int").alias("site"), F.floor(F.col("id") / 80).cast("int").alias("r"),
                                     (F.col("id") % 80).cast("int").alias("c"), (F.col("id") % 45).cast("double").alias("slope"))
    pos, neg = cells.filter("slope < 9 AND r < 10"), cells.filter("r >= 10")
    a = sampling.stratified_sample(neg, pos, 100, 1)
    b = sampling.stratified_sample(neg.repartition(16), pos.repartition(3), 100, 1)
    key = lambda d: sorted((r.site, r.r, r.c) for r in d.select("site", "r", "c").collect())
    assert key(a) == key(b)
    full = sampling.top_up(a, neg, 100, 1)
    assert {r["count"] for r in full.groupBy("site").count().collect()} == {100}
    assert full.select("site", "r", "c").distinct().count() == 200
    assert full.join(a.select("site", "r", "c"), ["site", "r", "c"]).count() == a.count()


def test_quantile_classes_with_ties_and_empty_site(spark):
    df = spark.createDataFrame([(0, i, 0, 0.5) for i in range(5)] + [(0, 9, 0, -9999.0), (1, 0, 0, -9999.0)], "site int, r int, c int, p double")
    got = {(r.site, r.r): r.risk_class for r in risk.quantile_classes(df).collect()}
    assert all(got[(0, i)] == 1 for i in range(5)) and got[(0, 9)] == 0 and got[(1, 0)] == 0
    scores = {r.site: (r.score, r.confidence) for r in risk.site_scores(df).collect()}
    assert scores[1] == (0.0, 0.0) and scores[0][0] == pytest.approx(100 * (0.15 + 0.1))


def test_medians_fitted_or_from_scored_data(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    new = spark.createDataFrame([(None,), (10.0,), (float("inf"),)], "a double")
    fitted = features.fit_medians(train, ["a"])
    assert sorted(r.a for r in features.impute_inf_median(new, ["a"], fitted).collect()) == [2.0, 2.0, 10.0]
    assert sorted(r.a for r in features.impute_inf_median(new, ["a"]).collect()) == [10.0, 10.0, 10.0]
