"""Forests of a cross-validation share one dealt table: what is written must not grow with the folds."""

from pyspark.sql import functions as F

from terravane.operators import metrics, models


def test_folds_share_one_dealt_table(spark, monkeypatch):
    k = F.col("id")
    cells = spark.range(600).select(k, (k % 20).cast("double").alias("x"), (k % 20 > 9).cast("int").alias("label"), (k % 3).cast("int").alias("fold"))
    written = []
    settle = models.settle
    monkeypatch.setattr(models, "settle", lambda df: written.append(df.columns) or settle(df))
    out = models.cross_validate(cells, lambda: models.random_forest(["x"], numTrees=3, maxDepth=2, minInstancesPerNode=1), 3)
    assert len(written) == 2
    assert out.count() == 600 and out.select("id").distinct().count() == 600
    assert sorted(out.columns) == ["fold", "id", "label", "p", "x"]
    assert metrics.auc(out, ["fold"], y="label").filter("auc < 0.99").count() == 0
