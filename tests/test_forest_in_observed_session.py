"""A forest must travel to the tasks whatever its session was used for before."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from terravane.operators import models


def test_forest_scores_in_a_session_that_observed_rows(spark):
    cells = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 > 9).cast("int").alias("label"))
    seen = Observation()
    cells.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 400
    model = models.fit(models.random_forest(["x"], numTrees=3, maxDepth=2, minInstancesPerNode=1), cells)
    scored = models.probability(model, cells)
    assert scored.filter("(label = 1) <> (p > 0.5)").count() == 0
    assert models.feature_importance(model, ["x"], spark).head().importance == 1.0
