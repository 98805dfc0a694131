"""Session settings and materialisation helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# SQL settings the operators count on.  AQE re-plans joins from real sizes and
# splits hot join partitions even when that costs one more shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot does not compile methods above 8,000 bytes: wide feature projections
    # run faster as several small methods than as one whole-stage method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="terravane-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    Cuts the lineage of iterative operators; the files outlive executors.  A table
    that is settled already is returned as it is.
    """
    if getattr(df, "_settled", False):
        return df
    checkpoint_root(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._settled = True
    return out
