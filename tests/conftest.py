import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from terravane.session import tune

    s = (
        SparkSession.builder.master("local[4]").appName("terravane-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield tune(s)
    s.stop()


@pytest.fixture
def grid(spark):
    """numpy array -> cell table of one site."""

    def build(z, site=0, name="z"):
        rows = [(site, r, c, None if z[r][c] != z[r][c] else float(z[r][c])) for r in range(len(z)) for c in range(len(z[0]))]
        return spark.createDataFrame(rows, f"site int, r int, c int, {name} double")

    return build
