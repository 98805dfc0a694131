import pytest


@pytest.fixture
def alerts(spark):
    """Rows of (alert_id, description), with an extra column whose name the operators use inside."""

    def build(rows, more="word"):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], f"alert_id long, description string, {more} string")

    return build
