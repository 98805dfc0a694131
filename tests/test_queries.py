"""Queries against their oracles on the smallest data, and the contract."""

import pytest

import __spark_entry__ as entry
from tools.verify import compare, oracle

SF = "/root/testdata/sf0.001"
CHECKED = [
    "s10_export_xyz", "g4_to_utm", "g6_align_bilinear", "g10_fill_nulls", "t3_curvatures", "t8_dist_to_stream", "t13_connected_components",
    "p12_factor_of_safety", "p21_break_classes", "c12_otsu_threshold", "l3_relax_if_empty", "m5_top_up", "h16_cv_summary",
    "r2_active_overlay", "r4_siltation_overlay", "w3_peak_rain", "w16_resolve_place", "y2_physics", "y4_predict",
]


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, con, name):
    result = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert result.startswith("ok"), result
    assert "TYPES" not in result, result


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
