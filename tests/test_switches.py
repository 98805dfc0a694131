"""Branches that may only change the plan: both give the same rows."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terravane.operators import components, feeds, imagery, joins, ranks
from terravane.operators import terrain as T
from terravane.plans import flows


@pytest.mark.parametrize("hot", [2, 100_000])
def test_group_medians_do_not_depend_on_the_branch(spark, hot):
    nan = float("nan")
    rows = [(0, x) for x in (1.0, 2.0, 3.0, nan, nan)] + [(1, x) for x in (4.0, 4.0, None, 8.0)] + [(2, nan), (2, None), (2, nan)] + [(3, 5.0)]
    df = spark.createDataFrame(rows, "site int, v double")
    got = {r.site: r.v for r in ranks.group_medians(df, ["site"], {"v": F.col("v")}, hot_rows=hot).collect()}
    assert got == {0: 2.0, 1: 4.0, 2: None, 3: 5.0}


def test_rain_window_longer_than_a_segment(spark):
    hours = spark.range(0, 2600).select(F.lit(1).alias("station"), F.timestamp_seconds(F.col("id") * 3600).alias("hour"), F.lit(1.0).alias("rain_mm_h"))
    for length in (48, 1000, 1440):
        last = feeds.antecedent_rain(hours, hours=length).agg(F.max("rain_before")).first()[0]
        assert last == length


def test_regions_at_negative_indices(spark):
    cells = spark.createDataFrame([(0, r, 0) for r in (-1, 0, 1)] + [(0, 5, 5), (1, -7, -7)], "site int, r int, c int")
    got = components.label_regions(cells, tile=4).groupBy("site", "label").count().collect()
    assert sorted((r.site, r["count"]) for r in got) == [(0, 1), (0, 3), (1, 1)]


def test_statistics_of_several_rows_raise(spark):
    big = spark.range(3)
    one = spark.createDataFrame([(1.5,)], "m double")
    assert [r.m for r in joins.attach_single(big, one).collect()] == [1.5] * 3
    assert joins.attach_single(big, one.limit(0)).count() == 0
    with pytest.raises(PySparkException, match="expected one row"):
        joins.attach_single(big, one.unionByName(one)).collect()


def test_quantiles_of_values_in_one_bucket(spark):
    # All values within a thousandth of each other, many equal.
    rng = np.random.default_rng(7)
    values = 0.98 + rng.integers(0, 2000, 20_000) * 1e-8
    df = spark.createDataFrame([(0, float(x)) for x in values], "site int, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = ranks.quantiles(df, ["site"], "v", probs).first()
    assert np.allclose(got.q, np.quantile(values, probs), rtol=0, atol=1e-15) and got.n == len(values)


def test_row_distance_is_the_lower_envelope():
    rng = np.random.default_rng(0)
    for width in (1, 2, 9, 40):
        squares = np.where(rng.random((30, width)) < 0.25, rng.random((30, width)) * 200, np.inf)
        place = np.arange(width)
        want = np.min(squares[:, None, :] + (1.7 * (place[:, None] - place[None, :])[None]) ** 2, axis=2)
        got = T.row_distance(squares, 1.7)
        assert (np.isinf(got) == np.isinf(want)).all() and np.allclose(got[np.isfinite(want)], want[np.isfinite(want)])


def test_latest_reading_at_one_time(spark):
    rows = [(1, "2024-01-01 00:10:00", 3, 7.0), (1, "2024-01-01 00:10:00", 9, 1.0), (1, "2024-01-01 00:05:00", 20, 5.0)]
    df = spark.createDataFrame(rows, "dam_id int, ts string, event_id int, level double")
    for parts in (1, 3):
        assert feeds.refresh_window(df.repartition(parts), "dam_id", "ts", 60, "level", tie="event_id").first().level == 1.0


def test_fixed_threshold_for_an_empty_histogram(spark):
    found = spark.createDataFrame([(1, 2.5)], "site int, threshold double")
    sites = spark.createDataFrame([(1,), (2,)], "site int")
    assert {r.site: r.threshold for r in imagery.complete_thresholds(found, sites, 3.0).collect()} == {1: 2.5, 2: 3.0}


def test_prediction_keeps_every_request(spark):
    requests = spark.createDataFrame(
        [("Hill", 0, None, None, None, None), ("Hill", 48, None, None, None, None), ("Nowhere", 0, None, None, None, None), ("Far", 0, None, None, None, None), (None, 24, 76.0, 10.0, 76.5, 10.5)],
        "place string, hours int, west double, south double, east double, north double")
    candidates = spark.createDataFrame([("Hill", 1, "Hill, Kerala", "10.0", "76.2"), ("Far", 1, "Far, Kerala", "9.5", "76.0")], "place string, rank int, display_name string, lat string, lon string")
    scored = spark.createDataFrame([(s, r, 0, p) for s, p in ((1, 0.9), (2, 0.4)) for r in range(4)], "site int, r int, c int, p double")
    sites = spark.createDataFrame([("Hill", 1)], "place string, site int")
    weather = spark.createDataFrame([("Hill", 0, 1.0), ("Hill", 48, 60.0)], "place string, hours int, rainfall_mm_h double")
    out = {(r.place, r.hours): r for r in flows.predict(requests, candidates, scored, sites, weather, baselines=[7, 2]).collect()}
    assert len(out) == 5
    assert out["Hill", 0].rainfall_mm_h == 1.0 and out["Hill", 48].rainfall_mm_h == 60.0
    assert out["Hill", 48].active_risk_score > out["Hill", 0].active_risk_score and out["Hill", 0].score_source == "site"
    assert out["Far", 0].score_source == "baseline" and out["Far", 0].rainfall_mm_h == 1.5
    assert out["Nowhere", 0].matched == "unmatched" and out["Nowhere", 0].risk_level is None
    box = out[None, 24]
    assert box.matched == "box" and box.site_name == "custom_1025_7625_24h" and math.isclose(box.west, 76.0)
    # Without any map there is no rating, a box takes the site it overlaps most, a later hour the map of hour 0.
    none = {(r.place, r.hours): r for r in flows.predict(requests, candidates, scored, sites.withColumn("hours", F.lit(0)), weather, site_boxes=spark.createDataFrame(
        [(1, 76.4, 10.4, 76.6, 10.6), (2, 76.1, 10.1, 76.3, 10.3)], "site int, west double, south double, east double, north double")).collect()}
    assert none["Far", 0].score_source == "none" and none["Far", 0].risk_level is None and none["Far", 0].terrain_vulnerability is None
    assert none[None, 24].site == 2 and none[None, 24].score_source == "site"
    assert none["Hill", 48].score_source == "hour0" and none["Hill", 48].terrain_vulnerability == none["Hill", 0].terrain_vulnerability


def test_boxes_meet_as_in_a_plain_join(spark):
    import numpy as np
    import pandas as pd

    from terravane.operators import boxes

    rng = np.random.default_rng(0)

    def some(n, name):
        w, s = rng.uniform(-179, 179, n), rng.uniform(-80, 80, n)
        side = 2.0 ** rng.uniform(-8, 7, n)
        d = pd.DataFrame({name: range(n), "west": w, "south": s, "east": w + side, "north": s + side * rng.uniform(0.2, 1, n)})
        d.loc[0, ["west", "south", "east", "north"]] = [-0.125, -0.125, 0.125, 0.125]
        d.loc[1, ["west", "south", "east", "north"]] = [0.0, 0.0, 0.0625, 0.0625]
        d.loc[2, "east"], d.loc[3, "north"], d.loc[4, "west"] = d.west[2], np.nan, 500.0
        return d

    a, b = some(150, "k"), some(120, "site")
    want = {(x.k, y.site) for x in a.dropna().itertuples() for y in b.dropna().itertuples()
            if max(x.west, y.west) < min(x.east, y.east) and max(x.south, y.south) < min(x.north, y.north)}
    nulled = lambda d: spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), f"{d.columns[0]} int, west double, south double, east double, north double")
    got = boxes.overlaps(nulled(a), nulled(b)).select("a.k", "b.site", "area").collect()
    assert len(got) == len(want) and {(r.k, r.site) for r in got} == want
    best = {r.west: r.site for r in boxes.site_of_box(nulled(a), nulled(b)).collect()}
    for k in {k for k, _ in want}:
        areas = sorted((-r.area, r.site) for r in got if r.k == k)
        assert best[a.west[k]] == areas[0][1]
