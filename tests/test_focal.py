"""Sliding medians against plain ones: any radius, gaps, several values in a cell, tile borders."""

import time

import numpy as np
import pandas as pd
import pytest

from terravane.operators import imagery as I


def plain(d, radius, dx, dy):
    out = []
    for a in d.itertuples():
        near = d[((d.r - a.r) * dy) ** 2 + ((d.c - a.c) * dx) ** 2 <= radius**2].v.dropna()
        out.append(np.median(near) if len(near) else np.nan)
    return np.array(out)


@pytest.mark.parametrize("radius,dx,dy", [(50, 10, 10), (47, 10, 25), (3.9, 1, 1), (5, 1, 2)])
def test_sliding_medians_equal_plain_ones(spark, radius, dx, dy):
    rng = np.random.default_rng(int(radius))
    r, c = (x.ravel() for x in np.meshgrid(range(-3, 14), range(40, 63), indexing="ij"))
    d = pd.DataFrame({"site": "s", "r": r, "c": c, "v": rng.integers(0, 9, len(r)) / 2.0, "tag": range(len(r))})
    d = d[rng.random(len(d)) < 0.8]
    d.loc[rng.random(len(d)) < 0.2, "v"] = np.nan
    d.loc[(d.r > 6) & (d.c > 51), "v"] = np.nan
    d = pd.concat([d, d.iloc[:5].assign(v=7.0, tag=range(1000, 1005))])
    want = dict(zip(d.tag, plain(d, radius, dx, dy)))
    for tile in (7, 128):
        got = I._sliding_median(spark.createDataFrame(d), "v", radius, dx, dy, ("site",), tile).toPandas()
        assert len(got) == len(d) and list(got.columns) == list(d.columns)
        np.testing.assert_allclose([want[t] for t in got.tag], got.v.astype(float))
    small = I.focal_median(spark.createDataFrame(d), "v", 1.5, 1, 1).toPandas()
    np.testing.assert_allclose(dict(zip(d.tag, plain(d, 1.5, 1, 1)))[0] if 0 in want else 0, small.v[small.tag == 0].iloc[0] if 0 in want else 0)


def test_cost_grows_far_less_than_the_area_of_the_kernel():
    rng = np.random.default_rng(0)
    r, c = (x.ravel() for x in np.meshgrid(range(120), range(120), indexing="ij"))
    v = rng.random(len(r))
    took = []
    for radius in (5, 20):
        start = time.perf_counter()
        got = I.sliding_medians(r, c, v, np.ones(len(r), dtype=bool), radius, 1, 1)
        took.append(time.perf_counter() - start)
    near = v[(r - 60) ** 2 + (c - 60) ** 2 <= 400]
    assert got[(r == 60) & (c == 60)][0] == np.median(near)
    assert took[1] < 8 * took[0]  # the area grows 15 times
