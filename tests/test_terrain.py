import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import grids as G
from terravane.operators import components, flow, grid as A, imagery, labels, terrain


def as_array(df, value, shape):
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", value).collect():
        out[row.r, row.c] = np.nan if row[2] is None else row[2]
    return out


def accumulate(z):
    """Brute force: follow every cell down to its sink."""
    acc = np.zeros(z.shape)
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if np.isnan(z[r, c]):
                acc[r, c] += 1
                continue
            at = (r, c)
            while at is not None:
                acc[at] += 1
                best, low = None, z[at]
                for dr, dc in [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]:
                    n = (at[0] + dr, at[1] + dc)
                    if 0 <= n[0] < z.shape[0] and 0 <= n[1] < z.shape[1] and z[n] < low:
                        best, low = n, z[n]
                at = best
    return acc


def test_plane_slope_and_strip(spark, grid):
    z = np.array([[c * 2.0 + r for c in range(3)] for r in range(3)])
    g = terrain.slope_aspect(grid(z), 2.0, 1.0)
    np.testing.assert_allclose(as_array(g, "dzdx", (3, 3)), 1.0)
    np.testing.assert_allclose(as_array(g, "dzdy", (3, 3)), 1.0)
    np.testing.assert_allclose(as_array(g, "slope", (3, 3)), np.degrees(np.arctan(np.sqrt(2))))
    np.testing.assert_allclose(as_array(g, "aspect", (3, 3)), 315.0)
    strip = terrain.gradient(grid(np.array([[1.0, 4.0, 9.0, 16.0]])), 1.0, 1.0)
    np.testing.assert_allclose(as_array(strip, "dzdx", (1, 4))[0], [3, 4, 6, 7])


def test_curvature_is_zero_on_flat_ground(spark, grid):
    g = terrain.curvatures(grid(np.ones((4, 4))), 1.0, 1.0)
    assert {(r.plan_curvature, r.profile_curvature) for r in g.collect()} == {(0.0, 0.0)}


def test_d8_tie_and_pit(spark, grid):
    z = np.full((5, 5), 9.0)
    z[2, 2], z[1, 2], z[2, 3] = 5.0, 1.0, 1.0
    got = {(r.r, r.c): (r.rr, r.rc) for r in flow.d8_receiver(grid(z)).collect()}
    assert got[(2, 2)] == (1, 2)  # north comes before east
    assert got[(1, 2)] == (None, None)


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_flow_accumulation_over_tiles(spark, grid, tile):
    rng = np.random.default_rng(7)
    z = np.add.outer(np.arange(14)[::-1] * 2.0, np.zeros(13)) + rng.random((14, 13)) * 5
    z[4, 4] = np.nan
    acc = flow.flow_accumulation(flow.d8_receiver(grid(z)), tile)
    got = as_array(acc, "acc", z.shape)
    np.testing.assert_array_equal(got, accumulate(z))
    assert not np.isnan(got).any()


def test_distance_transform(spark, grid):
    rng = np.random.default_rng(5)
    s = rng.random((9, 12)) > 0.9
    s[0, 0] = True
    df = grid(s.astype(float), name="f").withColumn("stream", F.col("f") > 0)
    for per_task, segment in ((12, 4), (1 << 18, 4096)):
        got = as_array(terrain.dist_to_stream(df, 3.0, 2.0, cells_per_task=per_task, segment=segment), "dist", s.shape)
        at = np.argwhere(s)
        want = [[min(np.hypot((r - a) * 2.0, (c - b) * 3.0) for a, b in at) for c in range(12)] for r in range(9)]
        np.testing.assert_allclose(got, want)


def flood(mask, connectivity):
    label = np.full(mask.shape, -1)
    for r, c in np.argwhere(mask):
        if label[r, c] >= 0:
            continue
        todo = [(r, c)]
        label[r, c] = r * 1000 + c
        while todo:
            a, b = todo.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    if connectivity == 4 and abs(dr) + abs(dc) != 1:
                        continue
                    n = (a + dr, b + dc)
                    if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and label[n] < 0:
                        label[n] = r * 1000 + c
                        todo.append(n)
    return label


@pytest.mark.parametrize("connectivity,tile", [(4, 4), (8, 3), (8, 64)])
def test_regions_across_tiles(spark, grid, connectivity, tile):
    mask = np.random.default_rng(connectivity).random((17, 15)) > 0.42
    df = grid(mask.astype(float)).filter("z > 0")
    want = flood(mask, connectivity)
    got = components.label_regions(df, connectivity, tile).collect()
    assert len(got) == mask.sum()
    for row in got:
        code = row.label // components.ROW_CODE * 1000 + row.label % components.ROW_CODE
        assert code == want[row.r, row.c]


def test_component_sizes_seven_and_eight(spark, grid):
    m = np.zeros((5, 12))
    m[0, :7] = 1
    m[3, :8] = 1
    kept = components.connected_components(grid(m).filter("z > 0")).collect()
    assert {(r.r, r.size) for r in kept} == {(3, 8)}
    small = np.zeros((5, 12))
    small[0, :7] = 1
    assert components.connected_components(grid(small).filter("z > 0")).count() == 7


def test_flood_fill(spark, grid):
    z = np.array([[1.0, 9, 1], [9, 1, 9], [9, 9, 9], [1, 1, 1]])
    seeds = spark.createDataFrame([(0, 0, 0)], "site int, r int, c int")
    got = components.flood_fill_below(grid(z), seeds, 5.0, tile=2).collect()
    assert {(r.r, r.c, r.depth) for r in got} == {(0, 0, 4.0), (1, 1, 4.0), (0, 2, 4.0)}


def test_buffer_equals_three_dilations_and_opening_shrinks(spark, grid):
    label = np.zeros((12, 14))
    label[5, 6] = label[0, 0] = 1
    got = as_array(labels.boundary_buffer(grid(label, name="label")), "buffer", label.shape)
    grown = label.copy()
    for _ in range(3):
        pad = np.pad(grown, 1)
        grown = np.max([pad[i:i + 12, j:j + 14] for i in range(3) for j in range(3)], axis=0)
    np.testing.assert_array_equal(got, grown - label)
    noise = (np.random.default_rng(0).random((12, 14)) > 0.3).astype(float)
    opened = as_array(imagery.morph_open(grid(noise), "z"), "z", noise.shape)
    assert (opened <= noise).all()


def test_bilinear_same_grid_and_outside(spark, grid):
    z = np.array([[1.0, 3.0], [5.0, np.nan]])
    geo = {"x0": 0.0, "y0": 2.0, "dx": 1.0, "dy": 1.0}
    pts = spark.createDataFrame([(0, 1, 0.5, 1.5), (0, 2, 1.0, 1.5), (0, 3, 1.0, 1.0), (0, 4, 9.0, 9.0), (0, 5, 0.1, 1.9)], "site int, k int, x double, y double")
    got = {r.k: r.z for r in A.align_bilinear(pts, grid(z), "z", geo).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: None, 5: 1.0}
    cells = grid(z).select("site", "r", "c")
    assert {(r.r, r.c, r.z) for r in A.align_bilinear(cells, grid(z), "z", geo, geo).collect()} == {(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, None)}


def test_utm_known_point(spark):
    e, n = G.utm(F.lit(75.0), F.lit(0.0))
    row = spark.range(1).select(e, n).head()
    assert row[0] == pytest.approx(500000.0, abs=1e-3) and row[1] == pytest.approx(0.0, abs=1e-3)


def test_flow_sums_of_a_long_river_shrink_each_round(spark, monkeypatch):
    # 40,000 cells in a row, 4 cells a tile: 10,000 tiles in one chain, and a second site of two tiles.
    n = 40_000
    river = spark.range(n).select(F.lit(0).alias("site"), F.lit(0).alias("r"), F.col("id").cast("int").alias("c"), F.when(F.col("id") < n - 1, F.lit(0)).alias("rr"),
                                  F.when(F.col("id") < n - 1, F.col("id") + 1).cast("int").alias("rc"))
    brook = river.filter("c < 8").select(F.lit(1).alias("site"), "r", "c", F.when(F.col("c") < 7, F.col("rr")).alias("rr"), F.when(F.col("c") < 7, F.col("rc")).alias("rc"))
    live, plain = [], flow._sum_paths
    monkeypatch.setattr(flow, "_sum_paths", lambda exits, rims: plain(exits, rims, live))
    acc = flow.flow_accumulation(river.unionByName(brook), tile=4)
    bad = acc.filter("acc <> c + 1").count()
    assert bad == 0 and acc.count() == n + 8
    assert live[0] == 9_998 and live[-1] == 0 and all(b < a for a, b in zip(live, live[1:])) and len(live) <= 16


def test_a_wide_hole_is_filled_in_log_steps_and_valid_cells_stay(spark):
    side = 130
    cells = spark.range(side * side).select(F.lit("meppadi").alias("site"), F.floor(F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"))
    truth = cells.withColumn("z", 5.0 + 0.5 * F.col("r") - 0.25 * F.col("c"))
    inside = F.col("r").between(12, 111) & F.col("c").between(12, 111)
    holed = truth.withColumn("z", F.when(~inside, F.col("z"))).withColumn("z", F.when((F.col("r") == 3) & (F.col("c") == 5), float("nan")).otherwise(F.col("z")))
    other = cells.limit(9).select(F.lit("empty").alias("site"), "r", "c", F.lit(None).cast("double").alias("z"))
    levels = []
    got = A.fill_holes(holed.unionByName(other), "z", levels).join(truth.withColumnRenamed("z", "t"), ["site", "r", "c"], "left").toPandas()
    assert len(got) == side * side + 9 and len(levels) <= 10 and levels == sorted(levels, reverse=True)
    own = got[got.site == "meppadi"]
    hole = own.r.between(12, 111) & own.c.between(12, 111)
    assert own.z.notna().all() and got[got.site == "empty"].z.isna().all()
    rest = own[~hole & ~((own.r == 3) & (own.c == 5))]
    assert (rest.z == rest.t).all()
    low, high = rest.z.min(), rest.z.max()
    assert own[hole].z.between(low, high).all() and (own[hole].z - own[hole].t).abs().mean() < 0.1 * (high - low)
