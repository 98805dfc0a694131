import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.operators import joins, lines, ranks


def test_neighbours_across_segment_borders(spark, grid):
    z = np.arange(3 * 11, dtype=float).reshape(3, 11)
    got = lines.neighbours(grid(z), "c", ["z"], segment=4).select("r", "c", F.col("_prev.z").alias("p"), F.col("_next.z").alias("n")).collect()
    assert len(got) == 33
    for row in got:
        assert row.p == (z[row.r, row.c - 1] if row.c > 0 else None)
        assert row.n == (z[row.r, row.c + 1] if row.c < 10 else None)


@pytest.mark.parametrize("reach", [1, 2])
def test_block_tolerates_gaps(spark, grid, reach):
    rng = np.random.default_rng(3)
    z = rng.random((9, 10))
    keep = rng.random((9, 10)) > 0.4
    cells = grid(z).filter(F.array_contains(F.array(*[F.lit(int(i)) for i in np.flatnonzero(keep)]), F.col("r") * 10 + F.col("c")))
    got = lines.block(cells, reach, ["z"], segment=4).collect()
    assert len(got) == keep.sum()
    for row in got:
        want = sorted(
            (dr, dc, z[row.r + dr, row.c + dc])
            for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1)
            if 0 <= row.r + dr < 9 and 0 <= row.c + dc < 10 and keep[row.r + dr, row.c + dc]
        )
        assert sorted(tuple(x) for x in row.near) == want


def test_quantiles_match_numpy_and_ignore_partitioning(spark):
    rng = np.random.default_rng(1)
    hot = np.concatenate([rng.normal(0, 1e-3, 4000), rng.lognormal(3, 4, 3000), [1e12, -1e9, 0.0, 0.0]])
    pdf = pd.DataFrame({"site": [0] * len(hot) + [1] * 3, "v": np.concatenate([hot, [1.0, 2.0, 4.0]])})
    probs = [0.0, 0.1, 0.2, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(pdf)
    for parts in (1, 16):
        got = {r.site: r for r in ranks.quantiles(df.repartition(parts), ["site"], "v", probs).collect()}
        np.testing.assert_allclose(got[0].q, np.percentile(hot, [p * 100 for p in probs]), rtol=1e-12)
        assert got[1].q[2] == pytest.approx(1.4) and got[1].n == 3


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 500), "p": rng.integers(0, 60, 500) / 60, "y": rng.integers(0, 2, 500)})
    got = ranks.running_sums(spark.createDataFrame(pdf), ["g"], "p", {"k": F.col("y")}).toPandas()
    for row in got.itertuples():
        part = pdf[pdf.g == row.g]
        assert row.cum_k == part[part.p >= row.p].y.sum() and row.all_k == part.y.sum() and row.k == part[part.p == row.p].y.sum()


def test_attach_beyond_the_broadcast_bound(spark, monkeypatch):
    big = spark.range(2000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("site"), "id")
    stats = big.groupBy("site").agg(F.count("id").alias("n"))
    want = sorted(map(tuple, joins.attach(big, stats, ["site"]).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, joins.attach(big, stats, ["site"]).collect())) == want
    for hot_rows in (100, 300):  # some keys hot, with and without a broadcast of the hot keys
        monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
        assert sorted(map(tuple, joins.attach(big, stats, ["site"]).collect())) == want
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, joins.attach(big, stats, ["site"], "left").collect())) == want


def test_medians_of_hot_cells(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"cell": np.where(rng.random(900) < 0.6, 7, rng.integers(0, 50, 900)), "a": rng.normal(size=900), "b": rng.integers(0, 9, 900)})
    got = ranks.group_medians(spark.createDataFrame(pdf), ["cell"], {"a": F.col("a"), "b": F.when(F.col("cell") != 7, F.col("b"))}, hot_rows=100).toPandas()
    want = pdf.groupby("cell").median()
    assert len(got) == len(want)
    for row in got.itertuples():
        assert row.a == pytest.approx(want.loc[row.cell].a)
        assert np.isnan(row.b) if row.cell == 7 else row.b == want.loc[row.cell].b


def test_top_n_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, 0).otherwise(1).alias("site"), "id")
    got = joins.top_n(df, ["site"], [F.col("id").desc()], 3, spread=["id"]).collect()
    assert sorted((r.site, r.rn, r.id) for r in got) == [(0, 1, 4499), (0, 2, 4498), (0, 3, 4497), (1, 1, 4999), (1, 2, 4998), (1, 3, 4997)]
