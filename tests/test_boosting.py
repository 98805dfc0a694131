"""Newton boosting against a plain tree builder, missing values, folds, saving."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.operators import boosting as B
from terravane.operators import metrics, models


def cells(n, seed, gaps=0.0):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"slope": rng.integers(0, 40, n).astype(float), "twi": rng.integers(-5, 20, n) / 2.0, "soil_depth": rng.integers(0, 6, n) / 2.0})
    d["label"] = ((d.slope + 3 * d.twi + 8 * rng.random(n)) > 38).astype(int)
    for f in ("slope", "twi"):
        d.loc[rng.random(n) < gaps, f] = np.nan
    return d


def plain_tree(x, g, h, depth, l2, least, rate, place=0, out=None):
    """Every threshold of every feature by its own sums, missing rows to both sides."""
    out = {} if out is None else out
    score = lambda a, b: a * a / (b + l2)
    best = (1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            known = np.unique(x[~np.isnan(x[:, f]), f])
            for to_left in (False, True):
                for t in [*known[1:], np.inf]:
                    left = np.where(np.isnan(x[:, f]), to_left, x[:, f] < t)
                    hl, hr = h[left].sum(), h[~left].sum()
                    if min(hl, hr) < least or min(hl, hr) <= 0:
                        continue
                    gain = 0.5 * (score(g[left].sum(), hl) + score(g[~left].sum(), hr) - score(g.sum(), h.sum()))
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, t, to_left, left))
    out[place] = (-rate * g.sum() / (h.sum() + l2), best[0] if best[1] else None, (best[1][0], x, best[1][3]) if best[1] else None)
    if best[1]:
        left = best[1][3]
        plain_tree(x[left], g[left], h[left], depth - 1, l2, least, rate, 2 * place + 1, out)
        plain_tree(x[~left], g[~left], h[~left], depth - 1, l2, least, rate, 2 * place + 2, out)
    return out


@pytest.mark.parametrize("gaps", [0.0, 0.15])
def test_gain_and_leaves_equal_a_plain_newton_tree(spark, gaps):
    d = cells(1000, 1, gaps)
    names = ["slope", "twi", "soil_depth"]
    s = B.Settings(rounds=2, rate=0.3, depth=3, child_weight=4.0, rows=1.0, columns=1.0)
    model = B.fit_boosters(spark.createDataFrame(d).repartition(5), names, settings=s)[-1]
    x, y = d[names].to_numpy(), d.label.to_numpy()
    margin = np.zeros(len(d))
    for t in model.trees:
        g, h = B.gradients(margin, y, (y == 0).sum() / (y == 1).sum())
        plain = plain_tree(x, g, h, s.depth, s.l2, s.child_weight, s.rate)
        assert {p for p in plain if plain[p][1] is not None} == set(np.flatnonzero(t.feature >= 0).tolist())
        for p, (value, gain, split) in plain.items():
            assert t.value[p] == pytest.approx(value, rel=1e-9)
            if gain is not None:
                assert t.gain[p] == pytest.approx(gain, rel=1e-9)
                # Thresholds may differ where a node has no value between them: the rows they part do not.
                f, inside, left = split
                v = inside[:, t.feature[p]]
                assert t.feature[p] == f and (np.where(np.isnan(v), t.missing_left[p], v < t.threshold[p]) == left).all()
        at = np.zeros(len(d), dtype=int)
        for _ in range(s.depth):
            f = t.feature[at]
            v = x[np.arange(len(d)), np.maximum(f, 0)]
            right = np.where(np.isnan(v), ~t.missing_left[at], v >= t.threshold[at])
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        margin += t.value[at]
    scored = model.probability(spark.createDataFrame(d)).toPandas()
    assert np.allclose(scored.p.to_numpy(), 1 / (1 + np.exp(-margin)))


def test_a_fold_is_the_booster_without_its_rows(spark):
    d = cells(600, 2)
    d["fold"] = np.arange(600) % 3
    names = ["slope", "twi", "soil_depth"]
    s = B.Settings(rounds=3, depth=3, child_weight=1.0, rows=1.0, columns=0.7)
    both = B.fit_boosters(spark.createDataFrame(d), names, fold="fold", folds=3, positive=2.0, settings=s)
    assert len(both) == 4
    for k in range(3):
        # Few values: the thresholds of a part are among those of the whole, and an empty bin never splits better.
        alone = B.fit_boosters(spark.createDataFrame(d[d.fold != k]), names, positive=2.0, settings=s)[-1]
        for a, b in zip(both[k].trees, alone.trees):
            assert np.allclose(a.value, b.value) and (a.feature == b.feature).all() and np.allclose(a.gain, b.gain)


def test_results_do_not_depend_on_the_layout_and_survive_saving(spark, tmp_path):
    d = cells(500, 3, 0.1)
    names = ["slope", "twi", "soil_depth"]
    s = B.Settings(rounds=4, depth=4, child_weight=1.0, rows=0.7)
    a = B.fit_boosters(spark.createDataFrame(d).coalesce(1), names, settings=s)[-1]
    b = B.fit_boosters(spark.createDataFrame(d.sample(frac=1, random_state=0)).repartition(7), names, settings=s)[-1]
    assert all(np.allclose(x.value, y.value) for x, y in zip(a.trees, b.trees))
    a.save(spark, str(tmp_path / "m"))
    again = B.NewtonModel.load(spark, str(tmp_path / "m"))
    p = [m.probability(spark.createDataFrame(d)).toPandas().p.to_numpy() for m in (a, again)]
    assert np.allclose(p[0], p[1]) and sum(a.importance()) == pytest.approx(1)


def test_sketch_parts_the_weight_and_single_classes_have_no_trees(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).cast("double").alias("x"), F.lit(1.0).alias("w"))
    v, w = B.sketch(df.repartition(9), ["x"], "w", size=512)["x"]
    assert len(v) <= 512 and w.sum() == pytest.approx(200_000)
    cuts = B.thresholds(v, w, 9)
    assert np.abs(cuts - 20_000 * np.arange(1, 10)).max() < 2_000
    one = spark.createDataFrame(pd.DataFrame({"slope": [1.0, 2.0], "label": [1, 1]}))
    model = B.fit_boosters(one, ["slope"])[-1]
    assert model.trees == [] and model.probability(one).agg(F.max("p")).head()[0] == 0.0
    assert B.fit_boosters(one.limit(0), ["slope"])[-1].trees == []


def test_boosting_learns_by_folds(spark):
    d = cells(800, 4)
    d["fold"] = np.arange(800) % 4 + 5
    scored, model = models.cross_fit(spark.createDataFrame(d), lambda: models.gradient_boosting(["slope", "twi", "soil_depth"], maxIter=20, maxDepth=3, stepSize=0.2), 4)
    assert scored.count() == 800 and metrics.auc(scored, y="label").head()[0] > 0.93 and len(model.trees) == 20
