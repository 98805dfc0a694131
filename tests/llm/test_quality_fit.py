"""The factorisation machine: scores and gradient by brute force, calibration, held-out errors."""

import numpy as np
from pyspark.sql import functions as F

from terravane.llm import quality as Q


def rows_of(rng, n, width=40):
    return [(rng.choice(width, 6, replace=False), rng.random(6)) for _ in range(n)]


def plain_logit(row, w0, w, v):
    idx, x = row
    pairs = sum(float(v[idx[i]] @ v[idx[j]]) * x[i] * x[j] for i in range(len(idx)) for j in range(i))
    return w0 + float(w[idx] @ x) + pairs


def test_logits_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    rows, w, v = rows_of(rng, 30), rng.normal(size=40), rng.normal(size=(40, 4))
    got = Q.logits(rows, np.arange(30), 0.3, w, v)
    assert np.allclose(got, np.clip([plain_logit(r, 0.3, w, v) for r in rows], -30, 30))


def test_one_step_follows_the_numeric_gradient(monkeypatch):
    rng = np.random.default_rng(1)
    rows, y = rows_of(rng, 12), np.array([0, 1] * 6)
    # AdaGrad moves every weight by the rate against its gradient's sign; the loss with and without a nudge gives that sign.
    w0, w, v, *_ = Q.fit(rows, y, rank=2, width=40, epochs=1, batch=12, rate=1e-3, ridge=0.0)
    start = np.random.default_rng(7).normal(0, 0.02, (40, 2))
    loss = lambda w, v: Q.log_loss(np.array([plain_logit(r, 0.0, w, v) for r in own]), target)
    back = np.arange(12) % 6 == 5
    kept = back if 0 < y[back].sum() < back.sum() else np.zeros(12, dtype=bool)
    own, target = [r for r, b in zip(rows, kept) if not b], y[~kept].astype(float)
    for k in range(40):
        nudge = np.zeros(40)
        nudge[k] = 1e-5
        slope = (loss(nudge, start) - loss(-nudge, start)) / 2e-5
        if abs(slope) > 1e-3:
            assert np.sign(w[k]) == -np.sign(slope)


def test_calibration_brings_odds_back():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-z))).astype(float)
    slope, shift = Q.calibrate(3 * z + 4, y)
    assert abs(slope - 1 / 3) < 0.03 and abs(shift + 4 / 3) < 0.1


def test_held_out_errors_of_a_small_table(spark):
    from terravane.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op3_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n, wrong, bad = scored.agg(F.count(F.lit(1)), F.sum((F.col("predicted") != F.col("quality")).cast("int")), F.sum(1 - F.col("quality"))).head()
    assert bad > 10 and wrong <= 0.03 * n
