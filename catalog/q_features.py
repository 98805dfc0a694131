"""Queries of feature preparation, learners and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rnd
from catalog.q_sources import scratch
from terravane.operators import features as X
from terravane.operators import metrics as E
from terravane.operators import models as M
from terravane.operators import risk as R
from terravane.operators.joins import attach_single
from terravane.operators.sampling import FEATURES
from terravane.session import settle

HOT = ", ".join(f"CAST(landcover = {k} AS INT)::DOUBLE AS landcover_{k}" for k in X.LANDCOVER_CLASSES)


@query("h1_one_hot", f"SELECT cell_id, {HOT} FROM stack")
def _(v):
    return X.one_hot(v.stack.select("cell_id", "landcover"))


@query("h2_log1p_clip", """SELECT cell_id, RND(LN(1 + GREATEST(twi, 0))) AS twi, RND(LN(1 + GREATEST(rusle_soil_loss, 0))) AS rusle_soil_loss,
 RND(LN(1 + avaflow_depth)) AS avaflow_depth FROM stack""")
def _(v):
    cols = ["twi", "rusle_soil_loss", "avaflow_depth"]
    return X.log1p_clip(v.stack.select("cell_id", *cols)).select("cell_id", *[rnd(c).alias(c) for c in cols])


@query("h3_impute_inf_median", """WITH f AS (SELECT cell_id, elevation, CASE WHEN ISFINITE(dist_to_stream) THEN dist_to_stream END AS d FROM stack)
SELECT cell_id, RND(COALESCE(elevation, (SELECT QUANTILE_CONT(elevation, 0.5) FROM f))) AS elevation,
 RND(COALESCE(d, (SELECT QUANTILE_CONT(d, 0.5) FROM f))) AS dist_to_stream FROM f""")
def _(v):
    cols = ["elevation", "dist_to_stream"]
    return X.impute_inf_median(v.stack.select("cell_id", *cols), cols).select("cell_id", *[rnd(c).alias(c) for c in cols])


@query("h4_standard_scale", """SELECT cell_id, RND((twi - (SELECT AVG(twi) FROM stack)) / (SELECT STDDEV_POP(twi) FROM stack)) AS twi,
 RND(r_factor - (SELECT AVG(r_factor) FROM stack)) AS r_factor FROM stack""")
def _(v):
    return X.standard_scale(v.stack.select("cell_id", "twi", "r_factor"), ["twi", "r_factor"]).select(
        "cell_id", rnd("twi").alias("twi"), rnd("r_factor").alias("r_factor"))


@query("h5_split_features", "SELECT elevation, slope, landcover FROM stack")
def _(v):
    t = v.stack.select("site", F.col("r").alias("row"), F.col("c").alias("col"), "label", "elevation", "slope", "landcover")
    return t.select(*X.split_features(t))


BLOCK_SQL = """bl AS (SELECT cell_id, site, r, c, label, LEAST(4, CAST(FLOOR((r - (SELECT MIN(r) FROM stack)) / CAST((SELECT MAX(r) - MIN(r) FROM stack) AS DOUBLE) * 5) AS INT)) * 5
 + LEAST(4, CAST(FLOOR((c - (SELECT MIN(c) FROM stack)) / CAST((SELECT MAX(c) - MIN(c) FROM stack) AS DOUBLE) * 5) AS INT)) AS block FROM stack)"""


@query("h6_spatial_blocks", f"WITH {BLOCK_SQL} SELECT cell_id, block FROM bl")
def _(v):
    return X.spatial_blocks(v.stack, row="r", col="c").select("cell_id", "block")


def folds_sql(k: int) -> str:
    """Greedy assignment as a recursion over the blocks from large to small: ``gr`` has block size ``n`` and fold ``f``."""
    loads = [f"l{i}" for i in range(k)]
    zero = ", ".join(f"CAST(0 AS BIGINT) AS {x}" for x in loads)
    grown = ", ".join(f"{x} + CASE f2 WHEN {i} THEN n2 ELSE 0 END" for i, x in enumerate(loads))
    least = " ".join(f"WHEN {x} THEN {i}" for i, x in enumerate(loads[:-1]))
    return BLOCK_SQL + f""",
ob AS (SELECT block, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, block) AS rn FROM bl GROUP BY block),
gr AS (SELECT CAST(0 AS BIGINT) AS i, {zero}, -1 AS f, CAST(0 AS BIGINT) AS n
 UNION ALL SELECT rn, {grown}, f2, n2 FROM (SELECT ob.rn, ob.n AS n2, {", ".join(loads)}, CASE LEAST({", ".join(loads)}) {least} ELSE {k - 1} END AS f2
   FROM gr JOIN ob ON ob.rn = gr.i + 1))"""


@query("h7_group_folds", f"WITH RECURSIVE {folds_sql(5)} SELECT f AS fold, CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS blocks FROM gr WHERE f >= 0 GROUP BY f")
def _(v):
    f = X.group_folds(X.spatial_blocks(v.stack, row="r", col="c"), 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("blocks"))


@query("h8_class_weight", """SELECT CAST(SUM(label) AS BIGINT) AS n_pos, COUNT(*) FILTER (label = 0) AS n_neg, RND(COUNT(*) FILTER (label = 0) / CAST(SUM(label) AS DOUBLE)) AS pos_weight,
 RND(COUNT(*) / (2e0 * SUM(label))) AS balanced_pos, RND(COUNT(*) / (2e0 * COUNT(*) FILTER (label = 0))) AS balanced_neg FROM stack""")
def _(v):
    w = X.class_weights(v.stack)
    return w.select("n_pos", "n_neg", *[rnd(c).alias(c) for c in ("pos_weight", "balanced_pos", "balanced_neg")])


# ---- learners: small ensembles over all cells -----------------------------------
SMALL_FOREST = {"numTrees": 10, "maxDepth": 5}
SMALL_BOOSTING = {"maxIter": 5, "maxDepth": 3}


# What SQL can state of a learner: every cell has a score, and a signal planted in the labels is found.
PLANTED = 22.0


def _planted(v):
    steep = F.coalesce(F.col("slope"), F.lit(0.0)) > PLANTED
    ready, fitted = M.prepare(v.stack.withColumn("label", steep.cast("int")))
    return ready, X.model_features(), fitted


def _found(scored, by, *more):
    """Rows and a high AUC per group."""
    n = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *more)
    return n.join(E.auc(scored, [by], y="label"), by).withColumn("auc_high", F.col("auc") > 0.9).drop("auc")


FOUND_SQL = "SELECT site, COUNT(*) AS n, TRUE AS auc_high FROM stack GROUP BY site"


@query("h9_random_forest", FOUND_SQL)
def _(v):
    ready, names, _ = _planted(v)
    model = M.fit(M.random_forest(names, **SMALL_FOREST), ready)
    return _found(M.probability(model, ready), "site")


@query("h10_gradient_boosting", FOUND_SQL)
def _(v):
    ready, names, _ = _planted(v)
    model = M.fit(M.gradient_boosting(names, **SMALL_BOOSTING), ready, "positive")
    return _found(M.probability(model, ready), "site")


# The first split of the first tree in plain sums: gain = (GL² / (HL + 1) + GR² / (HR + 1) - G² / (H + 1)) / 2, at least 5 of curvature on each side.
SPLIT_ON = ["twi", "plan_curvature", "soil_depth", "avaflow_depth"]
SPLIT_SQL = f"""WITH t AS (SELECT CASE WHEN avaflow_depth * 2 + twi > 15 THEN 1 ELSE 0 END AS y, {", ".join(SPLIT_ON)} FROM stack),
w AS (SELECT *, CASE WHEN y = 1 THEN (SELECT COUNT(*) FILTER (y = 0) / CAST(SUM(y) AS DOUBLE) FROM t) ELSE 1e0 END AS w FROM t),
lo AS ({" UNION ALL ".join(f"SELECT {i} AS k, {f} AS x, w * (0.5e0 - y) AS g, w * 0.25e0 AS h FROM w" for i, f in enumerate(SPLIT_ON))}),
b AS (SELECT k, x, SUM(g) AS g, SUM(h) AS h FROM lo GROUP BY k, x),
s AS (SELECT k, x, SUM(g) OVER u AS lg, SUM(h) OVER u AS lh, SUM(g) OVER a AS tg, SUM(h) OVER a AS th FROM b
  WINDOW u AS (PARTITION BY k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY k)),
c AS (SELECT *, 0.5e0 * (lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1)) AS gain FROM s WHERE lh >= 5 AND th - lh >= 5),
m AS (SELECT * FROM c ORDER BY gain DESC, k, x LIMIT 1)
SELECT 0 AS node, (SELECT LIST_VALUE({", ".join(repr(f) for f in SPLIT_ON)})[k + 1]) AS feature, RND4(x) AS threshold, RND4(gain) AS gain, RND(-0.05e0 * tg / (th + 1)) AS value FROM m
UNION ALL SELECT 1, NULL, NULL, NULL, RND(-0.05e0 * lg / (lh + 1)) FROM m UNION ALL SELECT 2, NULL, NULL, NULL, RND(-0.05e0 * (tg - lg) / (th - lh + 1)) FROM m"""


@query("h10_newton_split", SPLIT_SQL)
def _(v):
    cells = v.stack.select(*SPLIT_ON, (F.col("avaflow_depth") * 2 + F.col("twi") > 15).cast("int").alias("label"))
    learner = M.gradient_boosting(SPLIT_ON, maxIter=1, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="1.0")
    tree = M.fit(learner, cells, "positive").table(v.spark).filter("tree = 0")
    return tree.select("node", "feature", rnd("threshold", 4).alias("threshold"), rnd("gain", 4).alias("gain"), rnd("value").alias("value"))


@query("h11_cross_validate", f"""WITH RECURSIVE {folds_sql(3)} SELECT f AS fold, CAST((SELECT COUNT(*) FROM stack) - SUM(n) AS BIGINT) AS n_train, CAST(SUM(n) AS BIGINT) AS n_test, TRUE AS auc_high FROM gr WHERE f >= 0 GROUP BY f
UNION ALL SELECT NULL, NULL, (SELECT COUNT(*) FROM stack), TRUE""")
def _(v):
    ready, names, _ = _planted(v)
    folds = X.group_folds(X.spatial_blocks(ready, row="r", col="c"), 3)
    out = settle(M.cross_validate(folds, lambda: M.random_forest(names, **SMALL_FOREST), 3))
    both = E.fold_metrics(out, y="label").unionByName(E.overall_metrics(out, y="label"))
    return both.select("fold", "n_train", "n_test", (F.col("auc") > 0.9).alias("auc_high"))


METRICS = """cm AS (SELECT fold, COUNT(*) FILTER (y = 0 AND p < 0.5) AS tn, COUNT(*) FILTER (y = 0 AND p >= 0.5) AS fp,
  COUNT(*) FILTER (y = 1 AND p < 0.5) AS fn, COUNT(*) FILTER (y = 1 AND p >= 0.5) AS tp FROM scored WHERE p >= 0 GROUP BY fold),
pr AS (SELECT *, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS pre, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS rec FROM cm)"""


@query("h12_binary_metrics", f"""WITH {METRICS} SELECT fold, RND((tp + tn) / (tp + tn + fp + fn)) AS accuracy, RND(pre) AS precision, RND(rec) AS recall,
 RND(COALESCE(2 * pre * rec / NULLIF(pre + rec, 0), 0)) AS f1, tp + tn + fp + fn AS n_test FROM pr""")
def _(v):
    m = E.binary_metrics(v.scored.filter("p >= 0"), ["fold"])
    return m.select("fold", *[rnd(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n_test")


ROC = """sc AS (SELECT fold, p, COUNT(*) FILTER (y = 1) AS a, COUNT(*) FILTER (y = 0) AS b FROM scored WHERE p >= 0 GROUP BY fold, p),
rc AS (SELECT fold, p, a, b, SUM(a) OVER u AS ca, SUM(b) OVER u AS cb, SUM(a) OVER w AS ta, SUM(b) OVER w AS tb FROM sc
  WINDOW u AS (PARTITION BY fold ORDER BY p DESC), w AS (PARTITION BY fold))"""


@query("h13_auc", f"WITH {ROC} SELECT fold, RND(SUM(a * (tb - cb + b / 2e0)) / MAX(ta * tb)) AS auc FROM rc GROUP BY fold")
def _(v):
    return E.auc(v.scored.filter("p >= 0"), ["fold"]).select("fold", rnd("auc").alias("auc"))


@query("h14_roc_points", f"WITH {ROC} SELECT fold, p AS threshold, RND(cb / tb) AS fpr, RND(ca / ta) AS tpr FROM rc")
def _(v):
    return E.roc_points(v.scored.filter("p >= 0"), ["fold"]).select("fold", "threshold", rnd("fpr").alias("fpr"), rnd("tpr").alias("tpr"))


@query("h15_confusion_matrix", f"WITH {METRICS} SELECT fold, tn, fp, fn, tp FROM cm")
def _(v):
    return E.confusion_matrix(v.scored.filter("p >= 0"), ["fold"])


def _two_models(v):
    s = v.scored.filter("p >= 0")
    return s.withColumn("model", F.lit("a")).unionByName(s.withColumn("p", 1 - F.col("p")).withColumn("model", F.lit("b")))


@query("h16_cv_summary", """WITH t AS (SELECT 'a' AS model, fold, y, p FROM scored WHERE p >= 0 UNION ALL SELECT 'b', fold, y, 1 - p FROM scored WHERE p >= 0),
sc AS (SELECT model, fold, p, COUNT(*) FILTER (y = 1) AS a, COUNT(*) FILTER (y = 0) AS b FROM t GROUP BY ALL),
rc AS (SELECT *, SUM(b) OVER (PARTITION BY model, fold ORDER BY p DESC) AS cb, SUM(a) OVER (PARTITION BY model, fold) AS ta, SUM(b) OVER (PARTITION BY model, fold) AS tb FROM sc),
au AS (SELECT model, fold, SUM(a * (tb - cb + b / 2e0)) / MAX(ta * tb) AS auc FROM rc GROUP BY ALL),
su AS (SELECT model, AVG(auc) AS m, STDDEV_POP(auc) AS s FROM au GROUP BY model)
SELECT model, RND(m) AS mean_auc, RND(s) AS std_auc, (SELECT ARG_MAX(model, m) FROM su) AS best FROM su""")
def _(v):
    folds = E.auc(_two_models(v), ["model", "fold"])
    s = E.cv_summary(folds)
    return attach_single(s, E.best_model(s)).select("model", rnd("mean_auc").alias("mean_auc"), rnd("std_auc").alias("std_auc"), "best")


@query("h17_feature_importance", "SELECT 'slope' AS first, TRUE AS sums_to_one, site FROM (SELECT DISTINCT site FROM stack)")
def _(v):
    ready, names, _ = _planted(v)
    model = M.fit(M.random_forest(names, **SMALL_FOREST), ready)
    ranked = M.feature_importance(model, names, v.spark, top=len(names))
    told = ranked.agg(F.max(F.when(F.col("rank") == 1, F.col("feature"))).alias("first"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))
    return attach_single(v.stack.select("site").distinct(), told)


@query("h18_score_cells", """SELECT cell_id, elevation IS NULL OR slope IS NULL OR ISINF(dist_to_stream) AS nodata, TRUE AS in_range FROM stack""")
def _(v):
    ready, names, fitted = _planted(v)
    model = M.fit(M.random_forest(names, **SMALL_FOREST), ready)
    scored = M.score_cells(model, v.stack, names, FEATURES, fitted, keys=("cell_id",))
    p = F.col("p")
    return scored.select("cell_id", (p == -9999).alias("nodata"), ((p == -9999) | p.between(0, 1)).alias("in_range"))


@query("h19_transfer_score", "SELECT site, COUNT(*) AS n, 0e0 AS max_diff FROM stack GROUP BY site")
def _(v):
    ready, fitted = M.prepare(v.stack.filter("site % 2 = 0"))
    names = X.model_features()
    model = M.fit(M.random_forest(names, **SMALL_FOREST), ready)
    path = scratch(v, "model")
    M.save_model(model, fitted, path)
    loaded, stored = M.load_model(v.spark, path)
    before = M.score_cells(model, v.stack, names, FEATURES, fitted, keys=("site", "cell_id"))
    after = M.score_cells(loaded, v.stack, names, FEATURES, stored, keys=("site", "cell_id")).withColumnRenamed("p", "q")
    both = before.join(after, ["site", "cell_id"])
    return both.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_diff"))


@query("h20_probability_summary", "SELECT site, MIN(p) AS p_min, MAX(p) AS p_max, RND(AVG(p)) AS p_mean FROM scored WHERE p <> -9999 GROUP BY site")
def _(v):
    return R.probability_summary(v.scored).select("site", "p_min", "p_max", rnd("p_mean").alias("p_mean"))


CLASSES = """qc AS (SELECT site, QUANTILE_CONT(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM scored WHERE p > 0 GROUP BY site),
kl AS (SELECT cell_id, site, CASE WHEN p < 0 THEN 0 ELSE 1 + CAST(p > q[1] AS INT) + CAST(p > q[2] AS INT) + CAST(p > q[3] AS INT) + CAST(p > q[4] AS INT) END AS risk_class
  FROM scored JOIN qc USING (site))"""


@query("h21_quantile_classes", f"WITH {CLASSES} SELECT cell_id, risk_class FROM kl")
def _(v):
    return R.quantile_classes(v.scored).select("cell_id", "risk_class")


@query("h22_class_histogram", f"""WITH {CLASSES} SELECT site, risk_class, COUNT(*) AS cells, CASE risk_class WHEN 1 THEN 'Very Low' WHEN 2 THEN 'Low' WHEN 3 THEN 'Moderate'
 WHEN 4 THEN 'High' WHEN 5 THEN 'Very High' ELSE 'No data' END AS class_name FROM kl GROUP BY site, risk_class""")
def _(v):
    return R.class_histogram(R.quantile_classes(v.scored))
