"""Queries of labels, masks and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rnd
from terravane.operators import labels as L
from terravane.operators import sampling as S
from terravane.operators.joins import attach
from terravane.session import settle

SEED, N = 42, 40


def _labelled(v):
    return v.stack.withColumnRenamed("elevation", "z")


FLOOD = "CASE WHEN landcover <> 80 AND ((elevation < 3 AND slope < 5) OR elevation < 1) THEN 1 ELSE 0 END"
SLIDE = "CASE WHEN factor_of_safety < 1 AND factor_of_safety > 0 AND slope > 10 AND landcover NOT IN (80, 50) THEN 1 ELSE 0 END"


@query("l1_proxy_flood_label", f"SELECT cell_id, {FLOOD} AS label FROM stack")
def _(v):
    return v.stack.select("cell_id", L.proxy_flood(F.col("elevation"), F.col("slope"), F.col("landcover")).alias("label"))


@query("l2_proxy_landslide_label", f"SELECT cell_id, {SLIDE} AS label FROM stack")
def _(v):
    return v.stack.select("cell_id", L.proxy_landslide(F.col("factor_of_safety"), F.col("slope"), F.col("landcover")).alias("label"))


@query("l3_relax_if_empty", """WITH s AS (SELECT cell_id, site, CASE WHEN landcover <> 80 AND ((z < 3 AND slope < 5) OR z < 1) THEN 1 ELSE 0 END AS a,
  CASE WHEN z < 5 AND slope < 10 AND landcover <> 80 THEN 1 ELSE 0 END AS b FROM
  (SELECT cell_id, site, slope, landcover, elevation + CASE WHEN site % 2 = 0 THEN 0 ELSE 3 END AS z FROM stack)),
w AS (SELECT *, MAX(a) OVER (PARTITION BY site) AS top FROM s)
SELECT cell_id, CASE WHEN top = 1 THEN a ELSE b END AS label FROM w""")
def _(v):
    s = v.stack.withColumn("z", F.col("elevation") + F.when(F.col("site") % 2 == 0, 0).otherwise(3))
    args = (F.col("z"), F.col("slope"), F.col("landcover"))
    return L.relax_if_empty(s, L.proxy_flood(*args), L.proxy_flood_relaxed(*args), "flag").select("cell_id", F.col("flag").alias("label"))


@query("l4_blank_label", "SELECT site, r, c, 0 AS label FROM cells")
def _(v):
    return L.blank_label(v.cells)


@query("l5_binarise_label", "SELECT cell_id, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS label FROM scored")
def _(v):
    return v.scored.select("cell_id", L.binarise(F.col("p")).alias("label"))


@query("l6_resolve_label_source", """WITH o(source, k) AS (VALUES ('flood_extent', 0), ('landslide_scars', 1), ('flood_extent_2018', 2), ('landslide_inventory_2024', 3), ('safe_label', 4)),
a AS (SELECT DISTINCT c_custkey % 200 AS site, CASE c_mktsegment WHEN 'BUILDING' THEN 'flood_extent' WHEN 'MACHINERY' THEN 'landslide_scars' WHEN 'FURNITURE' THEN 'other' ELSE 'safe_label' END AS source FROM customer WHERE c_nationkey < 5),
s AS (SELECT DISTINCT c_custkey % 200 AS site FROM customer)
SELECT s.site, COALESCE((SELECT ARG_MIN(a.source, o.k) FROM a JOIN o USING (source) WHERE a.site = s.site), 'blank') AS source FROM s""")
def _(v):
    c = v.customer
    site = (F.col("c_custkey") % 200).alias("site")
    seg = F.col("c_mktsegment")
    src = F.when(seg == "BUILDING", "flood_extent").when(seg == "MACHINERY", "landslide_scars").when(seg == "FURNITURE", "other").otherwise("safe_label")
    have = c.filter("c_nationkey < 5").select(site, src.alias("source"))
    return L.resolve_label_source(c.select(site).distinct(), have)


@query("l7_valid_mask", "SELECT cell_id FROM stack WHERE landcover <> 80 AND elevation IS NOT NULL AND elevation <> 0")
def _(v):
    return v.stack.filter(L.valid_cell(F.col("landcover"), F.col("elevation"))).select("cell_id")


BUFFER = """bf AS (SELECT a.cell_id, CASE WHEN a.label = 0 AND MAX(b.label) = 1 THEN 1 ELSE 0 END AS buffer FROM stack a JOIN stack b
 ON a.site = b.site AND b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 GROUP BY a.cell_id, a.label)"""


@query("l8_boundary_buffer", f"WITH {BUFFER} SELECT cell_id, buffer FROM bf")
def _(v):
    return L.boundary_buffer(v.stack).select("cell_id", "buffer")


def _cells(v):
    ok = L.valid_cell(F.col("landcover"), F.col("elevation")) & F.col("slope").isNotNull()
    return L.boundary_buffer(v.stack).filter(ok).select("site", "r", "c", "cell_id", "slope", "label", "buffer")


def _positives(v):
    return _cells(v).filter("label = 1")


def _candidates(v):
    """Negatives outside the buffer, at sites that have events."""
    events = v.stack.filter("label = 1").select("site").distinct()
    return _cells(v).filter("label = 0 AND buffer = 0").join(events, "site", "left_semi")


POOL = BUFFER + """,
ok AS (SELECT s.site, s.r, s.c, s.cell_id, s.slope, s.label, bf.buffer, MD5('42|' || s.site || '|' || s.r || '|' || s.c) AS k FROM stack s JOIN bf USING (cell_id)
  WHERE landcover <> 80 AND elevation IS NOT NULL AND elevation <> 0 AND slope IS NOT NULL),
pos AS (SELECT * FROM ok WHERE label = 1),
neg AS (SELECT * FROM ok WHERE label = 0 AND buffer = 0 AND site IN (SELECT site FROM stack WHERE label = 1)),
ed AS (SELECT site, LIST_CONCAT([-999e0], LIST_CONCAT(LIST_TRANSFORM(QUANTILE_CONT(slope, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]), lambda x: ROUND(x, 9)), [999e0])) AS e FROM pos GROUP BY site)"""
STRATA = POOL + """,
pb AS (SELECT site, LEN(LIST_FILTER(e, lambda x: x <= slope)) - 1 AS bin, COUNT(*) AS k FROM pos JOIN ed USING (site) GROUP BY ALL),
pt AS (SELECT site, SUM(k) AS total FROM pb GROUP BY site),
nm AS (SELECT site, COUNT(*) AS m FROM neg GROUP BY site),
tg AS (SELECT site, bin, FLOOR(CAST(k AS DOUBLE) / total * LEAST(40, m)) AS target FROM pb JOIN pt USING (site) JOIN nm USING (site)),
nb AS (SELECT neg.*, LEN(LIST_FILTER(e, lambda x: x <= slope)) - 1 AS bin FROM neg JOIN ed USING (site)),
rk AS (SELECT nb.*, ROW_NUMBER() OVER (PARTITION BY site, bin ORDER BY k) AS rn FROM nb),
st AS (SELECT rk.* FROM rk JOIN tg USING (site, bin) WHERE rn <= target)"""
TOPPED = STRATA + """,
got AS (SELECT site, COUNT(*) AS g FROM st GROUP BY site),
rest AS (SELECT neg.*, ROW_NUMBER() OVER (PARTITION BY site ORDER BY k) AS rn FROM neg WHERE cell_id NOT IN (SELECT cell_id FROM st)),
tp AS (SELECT site, r, c, cell_id, slope, label FROM st UNION ALL
  SELECT rest.site, r, c, cell_id, slope, label FROM rest LEFT JOIN got USING (site) WHERE rn <= 40 - COALESCE(g, 0))"""


@query("m1_sample_n", f"WITH {POOL}, x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site ORDER BY k) AS rn FROM pos) SELECT site, r, c FROM x WHERE rn <= 40")
def _(v):
    return S.sample_n(_positives(v), N, SEED).select("site", "r", "c")


@query("m2_quantile_edges", f"WITH {POOL} SELECT site, CAST(i - 1 AS INT) AS pos, RND(e[i]) AS edge FROM ed, RANGE(1, 12) t(i)")
def _(v):
    e = S.quantile_edges(_positives(v))
    return e.select("site", F.posexplode("edges").alias("pos", "edge")).withColumn("edge", rnd("edge"))


@query("m3_digitize", f"WITH {STRATA} SELECT cell_id, CAST(bin AS INT) AS bin FROM nb")
def _(v):
    c = attach(_candidates(v), S.quantile_edges(_positives(v)), ["site"])
    return c.select("cell_id", S.digitize(F.col("slope"), F.col("edges")).alias("bin"))


@query("m4_stratified_sample", f"WITH {STRATA} SELECT site, r, c, CAST(bin AS INT) AS bin FROM st")
def _(v):
    return S.stratified_sample(_candidates(v), _positives(v), N, SEED).select("site", "r", "c", "bin")


def _sample(v):
    cand = settle(_candidates(v))
    part = S.stratified_sample(cand, _positives(v), N, SEED)
    return S.top_up(part, cand, N, SEED)


@query("m5_top_up", f"WITH {TOPPED} SELECT site, r, c FROM tp")
def _(v):
    return _sample(v).select("site", "r", "c")


def _training(v):
    sample = S.sample_n(_positives(v), N, SEED).select("site", "r", "c", "label").unionByName(_sample(v).select("site", "r", "c", "label"))
    return S.training_frame(sample, v.stack.drop("phi"))


TRAIN = TOPPED + """,
x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site ORDER BY k) AS rn FROM pos),
sm AS (SELECT site, r, c, label FROM x WHERE rn <= 40 UNION ALL SELECT site, r, c, label FROM tp),
tr AS (SELECT site, r AS row, c AS col, label, elevation, slope, aspect, plan_curvature, profile_curvature, twi, dist_to_stream, soil_depth, cohesion, 0e0 AS phi,
  k_factor, c_factor, r_factor, manning_n, rusle_soil_loss, factor_of_safety, avaflow_depth, avaflow_velocity, CAST(landcover AS DOUBLE) AS landcover
  FROM sm JOIN (SELECT * EXCLUDE (label) FROM stack) USING (site, r, c))"""


@query("m6_training_frame", f"WITH {TRAIN} SELECT * FROM tr")
def _(v):
    return _training(v)


@query("m7_impute_median", """WITH f AS (SELECT cell_id, site, elevation, slope, CASE WHEN ISFINITE(dist_to_stream) THEN dist_to_stream END AS dist_to_stream FROM stack),
m AS (SELECT site, QUANTILE_CONT(elevation, 0.5) AS a, QUANTILE_CONT(slope, 0.5) AS b, QUANTILE_CONT(dist_to_stream, 0.5) AS d FROM f GROUP BY site)
SELECT cell_id, RND(COALESCE(elevation, a, 0)) AS elevation, RND(COALESCE(slope, b, 0)) AS slope, RND(COALESCE(dist_to_stream, d, 0)) AS dist_to_stream FROM f JOIN m USING (site)""")
def _(v):
    cols = ["elevation", "slope", "dist_to_stream"]
    return S.impute_median(v.stack.select("cell_id", "site", *cols), cols).select("cell_id", *[rnd(x).alias(x) for x in cols])


@query("m8_feature_stats", """SELECT 'slope' AS feature, MIN(slope) AS min, MAX(slope) AS max, RND(AVG(slope)) AS mean, RND(STDDEV_SAMP(slope)) AS std FROM stack
UNION ALL SELECT 'twi', MIN(twi), MAX(twi), RND(AVG(twi)), RND(STDDEV_SAMP(twi)) FROM stack
UNION ALL SELECT 'phi', MIN(phi), MAX(phi), RND(AVG(phi)), RND(STDDEV_SAMP(phi)) FROM stack""")
def _(v):
    return S.feature_stats(v.stack, ["slope", "twi", "phi"]).select("feature", "min", "max", rnd("mean").alias("mean"), rnd("std").alias("std"))


def _merged(v):
    frames = [v.stack.filter(F.col("site") % 2 == k).select("site", F.col("r").alias("row"), F.col("c").alias("col"), "label", "slope") for k in (0, 1)]
    order = v.stack.select("site").distinct().withColumn("site_id", F.col("site") * 10 + 1)
    return S.merge_sites(frames, order)


@query("m9_merge_sites", "SELECT site, r AS row, c AS col, label, slope, site * 10 + 1 AS site_id FROM stack")
def _(v):
    return _merged(v)


@query("m9_class_totals", """SELECT COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positive, COUNT(*) FILTER (label = 0) AS negative, COUNT(DISTINCT site) AS sites FROM stack""")
def _(v):
    return S.class_totals(_merged(v))


@query("m10_site_sample_counts", """SELECT site, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positive, COUNT(*) FILTER (label = 0) AS negative FROM stack GROUP BY site""")
def _(v):
    return S.site_sample_counts(v.stack)
