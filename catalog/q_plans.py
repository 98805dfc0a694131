"""Queries of the end-to-end plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import q_feeds as QF
from catalog.base import query, rnd
from catalog.q_sources import scratch
from catalog.q_physics import DEPTH_SQL, FS_SQL
from catalog.q_risk import LEVEL_SQL, severity_sql
from catalog.q_terrain import CURVE, DIST_SQL, DX_SQL, DY_SQL, GRAD, grad_sql, steps, stream_sql
from terravane.operators import feeds as QW
from terravane.operators import models, sampling
from terravane.operators.joins import attach_single
from terravane.plans import flows, runs

KEY = ["site", "r", "c"]
K_SQL = "GREATEST(0e0, LEAST(1e0, 0.1317e0 * (2.1e-4 * POWER((100 - clay) * (silt + sand), 1.14e0) * (12 - soc * 1.72e0) - 3.25e0) / 100))"
COHESION_SQL = "CASE WHEN clay > 35 THEN 5e0 WHEN silt > 50 THEN 3e0 ELSE 0e0 END"
PHI_SQL = "CASE WHEN clay > 35 THEN 25e0 WHEN silt > 50 THEN 30e0 ELSE 35e0 END"
C_SQL = """CASE landcover WHEN 10 THEN 0.01e0 WHEN 20 THEN 0.05e0 WHEN 30 THEN 0.10e0 WHEN 40 THEN 0.30e0 WHEN 50 THEN 0.05e0 WHEN 60 THEN 1e0 WHEN 80 THEN 0e0
 WHEN 90 THEN 0e0 WHEN 95 THEN 0.01e0 ELSE 0.10e0 END"""


def _layers(v):
    return v.cells.select("cell_id", *KEY).join(v.layers, "cell_id").drop("cell_id")


# The whole feature path over elevations whose gaps took the site median.
FILLED = """md AS (SELECT site, QUANTILE_CONT(z, 0.5) AS med FROM cells WHERE z <> 0 GROUP BY site),
fz AS (SELECT cell_id, site, r, c, CASE WHEN z = 0 THEN med ELSE z END AS z FROM cells JOIN md USING (site))"""
FEATURE_SQL = ", ".join([FILLED, grad_sql("fz"), CURVE, stream_sql("fz", "")]) + f""",
ond AS (SELECT site, r, c FROM st WHERE stream),
di AS (SELECT a.cell_id, {DIST_SQL} AS dist FROM st a JOIN ond b USING (site) GROUP BY a.cell_id),
sl AS (SELECT g.*, DEGREES(ATAN(SQRT(gx*gx + gy*gy))) AS slope, DEGREES(ATAN2(-gy, gx)) AS a0 FROM g),
so AS (SELECT sl.*, landcover, sand_raw / 10e0 AS sand, silt_raw / 10e0 AS silt, clay_raw / 10e0 AS clay, soc_raw / 10e0 AS soc FROM sl JOIN layers USING (cell_id)),
pa AS (SELECT so.*, {DEPTH_SQL} AS soil_depth, {COHESION_SQL} AS cohesion, {PHI_SQL} AS phi, {K_SQL} AS k, {C_SQL} AS cf FROM so)"""


@query("y1_build_features", f"""WITH RECURSIVE {FEATURE_SQL}
SELECT pa.site, pa.r, pa.c, RND(pa.z) AS elevation, RND4(pa.slope) AS slope, RND4(CASE WHEN a0 < 0 THEN a0 + 360 ELSE a0 END) AS aspect, RND(plan_curvature) AS plan_curvature,
 RND(profile_curvature) AS profile_curvature, RND4(GREATEST(-5e0, LEAST(30e0, LN(acc * (90e0 + pa.site % 4) * (92e0 + pa.site % 3) / ((182e0 + pa.site % 4 + pa.site % 3) / 2) / GREATEST(SQRT(gx*gx + gy*gy), 0.001e0))))) AS twi, RND4(dist) AS dist_to_stream,
 soil_depth, cohesion, phi, RND(k) AS k_factor, cf AS c_factor, RND4(3000 * k * LEAST(100e0, POWER(slope / 10, 1.3e0)) * cf) AS rusle_soil_loss,
 RND4({FS_SQL.format(w='9.81e0')}) AS factor_of_safety, CAST(landcover AS DOUBLE) AS landcover
FROM pa JOIN cv USING (cell_id) JOIN di USING (cell_id) JOIN acc USING (cell_id)""")
def _(v):
    depth = v.stack.select(*KEY, "avaflow_depth", "avaflow_velocity")
    f = flows.build_features(v.cells, _layers(v), *steps(), depth)
    four = ("slope", "aspect", "twi", "dist_to_stream", "rusle_soil_loss", "factor_of_safety")
    six = ("elevation", "plan_curvature", "profile_curvature", "k_factor")
    return f.select(*KEY, *[rnd(x, 4).alias(x) for x in four], *[rnd(x).alias(x) for x in six],
                    "soil_depth", "cohesion", "phi", "c_factor", "landcover")


# Sites broken on purpose: an elevation that is no number, a cell twice, a missing layer row, a missing cell, steps of zero.
BROKEN = {1: "elevation is no number", 2: "cell is there twice", 3: "cell without layer row", 4: "grid has gaps", 5: "cell size is not positive"}
SPOT = "r = 7 AND c = 9"


def broken_sites(v):
    dem = v.cells.withColumn("z", F.col("z").cast("string"))
    here = lambda k: F.expr(f"site = {k} AND {SPOT}")
    dem = dem.withColumn("z", F.when(here(1), F.lit("n/a")).otherwise(F.col("z")))
    dem = dem.unionByName(dem.filter(here(2))).filter(~here(4))
    layers = _layers(v).filter(~here(3) & ~here(4))
    dx, dy = steps()
    return dem.select(*KEY, "z"), layers, F.when(F.col("site") == 5, F.lit(0.0)).otherwise(dx), dy


@query("y5_quarantine", f"""WITH n AS (SELECT site, COUNT(*) AS n, COUNT(*) FILTER ({SPOT}) AS spot FROM cells GROUP BY site),
full_grid AS (SELECT site, (MAX(r) - MIN(r) + 1) * (MAX(c) - MIN(c) + 1) = COUNT(*) AS whole FROM cells GROUP BY site),
t AS (SELECT site, CASE site {" ".join(f"WHEN {k} THEN {t!r}" for k, t in BROKEN.items())} END AS planted, CAST(n - CASE WHEN site = 4 THEN spot ELSE 0 END AS BIGINT) AS cells,
  CAST(CASE WHEN site IN (1, 2, 3) THEN spot WHEN site = 5 THEN n ELSE 0 END AS BIGINT) AS bad_cells, whole FROM n JOIN full_grid USING (site)),
u AS (SELECT site, COALESCE(planted, CASE WHEN NOT whole THEN 'grid has gaps' END) AS reason, cells, bad_cells FROM t)
SELECT site, reason IS NULL AS ok, reason, cells, bad_cells, CASE WHEN reason IS NULL THEN cells ELSE 0 END AS featured FROM u""")
def _(v):
    out = runs.run_sites(*broken_sites(v))
    made = out["features"].groupBy("site").agg(F.count(F.lit(1)).alias("_made"))
    return out["status"].join(made, "site", "left").select("site", "ok", "reason", "cells", "bad_cells", F.coalesce("_made", F.lit(0)).cast("long").alias("featured"))


@query("y2_physics", f"""WITH {GRAD},
so AS (SELECT site, DEGREES(ATAN(SQRT(gx*gx + gy*gy))) AS slope, landcover, sand_raw / 10e0 AS sand, silt_raw / 10e0 AS silt, clay_raw / 10e0 AS clay, soc_raw / 10e0 AS soc FROM g JOIN layers USING (cell_id)),
pa AS (SELECT site, slope, {K_SQL} AS k, {COHESION_SQL} AS cohesion, {PHI_SQL} AS phi, {DEPTH_SQL} AS soil_depth, {C_SQL} AS c FROM so),
fs AS (SELECT *, {FS_SQL.format(w='9.81e0')} AS fs, 3000 * k * LEAST(100e0, POWER(slope / 10, 1.3e0)) * c AS loss FROM pa)
SELECT site, CAST(SUM(CASE WHEN fs < 1 AND soil_depth > 0 THEN 1 ELSE 0 END) AS BIGINT) AS release_cells, RND4(SUM(CASE WHEN fs < 1 THEN soil_depth ELSE 0 END * {DX_SQL} * {DY_SQL})) AS release_volume,
 RND(MIN(fs)) AS min_fs, RND4(SUM(loss)) AS soil_loss FROM fs GROUP BY site""")
def _(v):
    s = flows.physics_summary(flows.physics(v.cells, _layers(v), *steps()), *steps())
    return s.select("site", "release_cells", rnd("release_volume", 4).alias("release_volume"), rnd("min_fs").alias("min_fs"), rnd("soil_loss", 4).alias("soil_loss"))


# Valid cells; the cells within three of an event are no negatives; 40 of each class, all of a site's negatives if it is safe.
@query("y3_batch_training", """WITH ok AS (SELECT site, label, r BETWEEN 7 AND 17 AND c BETWEEN 17 AND 33 AND site % 4 < 3 AND label = 0 AS near FROM stack WHERE landcover <> 80 AND elevation IS NOT NULL AND elevation <> 0),
k AS (SELECT site, LEAST(40, COUNT(*) FILTER (label = 1)) AS positive, LEAST(40, COUNT(*) FILTER (label = 0 AND NOT near)) AS negative FROM ok GROUP BY site)
SELECT site, positive + negative AS n, positive, negative, CAST(1000 + site AS INT) AS site_id, CAST(2 AS BIGINT) AS models, CAST(8 AS BIGINT) AS metric_rows, TRUE AS best_known FROM k""")
def _(v):
    label = v.stack.select(*KEY, "label")
    order = v.stack.select("site").distinct().withColumn("site_id", (F.col("site") + 1000).cast("int"))
    small = {"forest": {"numTrees": 5, "maxDepth": 4}, "boosting": {"maxIter": 2, "maxDepth": 3}}
    path = scratch(v, "models")
    out = flows.batch_training(v.stack, label, 40, folds=3, learners=small, save_to=path, site_order=order)
    for name in small:
        models.load_model(v.spark, f"{path}/{name}")
    told = out["metrics"].agg(F.countDistinct("model").alias("models"), F.count(F.lit(1)).alias("metric_rows"))
    best = out["summary"].agg(F.max(F.col("best").isin(*small)).alias("best_known"))
    counts = sampling.site_sample_counts(out["frame"]).join(order, "site")
    return attach_single(attach_single(counts, told), best)


# A box of one to three tenths of a degree for each site.
BOX_SQL = """76e0 + site % 5 * 0.2e0 AS w, 9.7e0 + site % 7 * 0.2e0 AS s, 76e0 + site % 5 * 0.2e0 + 0.1e0 * (1 + site % 3) AS e, 9.7e0 + site % 7 * 0.2e0 + 0.1e0 * (1 + site % 3) AS n"""


@query("y4_predict", f"""WITH {QF.RESOLVED}, {QF.PLACE_SITES}, {QF.SITE_SCORE},
{QF.BASE}, {QF.INDEXED},
rq AS (SELECT c_custkey, rp.place, lat AS la, matched AS ma, c_custkey % 4 AS station, c_custkey % 13 = 6 AS boxed, UNNEST([0, 24 + 24 * (c_custkey % 2)]) AS hours FROM rp),
pk AS (SELECT *, MAX(rain_mm_h) OVER (PARTITION BY station ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS peak FROM ix),
wr AS (SELECT h.station, h.hours, CASE WHEN h.hours = 0 THEN rain_mm_h ELSE peak END AS rain FROM (SELECT DISTINCT station, hours FROM rq) h JOIN bi USING (station) JOIN pk ON pk.station = h.station
  AND idx = GREATEST(0, LEAST(base_idx + h.hours, n - 1))),
sb AS (SELECT DISTINCT site, {BOX_SQL} FROM scored),
bq AS (SELECT DISTINCT c_custkey, 76.25e0 AS w, 10 + c_custkey % 3 * 0.5e0 - 0.25e0 AS s, 76.75e0 AS e, 10 + c_custkey % 3 * 0.5e0 + 0.25e0 AS n FROM rq WHERE boxed),
bo AS (SELECT c_custkey, site, (LEAST(bq.e, sb.e) - GREATEST(bq.w, sb.w)) * (LEAST(bq.n, sb.n) - GREATEST(bq.s, sb.s)) AS area FROM bq JOIN sb ON bq.w < sb.e AND sb.w < bq.e AND bq.s < sb.n AND sb.s < bq.n),
bs AS (SELECT c_custkey, ARG_MIN(site, (-area, site)) AS box_site FROM bo GROUP BY c_custkey),
jn AS (SELECT rq.c_custkey, place, hours, boxed, COALESCE(box_site, CASE WHEN rq.c_custkey % 7 <> 5 AND (hours = 0 OR rq.c_custkey % 3 = 0) THEN ps.site END) AS site, CASE WHEN rq.c_custkey % 7 <> 5 THEN ps.site END AS site0,
  CASE WHEN boxed THEN 10 + rq.c_custkey % 3 * 0.5e0 ELSE la END AS lat, CASE WHEN boxed THEN 'box' ELSE ma END AS matched, COALESCE(wr.rain, 1.5e0) AS rain
  FROM rq JOIN ps USING (place) LEFT JOIN bs ON rq.c_custkey = bs.c_custkey AND boxed LEFT JOIN wr USING (station, hours)),
ac AS (SELECT jn.*, COALESCE(a.score, z.score) AS score, COALESCE(a.confidence, z.confidence) AS sure, CASE WHEN a.score IS NOT NULL THEN 'site' WHEN z.score IS NOT NULL THEN 'hour0' ELSE 'none' END AS source
  FROM jn LEFT JOIN sv a USING (site) LEFT JOIN sv z ON z.site = jn.site0),
fi AS (SELECT *, score * {severity_sql('rain')} AS active FROM ac)
SELECT c_custkey, hours, matched, site, CASE WHEN matched = 'unmatched' THEN NULL WHEN boxed THEN 'custom_' || CAST(TRUNC(lat * 100) AS BIGINT) || '_' || CAST(7650 AS BIGINT) || '_' || hours || 'h'
  ELSE REPLACE(LOWER(TRIM(place)), ' ', '_') || '_' || hours || 'h' END AS site_name, RND(CASE WHEN boxed THEN lat - 0.25e0 ELSE lat - 0.05e0 END) AS south,
 CASE WHEN matched <> 'unmatched' THEN source END AS score_source, CASE WHEN matched <> 'unmatched' THEN RND1(score) END AS terrain_vulnerability,
 CASE WHEN matched <> 'unmatched' THEN RND1(active) END AS active_risk_score, CASE WHEN matched <> 'unmatched' THEN RND1(sure) END AS confidence_score,
 CASE WHEN matched <> 'unmatched' AND score IS NOT NULL THEN {LEVEL_SQL.format(x='active')} END AS risk_level FROM fi""")
def _(v):
    k = F.col("c_custkey")
    lat = F.lit(10.0) + k % 3 * 0.5
    box = {"west": F.lit(76.25), "south": lat - 0.25, "east": F.lit(76.75), "north": lat + 0.25}
    q = QF.place_queries(v).withColumns({
        "hours": F.explode(F.array(F.lit(0).cast("long"), F.lit(24) + k % 2 * 24)), "station": (k % 4).cast("int"),
        **{e: F.when(k % 13 == 6, x) for e, x in box.items()},
    })
    # Weather of the station at the hour asked for; station 3 has none.
    rain = QW.rain_for(q, v.weather_hourly, QF.NOW)
    weather = q.select("place", "hours", "station").join(rain, ["station", "hours"]).drop("station")
    # Maps of later hours exist for every third place, those of hour 0 for all but every seventh.
    known = QF.place_sites(v).join(QF.place_queries(v).filter("c_custkey % 7 <> 5"), "place").join(q.select("place", "hours").distinct(), "place")
    sites = known.filter("hours = 0 OR c_custkey % 3 = 0").select("place", "hours", "site")
    boxes = v.scored.select("site").distinct().selectExpr("site", *BOX_SQL.split(", ")).toDF("site", "west", "south", "east", "north")
    out = flows.predict(q, QF.place_candidates(v), v.scored, sites, weather, site_boxes=boxes)
    return out.select("c_custkey", "hours", "matched", "site", "site_name", rnd("south").alias("south"), "score_source",
                      "terrain_vulnerability", "active_risk_score", "confidence_score", "risk_level")


@query("y5_site_run_status", """WITH r AS (SELECT s_suppkey AS site, s_nationkey % 4 <> 0 AS ok, s_suppkey * 37.25e0 AS s FROM supplier),
m AS (SELECT *, CAST(FLOOR(s / 60) AS BIGINT) AS mi FROM r)
SELECT site, ok, CASE WHEN s < 60 THEN FORMAT('{:.1f}s', s) WHEN mi < 60 THEN FORMAT('{}m {:.1f}s', mi, s - mi * 60) ELSE FORMAT('{}h {}m {:.0f}s', CAST(FLOOR(mi / 60) AS BIGINT), mi % 60, s - mi * 60) END AS elapsed,
 (SELECT COUNT(*) FILTER (ok) FROM r) AS successful, (SELECT COUNT(*) FILTER (NOT ok) FROM r) AS failed, (SELECT COUNT(*) FROM r) AS total FROM m""")
def _(v):
    runs = v.supplier.select(F.col("s_suppkey").alias("site"), (F.col("s_nationkey") % 4 != 0).alias("ok"), (F.col("s_suppkey") * F.lit(37.25)).alias("seconds"))
    return flows.run_status(runs)
