"""Queries of risk maps and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rnd
from terravane.functions import risk as K
from terravane.operators import risk as R


def _palette_sql(cls: str, palette: dict) -> str:
    names = ("red", "green", "blue", "alpha")
    cases = lambda i: " ".join(f"WHEN {k} THEN {rgba[i]}" for k, rgba in palette.items())
    return ", ".join(f"CASE {cls} {cases(i)} ELSE 0 END AS {n}" for i, n in enumerate(names))


def _overlay_sql(value: str, cut: str) -> str:
    steps = " + ".join(f"CAST({value} > {cut.format(i=i)} AS INT)" for i in (1, 2, 3, 4))
    return f"""WITH qv AS (SELECT site, QUANTILE_CONT(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM scored WHERE p <> -9999 GROUP BY site),
k AS (SELECT cell_id, CASE WHEN p = -9999 THEN 0 ELSE 1 + {steps} END AS risk_class FROM scored JOIN qv USING (site))
SELECT cell_id, risk_class, {_palette_sql('risk_class', K.RISK_PALETTE)} FROM k"""


RGBA = ["red", "green", "blue", "alpha"]


@query("r1_relative_overlay", _overlay_sql("p", "q[{i}]"))
def _(v):
    return R.relative_overlay(v.scored).select("cell_id", "risk_class", *RGBA)


@query("r2_active_overlay", _overlay_sql("ROUND(p * 0.6e0, 9)", "ROUND(q[{i}], 9)"))
def _(v):
    return R.active_overlay(v.scored, 0.6).select("cell_id", "risk_class", *RGBA)


def _silt(v):
    return v.scored.join(v.stack.select("cell_id", "manning_n"), "cell_id")


WATER = """wt AS (SELECT s.cell_id, s.site, s.r, s.c, s.p, t.manning_n BETWEEN 0.018 AND 0.030 AND
  SUM(CASE WHEN t.manning_n BETWEEN 0.018 AND 0.030 THEN 1 ELSE 0 END) OVER (PARTITION BY s.site) > 10 AS water FROM scored s JOIN stack t USING (cell_id))"""


@query("r3_water_mask", f"WITH {WATER} SELECT cell_id, water FROM wt")
def _(v):
    return R.water_mask(_silt(v)).select("cell_id", "water")


@query("r4_siltation_overlay", f"""WITH RECURSIVE {WATER},
mk AS (SELECT site, r, c, CAST(r AS BIGINT) * 2147483648 + c AS code FROM wt WHERE water),
heads AS (SELECT a.* FROM mk a WHERE NOT EXISTS (SELECT 1 FROM mk b WHERE b.site = a.site AND b.code IN (a.code - 1, a.code - 2147483648))),
reach AS (SELECT site, r, c, code FROM heads UNION SELECT b.site, b.r, b.c, a.code FROM reach a JOIN mk b ON a.site = b.site
  AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND ABS(a.r - b.r) + ABS(a.c - b.c) = 1),
lab AS (SELECT site, r, c, MIN(code) AS label FROM reach GROUP BY ALL),
big AS (SELECT site, label, COUNT(*) AS size FROM lab GROUP BY ALL),
kp AS (SELECT site, label, size, MAX(size) OVER (PARTITION BY site) AS top FROM big),
ok AS (SELECT lab.site, lab.r, lab.c FROM lab JOIN kp USING (site, label) WHERE size >= 8 OR top < 8),
wv AS (SELECT wt.site, wt.cell_id, wt.p FROM wt JOIN ok USING (site, r, c) WHERE wt.p <> -9999),
qt AS (SELECT site, QUANTILE_CONT(p, [0.33, 0.66]) AS q FROM wv GROUP BY site),
kc AS (SELECT cell_id, 1 + CAST(p > q[1] AS INT) + CAST(p > q[2] AS INT) AS silt_class FROM wv JOIN qt USING (site)),
fin AS (SELECT scored.cell_id, COALESCE(silt_class, 0) AS silt_class FROM scored LEFT JOIN kc USING (cell_id))
SELECT cell_id, silt_class, {_palette_sql('silt_class', K.SILT_PALETTE)} FROM fin""")
def _(v):
    return R.siltation_overlay(_silt(v)).select("cell_id", "silt_class", *RGBA)


SCORE = """sv AS (SELECT site, LEAST(100e0, 100 * (0.3e0 * QUANTILE_CONT(p, 0.9) + 0.2e0 * MAX(p) + 0.3e0 * COALESCE(AVG(p) FILTER (p > 0.5), 0) + 0.2e0 * AVG(CASE WHEN p > 0.5 THEN 1e0 ELSE 0e0 END))) AS score,
  LEAST(100e0, 100 * AVG(2 * ABS(p - 0.5e0))) AS confidence FROM scored WHERE p BETWEEN 0 AND 1 GROUP BY site)"""


@query("r5_overall_risk_score", f"WITH {SCORE} SELECT site, RND(score) AS score FROM sv")
def _(v):
    return R.site_scores(v.scored).select("site", rnd("score").alias("score"))


@query("r6_confidence", f"WITH {SCORE} SELECT site, RND(confidence) AS confidence FROM sv")
def _(v):
    return R.site_scores(v.scored).select("site", rnd("confidence").alias("confidence"))


def severity_sql(x: str) -> str:
    corners = K.SEVERITY_CORNERS
    parts = " ".join(
        f"WHEN {x} < {x1} THEN {y0}e0 + ({x} - {x0}) * ({y1}e0 - {y0}e0) / ({x1} - {x0})"
        for (x0, y0), (x1, y1) in zip(corners, corners[1:]))
    return f"CASE WHEN {x} < 2 THEN 0.10e0 {parts} ELSE 1e0 END"


LEVEL_SQL = "CASE WHEN {x} < 20 THEN 'LOW' WHEN {x} < 40 THEN 'MODERATE' WHEN {x} < 60 THEN 'HIGH' WHEN {x} < 80 THEN 'VERY HIGH' ELSE 'CRITICAL' END"


@query("r7_weather_severity", f"SELECT station, hour, RND({severity_sql('rain_mm_h')}) AS severity FROM weather_hourly")
def _(v):
    return v.weather_hourly.select("station", "hour", rnd(K.weather_severity(F.col("rain_mm_h"))).alias("severity"))


RAIN = "rn AS (SELECT CAST(site AS INT) AS site, site % 12 * 9.5e0 AS rainfall_mm_h FROM (SELECT DISTINCT site FROM scored))"


def _rain(v):
    return v.scored.select("site").distinct().withColumn("rainfall_mm_h", F.col("site") % 12 * F.lit(9.5))


@query("r8_active_risk", f"WITH {SCORE}, {RAIN}, a AS (SELECT site, score * {severity_sql('rainfall_mm_h')} AS s FROM sv JOIN rn USING (site)) SELECT site, RND1(s) AS active_score, {LEVEL_SQL.format(x='s')} AS risk_level FROM a")
def _(v):
    out = R.active_risk(R.site_scores(v.scored), _rain(v))
    return out.select("site", rnd("active_score", 1).alias("active_score"), "risk_level")


@query("r9_risk_level", f"SELECT cell_id, {LEVEL_SQL.format(x='(p * 100)')} AS level FROM scored")
def _(v):
    return v.scored.select("cell_id", K.risk_level(F.col("p") * 100).alias("level"))


@query("r10_gauge_level", "SELECT cell_id, CASE WHEN p * 100 >= 70 THEN 'critical' WHEN p * 100 >= 30 THEN 'moderate' ELSE 'low' END AS level FROM scored")
def _(v):
    return v.scored.select("cell_id", K.gauge_level(F.col("p") * 100).alias("level"))


@query("r11_layer_summary", """SELECT site, MIN(p) FILTER (p <> -9999) AS v_min, MAX(p) FILTER (p <> -9999) AS v_max, RND(AVG(p) FILTER (p <> -9999)) AS v_mean,
 COUNT(*) FILTER (p <> -9999) AS valid, COUNT(*) FILTER (p <> -9999) = 0 AS no_valid FROM scored GROUP BY site""")
def _(v):
    return R.layer_summary(v.scored, "p").select("site", "v_min", "v_max", rnd("v_mean").alias("v_mean"), "valid", "no_valid")
