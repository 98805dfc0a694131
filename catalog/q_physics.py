"""Queries of soil, erosion, slope stability and flow expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rnd
from terravane.functions import physics as P
from terravane.operators import dynamics as D
from terravane.operators.joins import attach, attach_single

SOIL = """soil AS (SELECT cell_id, sand_raw / 10e0 AS sand, silt_raw / 10e0 AS silt, clay_raw / 10e0 AS clay, soc_raw / 10e0 AS soc, landcover FROM layers)"""


def _soil(v):
    return v.layers.select("cell_id", "landcover", *[(F.col(f"{k}_raw") / 10.0).alias(k) for k in ("sand", "silt", "clay", "soc")])


@query("p1_k_factor", f"""WITH {SOIL}, m AS (SELECT cell_id, (100 - clay) * (silt + sand) AS m, soc * 1.72e0 AS om FROM soil)
SELECT cell_id, RND(GREATEST(0e0, LEAST(1e0, 0.1317e0 * (2.1e-4 * POWER(m, 1.14e0) * (12 - om) - 3.25e0) / 100))) AS k FROM m""")
def _(v):
    return _soil(v).select("cell_id", rnd(P.k_factor(*[F.col(k) for k in ("sand", "silt", "clay", "soc")])).alias("k"))


@query("p2_cohesion_phi", f"""WITH {SOIL} SELECT cell_id, CASE WHEN clay > 35 THEN 5e0 WHEN silt > 50 THEN 3e0 ELSE 0e0 END AS cohesion,
 CASE WHEN clay > 35 THEN 25e0 WHEN silt > 50 THEN 30e0 ELSE 35e0 END AS phi FROM soil""")
def _(v):
    return _soil(v).select("cell_id", P.cohesion(F.col("silt"), F.col("clay")).alias("cohesion"),
                           P.friction_angle(F.col("silt"), F.col("clay")).alias("phi"))


DEPTH_SQL = """CASE landcover WHEN 80 THEN 0.0e0 WHEN 90 THEN 0.1e0 WHEN 50 THEN 0.3e0 WHEN 60 THEN 0.2e0
 WHEN 10 THEN CASE WHEN slope >= 15 THEN 1.1e0 ELSE 1.7e0 END WHEN 40 THEN 1.4e0 WHEN 20 THEN 0.8e0 WHEN 30 THEN 0.7e0 WHEN 95 THEN 0.3e0 ELSE 1.0e0 END"""


@query("p3_soil_depth", f"SELECT cell_id, {DEPTH_SQL} AS soil_depth FROM stack WHERE slope IS NOT NULL")
def _(v):
    return v.stack.filter("slope IS NOT NULL").select("cell_id", P.soil_depth(F.col("landcover"), F.col("slope")).alias("soil_depth"))


@query("p4_c_factor", """SELECT cell_id, CASE landcover WHEN 10 THEN 0.01e0 WHEN 20 THEN 0.05e0 WHEN 30 THEN 0.10e0 WHEN 40 THEN 0.30e0
 WHEN 50 THEN 0.05e0 WHEN 60 THEN 1e0 WHEN 80 THEN 0e0 WHEN 90 THEN 0e0 WHEN 95 THEN 0.01e0 ELSE 0.10e0 END AS c FROM layers""")
def _(v):
    return v.layers.select("cell_id", P.c_factor(F.col("landcover")).alias("c"))


@query("p5_manning_n", """SELECT cell_id, CASE landcover WHEN 10 THEN 0.10e0 WHEN 20 THEN 0.07e0 WHEN 30 THEN 0.035e0 WHEN 40 THEN 0.04e0
 WHEN 50 THEN 0.015e0 WHEN 60 THEN 0.02e0 WHEN 80 THEN 0.03e0 WHEN 90 THEN 0.05e0 WHEN 95 THEN 0.10e0 ELSE 0.035e0 END AS n FROM layers""")
def _(v):
    return v.layers.select("cell_id", P.manning_n(F.col("landcover")).alias("n"))


@query("p6_reclassify", """WITH lk(k, c, n) AS (VALUES (10,0.001e0,0.1e0),(20,0.01e0,0.04e0),(30,0.01e0,0.04e0),(40,0.2e0,0.035e0),(50,0.9e0,0.015e0),
 (60,1e0,0.025e0),(70,0e0,0.01e0),(80,0e0,0.015e0),(90,0.05e0,0.05e0),(95,0.001e0,0.08e0),(100,0e0,0.05e0))
SELECT cell_id, COALESCE(c, 0) AS c, COALESCE(n, 0) AS n FROM layers LEFT JOIN lk ON k = landcover""")
def _(v):
    return v.layers.select("cell_id", P.reclass_c(F.col("landcover")).alias("c"), P.reclass_n(F.col("landcover")).alias("n"))


@query("p7_r_factor_monthly", """SELECT cell_id, RND(CASE WHEN SUM(prec) <> 0 THEN 0.264e0 * SUM(prec * prec) / SUM(prec) ELSE 0 END) AS r_factor
FROM monthly_rain GROUP BY cell_id""")
def _(v):
    return D.r_factor_monthly(v.monthly_rain).select("cell_id", rnd("r_factor").alias("r_factor"))


@query("p8_r_factor_const", "SELECT cell_id, 3000e0 AS r FROM layers")
def _(v):
    return v.layers.select("cell_id", P.r_factor_const().alias("r"))


@query("p9_scale_r_by_rain", "SELECT cell_id, RND(r_factor * (rusle_soil_loss / 100)) AS r FROM stack")
def _(v):
    return v.stack.select("cell_id", rnd(P.scale_by_rain(F.col("r_factor"), F.col("rusle_soil_loss"))).alias("r"))


@query("p10_ls_factor", "SELECT cell_id, RND(CASE WHEN slope IS NOT NULL THEN LEAST(100e0, POWER(slope / 10, 1.3e0)) END) AS ls FROM stack")
def _(v):
    return v.stack.select("cell_id", rnd(P.ls_factor(F.col("slope"))).alias("ls"))


@query("p11_rusle_soil_loss", """SELECT cell_id, RND4(CASE WHEN slope IS NOT NULL THEN r_factor * k_factor * LEAST(100e0, POWER(slope / 10, 1.3e0)) * c_factor END) AS a FROM stack""")
def _(v):
    a = P.soil_loss(F.col("r_factor"), F.col("k_factor"), P.ls_factor(F.col("slope")), F.col("c_factor"))
    return v.stack.select("cell_id", rnd(a, 4).alias("a"))


FS_SQL = """CASE WHEN 18 * soil_depth * SIN(RADIANS(slope)) * COS(RADIANS(slope)) > 1e-6 THEN
 (cohesion + (18 - {w}) * soil_depth * COS(RADIANS(slope)) * COS(RADIANS(slope)) * TAN(RADIANS(phi))) / (18 * soil_depth * SIN(RADIANS(slope)) * COS(RADIANS(slope))) ELSE 999 END"""


@query("p12_factor_of_safety", f"SELECT cell_id, RND({FS_SQL.format(w='9.81e0')}) AS fs, RND({FS_SQL.format(w='0e0')}) AS fs_dry FROM stack")
def _(v):
    a = [F.col(k) for k in ("slope", "soil_depth", "cohesion", "phi")]
    return v.stack.select("cell_id", rnd(P.factor_of_safety(*a)).alias("fs"), rnd(P.factor_of_safety(*a, saturated=False)).alias("fs_dry"))


@query("p13_release_by_fs", "SELECT cell_id, CASE WHEN factor_of_safety < 1 THEN soil_depth ELSE 0 END AS release FROM stack")
def _(v):
    return v.stack.select("cell_id", P.release_by_fs(F.col("factor_of_safety"), F.col("soil_depth")).alias("release"))


@query("p14_release_by_threshold", "SELECT cell_id, CASE WHEN slope > 30 AND soil_depth > 0.5 THEN soil_depth ELSE 0 END AS release FROM stack")
def _(v):
    return v.stack.select("cell_id", P.release_by_threshold(F.col("slope"), F.col("soil_depth")).alias("release"))


@query("p15_depth_velocity", """WITH d AS (SELECT cell_id, step, GREATEST(0e0, h - 1) AS depth, xmom, ymom FROM steps)
SELECT cell_id, step, RND(depth) AS depth, RND(CASE WHEN depth > 0.001 THEN SQRT(POWER(xmom / GREATEST(depth, 1e-6), 2) + POWER(ymom / GREATEST(depth, 1e-6), 2)) ELSE 0 END) AS speed FROM d""")
def _(v):
    d = v.steps.withColumn("depth", P.water_depth(F.col("h"), F.lit(1.0)))
    return d.select("cell_id", "step", rnd("depth").alias("depth"), rnd(P.speed(F.col("depth"), F.col("xmom"), F.col("ymom"))).alias("speed"))


@query("p16_running_max", """SELECT cell_id, step, MAX(h) OVER w AS h_max, CAST(SUM(CASE WHEN h > 2 THEN 1 ELSE 0 END) OVER w2 AS BIGINT) AS wet_cells
FROM steps WINDOW w AS (PARTITION BY cell_id ORDER BY step), w2 AS (PARTITION BY step)""")
def _(v):
    run = D.running_max(v.steps, ["h"])
    return attach(run, D.wet_cells(v.steps, limit=2.0), ["step"]).select("cell_id", "step", "h_max", "wet_cells")


@query("p17_flow_surface", """SELECT cell_id, step, RND(TRUNC((z - ymom) * 100e0) / 100e0 + h + xmom) AS surface
FROM steps JOIN cells USING (cell_id)""")
def _(v):
    s = v.steps.join(v.cells.select("cell_id", "z"), "cell_id")
    return s.select("cell_id", "step", rnd(P.flow_surface(F.col("z"), -F.col("ymom"), F.col("h"), F.col("xmom"))).alias("surface"))


@query("p18_time_of_reach", "SELECT cell_id, MIN(step) FILTER (h >= 3) AS reach_step FROM steps GROUP BY cell_id")
def _(v):
    return D.time_of_reach(v.steps, 3.0)


@query("p19_flow_alpha", """WITH a AS (SELECT cell_id, step, CASE WHEN h >= 0.5 THEN POWER(LEAST(1e0, h / 4), 0.7e0) ELSE 0 END AS a FROM steps)
SELECT cell_id, step, RND(a) AS alpha, RND(LEAST(0.35e0, a)) AS alpha_max, RND(0.4e0 * a + 120 / 254.9e0 * (1 - a)) AS red FROM a""")
def _(v):
    a = P.flow_alpha(F.col("h"), 0.5, 4.0, 0.7)
    return v.steps.select("cell_id", "step", rnd(a).alias("alpha"), rnd(P.flow_alpha_max(F.col("h"), 0.5, 4.0, 0.7)).alias("alpha_max"),
                          rnd(P.blend(0.4, a, F.lit(120.0))).alias("red"))


@query("p20_phase_fractions", """SELECT cell_id, step, RND(GREATEST(0e0, LEAST(1e0, xmom / h))) AS f1, RND(GREATEST(0e0, LEAST(1e0, ymom / h))) AS f2,
 RND(GREATEST(0e0, LEAST(1e0, 0.5e0 + xmom / h + 0.5e0 * (h - 2.5e0) / 3))) AS f1_wave FROM steps""")
def _(v):
    h, x, y, zero = F.col("h"), F.col("xmom"), F.col("ymom"), F.lit(0.0)
    wave = P.wave_offset(h, zero, F.lit(2.5), zero, 3.0)
    return v.steps.select("cell_id", "step", rnd(P.phase_share(x, h)).alias("f1"), rnd(P.phase_share(y, h)).alias("f2"),
                          rnd(P.phase_share(x, h, wave, 0.5)).alias("f1_wave"))


@query("p21_break_classes", """WITH m AS (SELECT FLOOR(MAX(h)) AS d FROM steps),
b AS (SELECT cell_id, step, h, h - 2.5e0 AS dh, d * 2 / 20 AS b1, d * 5 / 20 AS b2, d * 8 / 20 AS b3, d * 12 / 20 AS b4, d * 10 / 20 AS s2, d * 15 / 20 AS s3,
   LEAST(0.1e0, d * 2 / 20 * 0.75e0) AS mn FROM steps, m)
SELECT cell_id, step, CAST(h > mn AS INT) + CAST(h > b1 AS INT) + CAST(h > b2 AS INT) + CAST(h > b3 AS INT) + CAST(h > b4 AS INT) AS depth_class,
  1 + CAST(dh > -s3 AS INT) + CAST(dh > -s2 AS INT) + CAST(dh > -b2 AS INT) + CAST(dh > -mn AS INT) + CAST(dh > mn AS INT) + CAST(dh > b2 AS INT) + CAST(dh > s2 AS INT) + CAST(dh > s3 AS INT) AS change_class
FROM b""")
def _(v):
    top = v.steps.agg(F.floor(F.max("h")).cast("double").alias("d"))
    s = attach_single(v.steps, top)
    lim = D.breaks(F.col("d"))
    minimum = F.least(F.lit(0.1), lim[0] * 0.75)
    signed = F.array(*[F.round(F.col("d") * k / 20, 2) for k in D.SIGNED_SHARES])
    return s.select("cell_id", "step", D.depth_class(F.col("h"), lim, minimum).alias("depth_class"),
                    D.signed_class(F.col("h") - 2.5, signed, minimum).alias("change_class"))


@query("p22_binary_reclass", "SELECT cell_id, step, CASE WHEN h > 2.5 THEN 1 ELSE 0 END AS impact FROM steps")
def _(v):
    return v.steps.select("cell_id", "step", P.binary_reclass(F.col("h"), 2.5).alias("impact"))
