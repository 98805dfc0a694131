"""Queries of grid projection, alignment and filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rnd
from terravane.functions import grids as G
from terravane.operators import grid as A

# Source geometry of the view grids: 30 rows, cell size 1, north-west corner (0, 30).
GEO = {"x0": 0.0, "y0": 30.0, "dx": 1.0, "dy": 1.0}


@query("g1_cell_to_world", """
SELECT cell_id, RND(76.1 + (c + 0.5) * 0.00083) AS x, RND(11.6 - (r + 0.5) * 0.00083) AS y,
       CAST(FLOOR((76.1e0 + (c + 0.5e0) * 0.00083e0 - 76.1e0) / 0.00083e0) AS INT) AS c2,
       CAST(FLOOR((11.6e0 - (11.6e0 - (r + 0.5e0) * 0.00083e0)) / 0.00083e0) AS INT) AS r2
FROM cells""")
def _(v):
    x0, y0, d = F.lit(76.1), F.lit(11.6), F.lit(0.00083)
    x, y = G.cell_x(x0, d, F.col("c")), G.cell_y(y0, d, F.col("r"))
    return v.cells.select("cell_id", rnd(x).alias("x"), rnd(y).alias("y"),
                          G.col_of(x, x0, d).alias("c2"), G.row_of(y, y0, d).alias("r2"))


@query("g2_cell_size_m", """
SELECT n_nationkey AS site, RND(0.000833e0 * 111320 * COS(RADIANS((8.0e0 + n_nationkey * 0.2e0 + 8.1e0 + n_nationkey * 0.2e0) / 2))) AS dx_m,
       RND(0.000833e0 * 110540) AS dy_m FROM nation""")
def _(v):
    g = v.nation.select(
        F.col("n_nationkey").alias("site"), F.lit(0.000833).alias("dx"), F.lit(0.000833).alias("dy"),
        (F.lit(8.0) + F.col("n_nationkey") * 0.2).alias("south"), (F.lit(8.1) + F.col("n_nationkey") * 0.2).alias("north"))
    return A.cell_size(g).select("site", rnd("dx_m").alias("dx_m"), rnd("dy_m").alias("dy_m"))


@query("g3_clip_bbox", """
SELECT cell_id, site, r, c,
       (8.0e0 + r * 0.2e0 BETWEEN 8 AND 13 AND 74.0e0 + c * 0.1e0 BETWEEN 74.5e0 AND 78) AS in_region
FROM cells WHERE c BETWEEN 10 AND 30 AND r BETWEEN 5 AND 20""")
def _(v):
    box = A.clip(v.cells, 10, 5, 30, 20, x="c", y="r")
    lat, lon = F.lit(8.0) + F.col("r") * F.lit(0.2), F.lit(74.0) + F.col("c") * F.lit(0.1)
    return box.select("cell_id", "site", "r", "c", G.in_region(lon, lat).alias("in_region"))


@query("g4_to_utm", """
WITH k AS (SELECT 1e0 / 298.257223563e0 / (2e0 - 1e0 / 298.257223563e0) AS n),
q AS (SELECT n, 6378137e0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * 0.9996e0 AS rad, 2 * SQRT(n) / (1 + n) AS ecc,
  n/2 - 2*n*n/3 + 5*n*n*n/16 + 41*n*n*n*n/180 AS a1, 13*n*n/48 - 3*n*n*n/5 + 557*n*n*n*n/1440 AS a2,
  61*n*n*n/240 - 103*n*n*n*n/140 AS a3, 49561*n*n*n*n/161280 AS a4 FROM k),
p AS (SELECT cell_id, RADIANS(76.1e0 + c * 0.01e0 - 75e0) AS lam, RADIANS(11.5e0 + r * 0.01e0) AS phi FROM cells),
t AS (SELECT cell_id, lam, SINH(ATANH(SIN(phi)) - ecc * ATANH(ecc * SIN(phi))) AS tau, q.* FROM p, q),
u AS (SELECT *, ATAN2(tau, COS(lam)) AS xi, ASINH(SIN(lam) / SQRT(tau*tau + COS(lam)*COS(lam))) AS eta FROM t)
SELECT cell_id,
  RND4(500000 + rad * (eta + a1*COS(2*xi)*SINH(2*eta) + a2*COS(4*xi)*SINH(4*eta) + a3*COS(6*xi)*SINH(6*eta) + a4*COS(8*xi)*SINH(8*eta))) AS easting,
  RND4(rad * (xi + a1*SIN(2*xi)*COSH(2*eta) + a2*SIN(4*xi)*COSH(4*eta) + a3*SIN(6*xi)*COSH(6*eta) + a4*SIN(8*xi)*COSH(8*eta))) AS northing
FROM u""")
def _(v):
    e, n = G.utm(F.lit(76.1) + F.col("c") * F.lit(0.01), F.lit(11.5) + F.col("r") * F.lit(0.01), 43)
    return v.cells.select("cell_id", rnd(e, 4).alias("easting"), rnd(n, 4).alias("northing"))


@query("g5_align_nearest", """
SELECT t.cell_id, CAST(s.landcover AS INT) AS landcover FROM cells t LEFT JOIN
 (SELECT c.site, c.r, c.c, l.landcover FROM cells c JOIN layers l USING (cell_id)) s
 ON s.site = t.site AND s.c = FLOOR(t.c * 1.1e0 + 0.2e0) AND s.r = FLOOR(30 - (30 - (t.r * 0.9e0 + 0.3e0)))""")
def _(v):
    src = v.cells.join(v.layers, "cell_id").select("site", "r", "c", "landcover")
    t = v.cells.select("cell_id", "site", (F.col("c") * F.lit(1.1) + F.lit(0.2)).alias("x"),
                       (F.lit(30.0) - (F.col("r") * F.lit(0.9) + F.lit(0.3))).alias("y"))
    return A.align_nearest(t, src, "landcover", GEO).select("cell_id", "landcover")


BILINEAR = """
WITH src AS (SELECT site, r, c, CASE WHEN z <> 0 THEN z END AS v FROM cells),
t AS (SELECT cell_id, site, {x} - 0.5e0 AS fx, {y} - 0.5e0 AS fy FROM cells),
w AS (SELECT t.cell_id, t.site, FLOOR(fx) + d.a AS sc, FLOOR(fy) + e.b AS sr,
        CASE WHEN d.a = 0 THEN 1 - (fx - FLOOR(fx)) ELSE fx - FLOOR(fx) END *
        CASE WHEN e.b = 0 THEN 1 - (fy - FLOOR(fy)) ELSE fy - FLOOR(fy) END AS w
      FROM t, (VALUES (0), (1)) d(a), (VALUES (0), (1)) e(b)),
hit AS (SELECT w.cell_id, SUM(w.w * s.v) / SUM(w.w) AS v FROM w JOIN src s ON s.site = w.site AND s.r = w.sr AND s.c = w.sc
        WHERE w.w > 0 AND s.v IS NOT NULL GROUP BY w.cell_id)
"""


@query("g6_align_bilinear", BILINEAR.format(x="(c * 1.01e0 + 0.3e0)", y="(r * 0.97e0 + 0.26e0)") + """
SELECT t.cell_id, RND(hit.v) AS v FROM t LEFT JOIN hit USING (cell_id)""")
def _(v):
    src = v.cells.select("site", "r", "c", G.nodata_to_null(F.col("z"), [0]).alias("v"))
    t = v.cells.select("cell_id", "site", (F.col("c") * F.lit(1.01) + F.lit(0.3)).alias("x"),
                       (F.lit(30.0) - (F.col("r") * F.lit(0.97) + F.lit(0.26))).alias("y"))
    return A.align_bilinear(t, src, "v", GEO).select("cell_id", rnd("v").alias("v"))


@query("g7_align_average", """
SELECT site, CAST(FLOOR(r / 4) AS INT) AS r, CAST(FLOOR(c / 4) AS INT) AS c, RND(AVG(label)) AS label,
       CASE WHEN AVG(label) > 0.05 THEN 1 ELSE 0 END AS flag
FROM cells JOIN labels_grid USING (cell_id) GROUP BY site, FLOOR(r / 4), FLOOR(c / 4)""")
def _(v):
    fine = v.cells.join(v.labels_grid, "cell_id").select(
        "site", (F.col("c") + 0.5).alias("x"), (F.lit(30.0) - (F.col("r") + 0.5)).alias("y"), "label")
    out = A.align_average(fine, "label", {"x0": 0.0, "y0": 30.0, "dx": 4.0, "dy": 4.0})
    return out.select("site", "r", "c", rnd("label").alias("label"), "flag")


@query("g8_fill_missing_layer", """
SELECT cell_id, CASE WHEN site % 3 = 0 THEN 40 ELSE landcover END AS landcover,
       CASE WHEN site % 3 = 0 THEN 30e0 ELSE clay_raw END AS clay_raw FROM cells JOIN layers USING (cell_id)""")
def _(v):
    layer = v.cells.join(v.layers, "cell_id").filter("site % 3 <> 0").select("site", "r", "c", "landcover", "clay_raw")
    return A.fill_missing_layer(v.cells, layer, {"landcover": 40, "clay_raw": 30.0}).select("cell_id", "landcover", "clay_raw")


@query("g9_nodata_to_null", """
SELECT cell_id, CASE WHEN p = -9999 THEN NULL ELSE p END AS p,
       CASE WHEN p < -500 THEN NULL ELSE p END AS q FROM scored""")
def _(v):
    return v.scored.select("cell_id", G.nodata_to_null(F.col("p"), [-9999]).alias("p"),
                           G.nodata_to_null(F.col("p"), floor=-500.0).alias("q"))


@query("g10_fill_nulls", """
WITH n AS (SELECT cell_id, site, CASE WHEN z = 0 THEN NULL ELSE z END AS z FROM cells),
m AS (SELECT site, QUANTILE_CONT(z, 0.5) AS med FROM n GROUP BY site)
SELECT cell_id, RND(COALESCE(z, med)) AS z, COALESCE(z, 0e0) AS z0 FROM n JOIN m USING (site)""")
def _(v):
    n = v.cells.select("cell_id", "site", G.nodata_to_null(F.col("z"), [0]).alias("z")).withColumn("z0", F.col("z"))
    out = A.fill_nulls(A.fill_nulls(n, ["z"], "median"), ["z0"], "zero")
    return out.select("cell_id", rnd("z").alias("z"), "z0")


@query("g11_bbox_around", """
SELECT cell_id, RND(lon - 0.05e0) AS west, RND(lat - 0.05e0) AS south, RND(lon + 0.05e0) AS east, RND(lat + 0.05e0) AS north,
       'custom_' || CAST(CAST(TRUNC(lat * 100) AS INT) AS VARCHAR) || '_' || CAST(CAST(TRUNC(lon * 100) AS INT) AS VARCHAR) AS name
FROM (SELECT cell_id, 74.5e0 + c * 0.037e0 AS lon, 8e0 + r * 0.043e0 AS lat FROM cells)""")
def _(v):
    lon, lat = F.lit(74.5) + F.col("c") * F.lit(0.037), F.lit(8.0) + F.col("r") * F.lit(0.043)
    box = G.box_around(lon, lat)
    return v.cells.select("cell_id", *[rnd(e).alias(k) for k, e in box.items()], G.custom_site_name(lat, lon).alias("name"))


@query("g12_fill_nulls_neighbour", """
WITH n AS (SELECT site, r, c, cell_id, CASE WHEN z = 0 THEN NULL ELSE z END AS z FROM cells)
SELECT a.cell_id, RND(COALESCE(a.z, AVG(b.z))) AS z FROM n a JOIN n b
 ON a.site = b.site AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.cell_id, a.z""")
def _(v):
    n = v.cells.select("cell_id", "site", "r", "c", G.nodata_to_null(F.col("z"), [0]).alias("z"))
    return A.fill_nulls_neighbour(n, "z").select("cell_id", rnd("z").alias("z"))


def holes_sql(levels: int) -> str:
    """The pyramid written out: means of 2 x 2 cells up to one cell, and back down with what each cell lacks."""
    up = [f"""p{i + 1} AS (SELECT site, CAST(FLOOR(r / 2) AS INT) AS r, CAST(FLOOR(c / 2) AS INT) AS c, SUM(w * COALESCE(x, 0)) / NULLIF(SUM(w), 0) AS x, LEAST(1e0, SUM(w)) AS w
 FROM p{i} GROUP BY ALL)""" for i in range(levels)]
    down = [f"""f{i} AS (SELECT p.site, p.r, p.c, CASE WHEN ANY_VALUE(p.w) >= 1 THEN ANY_VALUE(p.x) ELSE COALESCE(ANY_VALUE(p.w) * COALESCE(ANY_VALUE(p.x), 0) + (1 - ANY_VALUE(p.w))
   * SUM(s * q.x) / NULLIF(SUM(s) FILTER (q.x IS NOT NULL), 0), ANY_VALUE(p.x)) END AS x
 FROM (SELECT *, FLOOR(r / 2) + UNNEST([0, 0, 1, 1]) * CASE WHEN r % 2 = 1 THEN 1 ELSE -1 END AS qr, FLOOR(c / 2) + UNNEST([0, 1, 0, 1]) * CASE WHEN c % 2 = 1 THEN 1 ELSE -1 END AS qc,
   UNNEST([0.5625e0, 0.1875e0, 0.1875e0, 0.0625e0]) AS s FROM p{i}) p LEFT JOIN f{i + 1} q ON q.site = p.site AND q.r = qr AND q.c = qc GROUP BY p.site, p.r, p.c)""" for i in reversed(range(levels))]
    return ", ".join([*up, f"f{levels} AS (SELECT site, r, c, x FROM p{levels})", *down])


# Single gaps everywhere and a hole of 16 x 31 cells in every second site.  Weights are sixteenths, so many values end on an exact half of the last
# digit, which either engine may round its way: scaled they do not.
HOLED = "CASE WHEN z = 0 OR site % 2 = 0 AND r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 40 THEN NULL ELSE z END"


@query("g12_fill_holes", f"""WITH p0 AS (SELECT site, r, c, z AS x, CASE WHEN z IS NULL THEN 0e0 ELSE 1e0 END AS w FROM (SELECT site, r, c, {HOLED} AS z FROM cells)), {holes_sql(6)}
SELECT site, r, c, RND(x * 0.7310585786e0) AS scaled FROM f0""")
def _(v):
    holed = v.cells.select("site", "r", "c", F.expr(HOLED).alias("z"))
    return A.fill_holes(holed, "z").select("site", "r", "c", rnd(F.col("z") * 0.7310585786).alias("scaled"))


@query("g13_sample_at_points", """
WITH m AS (SELECT site, QUANTILE_CONT(z, 0.5) AS med FROM cells WHERE z <> 0 GROUP BY site),
f AS (SELECT site, r, c, CASE WHEN z <> 0 THEN z ELSE med END AS v FROM cells JOIN m USING (site)),
t AS (SELECT cell_id, site, c * 1.3e0 - 3.6e0 AS fx, r * 1.2e0 - 2.8e0 AS fy FROM cells),
b AS (SELECT *, FLOOR(fx) AS x0, FLOOR(fy) AS y0, LEAST(FLOOR(fx) + 1, 49) AS x1, LEAST(FLOOR(fy) + 1, 29) AS y1 FROM t WHERE fx BETWEEN 0 AND 49 AND fy BETWEEN 0 AND 29),
hit AS (SELECT b.cell_id, (1 - (fx - x0)) * (1 - (fy - y0)) * p.v + (fx - x0) * (1 - (fy - y0)) * q.v + (1 - (fx - x0)) * (fy - y0) * u.v + (fx - x0) * (fy - y0) * w.v AS v FROM b
  JOIN f p ON p.site = b.site AND p.r = y0 AND p.c = x0 JOIN f q ON q.site = b.site AND q.r = y0 AND q.c = x1
  JOIN f u ON u.site = b.site AND u.r = y1 AND u.c = x0 JOIN f w ON w.site = b.site AND w.r = y1 AND w.c = x1)
SELECT t.cell_id, RND(COALESCE(hit.v, m.med)) AS v FROM t JOIN m USING (site) LEFT JOIN hit USING (cell_id)""")
def _(v):
    src = v.cells.select("site", "r", "c", G.nodata_to_null(F.col("z"), [0]).alias("v"))
    t = v.cells.select("cell_id", "site", (F.col("c") * F.lit(1.3) - F.lit(3.1)).alias("x"),
                       (F.lit(30.0) - (F.col("r") * F.lit(1.2) - F.lit(2.3))).alias("y"))
    return A.sample_at_points(t, src, "v", GEO).select("cell_id", rnd("v").alias("v"))


@query("g14_points_to_grid", """
WITH pts AS (SELECT CAST(FLOOR(l_orderkey / 1500) AS INT) AS site, (l_orderkey % 50) * 0.83e0 AS x,
   30 - FLOOR((l_orderkey % 1500) / 50) * 0.79e0 AS y, l_quantity AS v FROM lineitem),
m AS (SELECT site, CAST(FLOOR(30 - y) AS INT) AS r, CAST(FLOOR(x) AS INT) AS c, AVG(v) AS v FROM pts GROUP BY ALL)
SELECT g.cell_id, RND(COALESCE(m.v, 0)) AS v FROM cells g LEFT JOIN m ON m.site = g.site AND m.r = g.r AND m.c = g.c""")
def _(v):
    k = F.col("l_orderkey")
    pts = v.lineitem.select(F.floor(k / 1500).cast("int").alias("site"), ((k % 50) * F.lit(0.83)).alias("x"),
                            (F.lit(30.0) - F.floor((k % 1500) / 50) * F.lit(0.79)).alias("y"), F.col("l_quantity").cast("double").alias("v"))
    out = A.points_to_grid(pts, v.cells, "v", GEO)
    return out.select((F.col("site").cast("long") * 1500 + F.col("r") * 50 + F.col("c")).alias("cell_id"), rnd("v").alias("v"))


@query("g15_neighbourhood", """
SELECT a.site, a.r, a.c, b.r - a.r AS dr, b.c - a.c AS dc, b.z FROM cells a JOIN cells b
 ON a.site = b.site AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1""")
def _(v):
    return A.neighbourhood(v.cells, "z")


@query("g16_quantise", "SELECT cell_id, TRUNC(z * 100e0) / 100e0 AS z FROM cells")
def _(v):
    return v.cells.select("cell_id", G.truncate_hundredths(F.col("z")).alias("z"))
