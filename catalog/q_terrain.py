"""Queries of terrain derivatives, flow routing and connected regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rnd
from terravane.functions.grids import nodata_to_null
from terravane.operators import components as C
from terravane.operators import flow, terrain as T

# Cell size in metres: sites differ.
def steps():
    return F.lit(90.0) + F.col("site") % 4, F.lit(92.0) + F.col("site") % 3


DX_SQL, DY_SQL = "(90e0 + site % 4)", "(92e0 + site % 3)"


def slope_sql(here: str, low: str, high: str, step: str) -> str:
    """Central difference inside, one-sided at the edge."""
    return (f"CASE WHEN {low} IS NOT NULL AND {high} IS NOT NULL THEN ({high} - {low}) / (2 * {step}) "
            f"WHEN {high} IS NOT NULL THEN ({high} - {here}) / {step} ELSE ({here} - {low}) / {step} END")


# Oracle text of the gradient of z and of the quantities built on it, over a view of cells.
def grad_sql(cells: str = "cells") -> str:
    return f"""
g1 AS (SELECT *, LAG(z) OVER x AS zw, LEAD(z) OVER x AS ze, LAG(z) OVER y AS zn, LEAD(z) OVER y AS zs FROM {cells}
  WINDOW x AS (PARTITION BY site, r ORDER BY c), y AS (PARTITION BY site, c ORDER BY r)),
g AS (SELECT cell_id, site, r, c, z, {slope_sql("z", "zw", "ze", DX_SQL)} AS gx, {slope_sql("z", "zn", "zs", DY_SQL)} AS gy FROM g1)"""


def receiver_sql(cells: str = "cells", valid: str = "WHERE z <> 0") -> str:
    """Lowest strictly lower neighbour with the fixed tie order; z = 0 is nodata."""
    return f"""
v AS (SELECT site, r, c, cell_id, z FROM {cells} {valid}),
d(o, dr, dc) AS (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)),
cand AS (SELECT a.cell_id, a.site, a.r, a.c, b.cell_id AS to_id, b.r AS rr, b.c AS rc,
   ROW_NUMBER() OVER (PARTITION BY a.cell_id ORDER BY b.z, d.o) AS k
  FROM v a CROSS JOIN d JOIN v b ON b.site = a.site AND b.r = a.r + d.dr AND b.c = a.c + d.dc WHERE b.z < a.z),
recv AS (SELECT cell_id, site, r, c, to_id, rr, rc FROM cand WHERE k = 1)"""


def flow_sql(cells: str = "cells", valid: str = "WHERE z <> 0") -> str:
    return receiver_sql(cells, valid) + f""",
walk AS (SELECT cell_id AS src, cell_id AS spot FROM {cells} UNION ALL SELECT w.src, recv.to_id FROM walk w JOIN recv ON recv.cell_id = w.spot),
acc AS (SELECT spot AS cell_id, CAST(COUNT(*) AS DOUBLE) AS acc FROM walk GROUP BY spot)"""


GRAD, RECEIVER, FLOW = grad_sql(), receiver_sql(), flow_sql()


def _valid(v):
    return v.cells.withColumn("z", nodata_to_null(F.col("z"), [0]))


def _accumulated(v):
    cells = _valid(v)
    return cells.join(flow.flow_accumulation(flow.d8_receiver(cells)), ["site", "r", "c"])


@query("t1_gradient", f"WITH {GRAD} SELECT cell_id, RND(gx) AS dzdx, RND(gy) AS dzdy FROM g")
def _(v):
    return T.gradient(v.cells, *steps()).select("cell_id", rnd("dzdx").alias("dzdx"), rnd("dzdy").alias("dzdy"))


@query("t2_slope_aspect", f"""WITH {GRAD}, a AS (SELECT cell_id, DEGREES(ATAN(SQRT(gx*gx + gy*gy))) AS s, DEGREES(ATAN2(-gy, gx)) AS t FROM g)
SELECT cell_id, RND4(s) AS slope, RND4(CASE WHEN t < 0 THEN t + 360 ELSE t END) AS aspect FROM a""")
def _(v):
    return T.slope_aspect(v.cells, *steps()).select("cell_id", rnd("slope", 4).alias("slope"), rnd("aspect", 4).alias("aspect"))


CURVE = f"""
nn AS (SELECT *, LAG(gx) OVER x AS xw, LEAD(gx) OVER x AS xe, LAG(gx) OVER y AS xn, LEAD(gx) OVER y AS xs, LAG(gy) OVER y AS yn, LEAD(gy) OVER y AS ys
  FROM g WINDOW x AS (PARTITION BY site, r ORDER BY c), y AS (PARTITION BY site, c ORDER BY r)),
h AS (SELECT cell_id, gx, gy, gx*gx + gy*gy AS p, {slope_sql("gx", "xw", "xe", DX_SQL)} AS xx, {slope_sql("gx", "xn", "xs", DY_SQL)} AS xy, {slope_sql("gy", "yn", "ys", DY_SQL)} AS yy FROM nn),
cv AS (SELECT cell_id,
  CASE WHEN p > 1e-10 THEN GREATEST(-10e0, LEAST(10e0, -(gx*gx*xx + 2*gx*gy*xy + gy*gy*yy) / (p * SQRT((p+1)*(p+1)*(p+1))))) ELSE 0 END AS profile_curvature,
  CASE WHEN p > 1e-10 THEN GREATEST(-10e0, LEAST(10e0, -(gy*gy*xx - 2*gx*gy*xy + gx*gx*yy) / (p * SQRT(p)))) ELSE 0 END AS plan_curvature FROM h)"""


@query("t3_curvatures", f"WITH {GRAD}, {CURVE} SELECT cell_id, RND(profile_curvature) AS profile_curvature, RND(plan_curvature) AS plan_curvature FROM cv")
def _(v):
    return T.curvatures(v.cells, *steps()).select(
        "cell_id", rnd("profile_curvature").alias("profile_curvature"), rnd("plan_curvature").alias("plan_curvature"))


@query("t4_d8_receiver", f"WITH {RECEIVER} SELECT c.cell_id, recv.rr, recv.rc FROM cells c LEFT JOIN recv USING (cell_id)")
def _(v):
    return flow.d8_receiver(_valid(v)).select("cell_id", "rr", "rc")


@query("t5_flow_accumulation", f"WITH RECURSIVE {FLOW} SELECT cell_id, acc FROM acc")
def _(v):
    return _accumulated(v).select("cell_id", "acc")


@query("t6_twi", f"""WITH RECURSIVE {FLOW}, {GRAD}
SELECT cell_id, RND4(GREATEST(-5e0, LEAST(30e0, LN(acc * {DX_SQL} * {DY_SQL} / (({DX_SQL} + {DY_SQL}) / 2) / GREATEST(SQRT(gx*gx + gy*gy), 0.001e0))))) AS twi FROM acc JOIN g USING (cell_id)""")
def _(v):
    cells = _valid(v)
    acc = flow.flow_accumulation(flow.d8_receiver(cells))
    s = T.slope_aspect(v.cells, *steps()).join(acc, ["site", "r", "c"])
    return s.select("cell_id", rnd(T.twi(F.col("acc"), F.col("slope"), *steps()), 4).alias("twi"))


def stream_sql(cells: str = "cells", valid: str = "WHERE z <> 0") -> str:
    return flow_sql(cells, valid) + f""",
sa AS (SELECT c.cell_id, c.site, c.r, c.c, acc.acc FROM {cells} c JOIN acc USING (cell_id)),
cut AS (SELECT site, QUANTILE_CONT(acc, 0.95) AS q FROM sa GROUP BY site),
st AS (SELECT sa.*, acc >= q AS stream FROM sa JOIN cut USING (site))"""


STREAM = stream_sql()
DIST_SQL = "MIN(SQRT(POWER((a.r - b.r) * (92e0 + a.site % 3), 2) + POWER((a.c - b.c) * (90e0 + a.site % 4), 2)))"


@query("t7_streams", f"WITH RECURSIVE {STREAM} SELECT cell_id, acc, stream FROM st")
def _(v):
    return T.streams(_accumulated(v)).select("cell_id", "acc", "stream")


@query("t8_dist_to_stream", f"""WITH RECURSIVE {STREAM},
on_stream AS (SELECT site, r, c FROM st WHERE stream)
SELECT a.cell_id, RND4({DIST_SQL}) AS dist
FROM st a JOIN on_stream b USING (site) GROUP BY a.cell_id""")
def _(v):
    return T.dist_to_stream(T.streams(_accumulated(v)), *steps()).select("cell_id", rnd("dist", 4).alias("dist"))


@query("t9_hillshade", f"""WITH {GRAD}, a AS (SELECT cell_id, ATAN(SQRT(gx*gx + gy*gy)) AS s, ATAN2(-gy, gx) AS t FROM g)
SELECT cell_id, RND4((GREATEST(0e0, 255 * (COS(RADIANS(60e0)) * COS(s) + SIN(RADIANS(60e0)) * SIN(s) * COS(RADIANS(180e0) - t))) + 255) / 2) AS grey FROM a""")
def _(v):
    s = T.slope_aspect(v.cells, *steps())
    return s.select("cell_id", rnd(T.grey(T.hillshade(F.col("slope"), F.col("aspect"))), 4).alias("grey"))


@query("t10_lowest_edge", """
WITH n AS (SELECT site, r, c, CASE WHEN z = 0 THEN NULL ELSE z END AS z FROM cells),
e AS (SELECT site, AVG(z) FILTER (r = 0) AS b, AVG(z) FILTER (r = 29) AS t, AVG(z) FILTER (c = 0) AS l, AVG(z) FILTER (c = 49) AS rt FROM n GROUP BY site)
SELECT site, RND(b) AS bottom_mean, RND(t) AS top_mean, RND(l) AS left_mean, RND(rt) AS right_mean,
  CASE WHEN b <= t AND b <= l AND b <= rt THEN 'bottom' WHEN t <= l AND t <= rt THEN 'top' WHEN l <= rt THEN 'left' ELSE 'right' END AS outlet_edge,
  RND(LEAST(b, t, l, rt)) AS outlet_mean FROM e""")
def _(v):
    out = T.lowest_edge(_valid(v))
    return out.select("site", "outlet_edge", *[rnd(f"{k}_mean").alias(f"{k}_mean") for k in ("bottom", "top", "left", "right", "outlet")])


@query("t11_flood_fill", """WITH RECURSIVE low AS (SELECT site, r, c, z FROM cells WHERE z < 30 AND z <> 0),
seed AS (SELECT site, r, c FROM low QUALIFY ROW_NUMBER() OVER (PARTITION BY site ORDER BY r DESC, c) = 1),
lake AS (SELECT site, r, c FROM seed UNION
  SELECT b.site, b.r, b.c FROM lake a JOIN low b ON a.site = b.site AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1)
SELECT site, r, c, RND(30 - z) AS depth FROM lake JOIN low USING (site, r, c)""")
def _(v):
    cells = _valid(v)
    seeds = cells.filter("z < 30").groupBy("site").agg(F.min(F.struct(-F.col("r"), "c")).alias("s")).select(
        "site", (-F.col("s.col1")).alias("r"), F.col("s.c").alias("c"))
    return C.flood_fill_below(cells, seeds, 30.0).select("site", "r", "c", rnd("depth").alias("depth"))


PLANES = [(10.0, 20.0, 25.0, 30.0, 12.0), (30.0, 10.0, 20.0, 200.0, 25.0), (40.0, 25.0, 15.0, 90.0, 5.0)]


@query("t12_scarp_surface", """
WITH pl(px, py, pz, dip, sl) AS (VALUES (10e0, 20e0, 25e0, 30e0, 12e0), (30e0, 10e0, 20e0, 200e0, 25e0), (40e0, 25e0, 15e0, 90e0, 5e0)),
s AS (SELECT cell_id, z, label, MAX(pz + (30 - r - 0.5e0 - py) * TAN(RADIANS(sl)) * SIN(RADIANS(dip)) - (c + 0.5e0 - px) * TAN(RADIANS(sl)) * COS(RADIANS(dip))) AS top
  FROM cells JOIN labels_grid USING (cell_id), pl GROUP BY cell_id, z, label)
SELECT cell_id, RND(CASE WHEN label > 0 THEN LEAST(z, top) ELSE z END) AS scarp,
  RND(z - CASE WHEN label > 0 THEN LEAST(z, top) ELSE z END) AS release FROM s""")
def _(v):
    df = v.cells.join(v.labels_grid, "cell_id").select(
        "cell_id", "z", "label", (F.col("c") + 0.5).alias("x"), (F.lit(30.0) - F.col("r") - 0.5).alias("y"))
    out = T.scarp_surface(df, PLANES, perimeter="label")
    return out.select("cell_id", rnd("scarp").alias("scarp"), rnd("release").alias("release"))


# Regions by flooding from every cell without a mask cell above or to the left.
REGIONS = """mask AS (SELECT site, r, c, CAST(r AS BIGINT) * 2147483648 + c AS code FROM cells WHERE {test}),
heads AS (SELECT a.* FROM mask a WHERE NOT EXISTS (SELECT 1 FROM mask b WHERE b.site = a.site AND b.code IN (a.code - 1, a.code - 2147483648))),
reach AS (SELECT site, r, c, code FROM heads UNION
  SELECT b.site, b.r, b.c, a.code FROM reach a JOIN mask b ON a.site = b.site AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
   AND ABS(a.r - b.r) + ABS(a.c - b.c) = 1),
lab AS (SELECT site, r, c, MIN(code) AS label FROM reach GROUP BY site, r, c),
big AS (SELECT site, label, COUNT(*) AS size FROM lab GROUP BY site, label),
kept AS (SELECT site, label, size, MAX(size) OVER (PARTITION BY site) AS top FROM big)"""


@query("t13_connected_components", "WITH RECURSIVE " + REGIONS.format(test="z > 38") + """
SELECT lab.site, r, c, label, size FROM lab JOIN kept USING (site, label) WHERE size >= 8 OR top < 8""")
def _(v):
    return C.connected_components(v.cells.filter("z > 38")).select("site", "r", "c", "label", "size")
