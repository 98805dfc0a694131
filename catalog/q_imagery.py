"""Queries of image-stack change detection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.base import query, rnd
from terravane.operators import imagery as I
from terravane.plans import scenes as S

SPLIT = dt.datetime(1998, 1, 1)
CELL = ["cell_id"]


def _obs(v):
    o = v.obs.withColumn("acquired", F.col("acquired").cast("timestamp"))
    return o.withColumn("pols", F.when(F.col("scl") % 2 == 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VV"))))


def _keyed(df):
    """Site, row and column from the cell number of the views."""
    k = F.col("cell_id")
    return df.withColumns({"site": F.floor(k / 1500).cast("int"), "r": F.floor((k % 1500) / 50).cast("int"), "c": (k % 50).cast("int")})


SITE = "CAST(FLOOR(cell_id / 1500) AS INT)"
KEYED = "CAST(FLOOR(cell_id / 1500) AS INT) AS site, CAST(FLOOR((cell_id % 1500) / 50) AS INT) AS r, CAST(cell_id % 50 AS INT) AS c"


@query("c1_select_scenes", """SELECT cell_id, CAST(acquired AS TIMESTAMP) AS acquired, vh FROM obs WHERE acquired >= TIMESTAMP '1995-01-01' AND acquired < TIMESTAMP '1998-01-01'
 AND mode = 'EW' AND orbit = 'DESCENDING' AND scl % 2 = 0 AND cloud_pct < 30""")
def _(v):
    return I.select_scenes(_obs(v), ["vh"], start=dt.datetime(1995, 1, 1), end=SPLIT, mode="EW", orbit="DESCENDING",
                           polarisation="VH", max_cloud=30)


@query("c2_with_fallback", f"""WITH o AS (SELECT *, {SITE} AS site FROM obs),
f AS (SELECT site, MAX(CASE WHEN cloud_pct < 1 AND scl = 7 THEN 1 ELSE 0 END) AS s FROM o GROUP BY site)
SELECT cell_id, scl, vh FROM o JOIN f USING (site) WHERE CASE WHEN s = 1 THEN cloud_pct < 1 AND scl = 7 ELSE cloud_pct < 5 END""")
def _(v):
    strict = (F.col("cloud_pct") < 1) & (F.col("scl") == 7)
    return I.with_fallback(_keyed(v.obs), strict, F.col("cloud_pct") < 5).select("cell_id", "scl", "vh")


@query("c3_cloud_mask", "SELECT cell_id, scl, b8 FROM obs WHERE (qa60 & 1024) = 0 AND (qa60 & 2048) = 0")
def _(v):
    return v.obs.filter(I.cloud_free(F.col("qa60"))).select("cell_id", "scl", "b8")


@query("c4_median_composite", "SELECT cell_id, RND(QUANTILE_CONT(vh, 0.5)) AS vh FROM obs GROUP BY cell_id")
def _(v):
    return I.median_composite(v.obs, ["vh"], CELL).select("cell_id", rnd("vh").alias("vh"))


@query("c5_normalized_difference", """SELECT cell_id, RND(QUANTILE_CONT((b8 - b4) / NULLIF(b8 + b4, 0), 0.5)) AS per_scene,
 RND((QUANTILE_CONT(b8, 0.5) - QUANTILE_CONT(b4, 0.5)) / NULLIF(QUANTILE_CONT(b8, 0.5) + QUANTILE_CONT(b4, 0.5), 0)) AS of_medians FROM obs GROUP BY cell_id""")
def _(v):
    nd = I.normalized_difference
    c = I.median_composite(v.obs.withColumn("n", nd(F.col("b8"), F.col("b4"))), ["n", "b8", "b4"], CELL)
    return c.select("cell_id", rnd("n").alias("per_scene"), rnd(nd(F.col("b8"), F.col("b4"))).alias("of_medians"))


DIFF = """d AS (SELECT cell_id, QUANTILE_CONT(CASE WHEN acquired < TIMESTAMP '1998-01-01' THEN vh END, 0.5) -
  QUANTILE_CONT(CASE WHEN acquired >= TIMESTAMP '1998-01-01' THEN vh END, 0.5) AS diff FROM obs GROUP BY cell_id)"""


def _diff(v):
    return I.windowed_change(_obs(v), "vh", SPLIT, CELL)


@query("c6_change", f"WITH {DIFF} SELECT cell_id, RND(diff) AS diff FROM d")
def _(v):
    o = _obs(v)
    pre = I.median_composite(o.filter(F.col("acquired") < F.lit(SPLIT)), ["vh"], CELL)
    post = I.median_composite(o.filter(F.col("acquired") >= F.lit(SPLIT)), ["vh"], CELL)
    return I.change(pre, post, "vh", CELL).select("cell_id", rnd("diff").alias("diff"))


@query("c7_threshold_mask", f"WITH {DIFF} SELECT cell_id, CASE WHEN diff > 3 THEN 1 ELSE 0 END AS mask FROM d")
def _(v):
    return _diff(v).select("cell_id", I.above(F.col("diff"), I.BACKSCATTER_DROP_DB).alias("mask"))


MASK = f"""{DIFF}, m AS (SELECT cell_id, CASE WHEN diff > 3 AND NOT COALESCE(water_occurrence > 80, FALSE) AND COALESCE(landcover NOT IN (80, 50), TRUE)
  AND COALESCE(slope > 10, TRUE) THEN 1 ELSE 0 END AS mask FROM d LEFT JOIN layers USING (cell_id) LEFT JOIN (SELECT cell_id, slope FROM stack) USING (cell_id))"""


def _mask(v):
    d = _diff(v).join(v.layers.select("cell_id", "water_occurrence", "landcover"), "cell_id", "left").join(
        v.stack.select("cell_id", "slope"), "cell_id", "left")
    m = I.keep_where(I.above(F.col("diff"), 3.0), I.not_permanent_water(F.col("water_occurrence")),
                     I.natural_land(F.col("landcover")), F.col("slope") > 10)
    return d.select("cell_id", m.alias("mask"))


@query("c8_exclude_mask", f"WITH {MASK} SELECT cell_id, mask FROM m")
def _(v):
    return _mask(v)


@query("c9_morph_open", """WITH p AS (SELECT cell_id, site, r, c, CASE WHEN z > 30 THEN 1 ELSE 0 END AS m FROM cells),
er AS (SELECT a.cell_id, a.site, a.r, a.c, MIN(b.m) AS m FROM p a JOIN p b ON a.site = b.site AND b.r BETWEEN a.r - 1 AND a.r + 1
  AND b.c BETWEEN a.c - 1 AND a.c + 1 AND ABS(a.r - b.r) + ABS(a.c - b.c) <= 1 GROUP BY ALL)
SELECT a.cell_id, MAX(b.m) AS mask FROM er a JOIN er b ON a.site = b.site AND b.r BETWEEN a.r - 1 AND a.r + 1
  AND b.c BETWEEN a.c - 1 AND a.c + 1 AND ABS(a.r - b.r) + ABS(a.c - b.c) <= 1 GROUP BY a.cell_id""")
def _(v):
    m = v.cells.withColumn("mask", F.when(F.col("z") > 30, 1).otherwise(0))
    return I.morph_open(m, "mask").select("cell_id", "mask")


@query("c10_focal_median", f"""WITH k AS (SELECT cell_id, scl, {KEYED}, MAX(vh) AS vh FROM obs GROUP BY ALL)
SELECT a.cell_id, a.scl, RND(QUANTILE_CONT(b.vh, 0.5)) AS vh FROM k a JOIN k b ON a.site = b.site AND a.scl = b.scl
 AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
 AND POWER((a.r - b.r) * 30, 2) + POWER((a.c - b.c) * 30, 2) <= 2500 GROUP BY a.cell_id, a.scl""")
def _(v):
    one = v.obs.groupBy("cell_id", "scl").agg(F.max("vh").alias("vh"))
    return I.focal_median(_keyed(one), "vh", 50.0, 30.0, 30.0, by=("site", "scl")).select("cell_id", "scl", rnd("vh").alias("vh"))


# A kernel of 13 by 9 cells that slides over tiles: whole sites, with gaps.
@query("c10_sliding_median", """WITH k AS (SELECT cell_id, site, r, c, CASE WHEN z <> 0 THEN z END AS z FROM cells)
SELECT a.cell_id, RND(QUANTILE_CONT(b.z, 0.5)) AS z FROM k a JOIN k b ON a.site = b.site AND b.r BETWEEN a.r - 4 AND a.r + 4 AND b.c BETWEEN a.c - 6 AND a.c + 6
 AND POWER((a.r - b.r) * 30, 2) + POWER((a.c - b.c) * 20, 2) <= 14400 GROUP BY a.cell_id""")
def _(v):
    cells = v.cells.select("cell_id", "site", "r", "c", F.when(F.col("z") != 0, F.col("z")).alias("z"))
    return I.focal_median(cells, "z", 120.0, 20.0, 30.0).select("cell_id", rnd("z").alias("z"))


HIST = f"""{DIFF}, s AS (SELECT {SITE} AS site, FLOOR(diff * 1000 + 0.5) / 1000 AS x FROM d WHERE diff IS NOT NULL),
rg AS (SELECT site, MIN(x) AS lo, GREATEST(0.1e0, (MAX(x) - MIN(x)) / 255e0) AS w FROM s GROUP BY site),
h AS (SELECT site, CAST(LEAST(254, FLOOR((x - lo) / w)) AS INT) AS bucket, COUNT(*) AS n, AVG(x) AS mean FROM s JOIN rg USING (site) GROUP BY ALL)"""


def _hist(v):
    d = _keyed(_diff(v)).withColumn("diff", F.floor(F.col("diff") * 1000 + 0.5) / 1000.0)
    return I.histogram(d, "diff")


@query("c11_histogram", f"WITH {HIST} SELECT site, bucket, n, RND(mean) AS mean FROM h")
def _(v):
    return _hist(v).select("site", "bucket", "n", rnd("mean").alias("mean"))


@query("c12_otsu_threshold", f"""WITH {HIST},
q AS (SELECT site, bucket, mean, CAST(SUM(n) OVER u AS DOUBLE) AS wb, CAST(SUM(n) OVER a AS DOUBLE) AS w, SUM(n * mean) OVER u AS sb, SUM(n * mean) OVER a AS s FROM h
  WINDOW u AS (PARTITION BY site ORDER BY bucket), a AS (PARTITION BY site)),
g AS (SELECT *, COALESCE(wb * (w - wb) * POWER(sb / wb - (s - sb) / NULLIF(w - wb, 0), 2), 0) AS vb FROM q),
o AS (SELECT site, mean FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY site ORDER BY vb DESC, bucket) = 1)
SELECT s.site, RND(COALESCE(mean, 3e0)) AS threshold FROM (SELECT DISTINCT site FROM cells UNION SELECT 1000000) s LEFT JOIN o USING (site)""")
def _(v):
    # One more site, without any observation, takes the fixed threshold.
    sites = v.cells.select("site").distinct().unionByName(v.spark.range(1).select(F.lit(1_000_000).alias("site")))
    return I.complete_thresholds(I.otsu_threshold(_hist(v)), sites, I.BACKSCATTER_DROP_DB).select("site", rnd("threshold").alias("threshold"))


@query("c13_ndti_turbidity", """SELECT cell_id, scl, RND(GREATEST(0e0, LEAST(1e0, ((b4 - b3) / (b4 + b3) + 0.2e0) / 0.4e0))) AS turbidity
FROM obs WHERE scl = 6 AND b4 + b3 > 0""")
def _(v):
    t = v.obs.filter("scl = 6").withColumn("t", I.turbidity(F.col("b4"), F.col("b3"), F.col("scl")))
    return t.filter("t IS NOT NULL").select("cell_id", "scl", rnd("t").alias("turbidity"))


@query("c14_extent_summary", f"""WITH {MASK} SELECT {SITE} AS site, CAST(SUM(mask) AS BIGINT) AS positive, COUNT(*) AS total,
 RND(SUM(mask) * 100e0 / COUNT(*)) AS percent FROM m GROUP BY ALL""")
def _(v):
    return I.extent_summary(_keyed(_mask(v)), "mask").select("site", "positive", "total", rnd("percent").alias("percent"))


# ---- labels from scenes: windows shift by a year from site to site -------------
WINDOW_SQL = """wd AS (SELECT DISTINCT site, TIMESTAMP '1995-01-01' + INTERVAL 1 YEAR * (site % 2) AS a0, TIMESTAMP '1997-06-01' + INTERVAL 1 YEAR * (site % 2) AS a1,
  TIMESTAMP '1998-01-01' + INTERVAL 1 YEAR * (site % 2) AS b0, TIMESTAMP '2000-06-01' + INTERVAL 1 YEAR * (site % 2) AS b1 FROM cells)"""
OPEN_SQL = """er AS (SELECT a.cell_id, a.site, a.r, a.c, MIN(b.m) AS m FROM mk a JOIN mk b ON a.site = b.site AND ABS(a.r - b.r) + ABS(a.c - b.c) <= 1 GROUP BY ALL),
op AS (SELECT a.site, a.r, a.c, MAX(b.m) AS label FROM er a JOIN er b ON a.site = b.site AND ABS(a.r - b.r) + ABS(a.c - b.c) <= 1 GROUP BY ALL)"""


def period_sql(rows: str, strict: str, relaxed: str, value: str) -> str:
    """Medians per cell and period of the scenes of the site's windows, strict where the site's period has any."""
    return f"""{WINDOW_SQL},
ob AS (SELECT o.*, {KEYED} FROM ({rows}) o),
pe AS (SELECT ob.*, CASE WHEN acquired >= a0 AND acquired < a1 THEN 'pre' WHEN acquired >= b0 AND acquired < b1 THEN 'post' END AS period FROM ob JOIN wd USING (site)),
fl AS (SELECT site, period, MAX(CASE WHEN {strict} THEN 1 ELSE 0 END) AS s FROM pe WHERE period IS NOT NULL GROUP BY ALL),
us AS (SELECT pe.* FROM pe JOIN fl USING (site, period) WHERE CASE WHEN s = 1 THEN {strict} ELSE {relaxed} END),
df AS (SELECT cell_id, site, r, c, QUANTILE_CONT({value}, 0.5) FILTER (period = 'pre') - QUANTILE_CONT({value}, 0.5) FILTER (period = 'post') AS diff FROM us GROUP BY ALL)"""


def _windows(v):
    shift = lambda y, m: F.make_timestamp(F.lit(y) + F.col("site") % 2, F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return v.cells.select("site").distinct().select(
        "site", shift(1995, 1).alias("pre_start"), shift(1997, 6).alias("pre_end"), shift(1998, 1).alias("post_start"), shift(2000, 6).alias("post_end"))


def _layers(v):
    return _keyed(v.layers.join(v.stack.select("cell_id", "slope"), "cell_id"))


# Each observation takes the median of its scene within 50 m before the medians over scenes.
FLOOD_SQL = f"""{WINDOW_SQL},
ob AS (SELECT o.*, {KEYED} FROM obs o WHERE mode = 'IW' AND scl % 2 = 0),
pe AS (SELECT ob.*, CASE WHEN acquired >= a0 AND acquired < a1 THEN 'pre' WHEN acquired >= b0 AND acquired < b1 THEN 'post' END AS period FROM ob JOIN wd USING (site)),
fl AS (SELECT site, period, MAX(CASE WHEN orbit = 'DESCENDING' THEN 1 ELSE 0 END) AS s FROM pe WHERE period IS NOT NULL GROUP BY ALL),
us AS (SELECT pe.*, ROW_NUMBER() OVER () AS id FROM pe JOIN fl USING (site, period) WHERE orbit = CASE WHEN s = 1 THEN 'DESCENDING' ELSE 'ASCENDING' END),
sp AS (SELECT a.id, a.cell_id, a.site, a.r, a.c, a.period, QUANTILE_CONT(b.vh, 0.5) AS vh FROM us a JOIN us b ON a.site = b.site AND a.period = b.period AND a.acquired = b.acquired
  AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND POWER((a.r - b.r) * 30, 2) + POWER((a.c - b.c) * 30, 2) <= 2500 GROUP BY ALL),
df AS (SELECT cell_id, site, r, c, QUANTILE_CONT(vh, 0.5) FILTER (period = 'pre') - QUANTILE_CONT(vh, 0.5) FILTER (period = 'post') AS diff FROM sp GROUP BY ALL)"""
FLOODED_SQL = f"""mk AS (SELECT df.cell_id, df.site, df.r, df.c, CASE WHEN diff > {{cut}} AND NOT COALESCE(water_occurrence > 80, FALSE) THEN 1 ELSE 0 END AS m
  FROM df LEFT JOIN layers USING (cell_id) {{more}}), {OPEN_SQL} SELECT site, r, c, label FROM op"""


@query("y6_flood_labels", f"WITH {FLOOD_SQL}, {FLOODED_SQL.format(cut='3', more='')}")
def _(v):
    return S.flood_labels(_keyed(_obs(v)), _windows(v), _layers(v), adaptive=False, dx=30.0, dy=30.0).select("site", "r", "c", "label")


@query("y6_flood_labels_adaptive", f"""WITH {FLOOD_SQL},
rg AS (SELECT site, MIN(diff) AS lo, GREATEST(0.1e0, (MAX(diff) - MIN(diff)) / 255e0) AS w FROM df WHERE diff IS NOT NULL GROUP BY site),
h AS (SELECT site, CAST(LEAST(254, FLOOR((diff - lo) / w)) AS INT) AS bucket, COUNT(*) AS n, AVG(diff) AS mean FROM df JOIN rg USING (site) WHERE diff IS NOT NULL GROUP BY ALL),
q AS (SELECT site, bucket, mean, CAST(SUM(n) OVER u AS DOUBLE) AS wb, CAST(SUM(n) OVER a AS DOUBLE) AS w, SUM(n * mean) OVER u AS sb, SUM(n * mean) OVER a AS s FROM h
  WINDOW u AS (PARTITION BY site ORDER BY bucket), a AS (PARTITION BY site)),
g AS (SELECT *, COALESCE(wb * (w - wb) * POWER(sb / wb - (s - sb) / NULLIF(w - wb, 0), 2), 0) AS vb FROM q),
th AS (SELECT site, mean AS t FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY site ORDER BY vb DESC, bucket) = 1),
{FLOODED_SQL.format(cut='COALESCE(t, 3e0)', more='LEFT JOIN th ON th.site = df.site')}""")
def _(v):
    return S.flood_labels(_keyed(_obs(v)), _windows(v), _layers(v), dx=30.0, dy=30.0).select("site", "r", "c", "label")


@query("y7_scar_labels", f"""WITH {period_sql("SELECT *, (b8 - b4) / NULLIF(b8 + b4, 0) AS ndvi FROM obs WHERE (qa60 & 3072) = 0", "cloud_pct < 2", "cloud_pct < 50", "ndvi")},
mk AS (SELECT df.cell_id, site, r, c, CASE WHEN diff > 0.05 AND COALESCE(landcover NOT IN (80, 50), TRUE) AND COALESCE(slope > 10, TRUE) THEN 1 ELSE 0 END AS m
  FROM df LEFT JOIN layers USING (cell_id) LEFT JOIN (SELECT cell_id, slope FROM stack) USING (cell_id)), {OPEN_SQL}
SELECT site, r, c, label FROM op""")
def _(v):
    return S.scar_labels(_keyed(_obs(v)), _windows(v), _layers(v), fixed=0.05, cloud=2.0).select("site", "r", "c", "label")
