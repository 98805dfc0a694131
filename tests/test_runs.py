"""Broken sites are set aside with their reason, the others get the features they would get alone."""

from pyspark.sql import functions as F

from terravane.plans import flows, runs

KEY = ["site", "r", "c"]


def tables(spark, sites):
    cells = spark.range(len(sites) * 72).select(F.element_at(F.array(*[F.lit(s) for s in sites]), (F.col("id") / 72).cast("int") + 1).alias("site"),
                                                (F.col("id") % 72 / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"))
    dem = cells.withColumns({"z": (100 - 3 * F.col("r") + F.col("c") % 3 + F.col("r") * F.col("c") % 5).cast("string")})
    layers = cells.withColumns({"landcover": F.lit(10 + 10 * (F.col("c") % 4)).cast("string"), "sand_raw": F.lit(300), "silt_raw": F.lit(200), "clay_raw": F.lit(150), "soc_raw": F.lit(20)})
    return dem, layers


def test_one_broken_site_leaves_the_others_as_they_are(spark):
    sites = ["good", "text", "twice", "bare", "gap", "flat", "fine", "cover"]
    dem, layers = tables(spark, sites)
    at = lambda s: (F.col("site") == s) & (F.col("r") == 2) & (F.col("c") == 3)
    broken = dem.withColumn("z", F.when(at("text"), "n/a").when(at("good"), None).otherwise(F.col("z")))
    broken = broken.unionByName(broken.filter(at("twice"))).filter(~at("gap")).unionByName(broken.filter(at("good")).withColumn("site", F.lit(None).cast("string")))
    cut = layers.filter(~at("bare") & ~at("gap")).withColumn("landcover", F.when(at("cover"), "grass").otherwise(F.col("landcover")))
    out = runs.run_sites(broken, cut, 30.0, F.when(F.col("site") == "flat", -1.0).otherwise(31.0))
    status = {r.site: (r.ok, r.reason, r.cells, r.bad_cells) for r in out["status"].collect()}
    assert status == {"good": (True, None, 72, 0), "fine": (True, None, 72, 0), "text": (False, "elevation is no number", 72, 1), "twice": (False, "cell is there twice", 72, 1),
                      "bare": (False, "cell without layer row", 72, 1), "gap": (False, "grid has gaps", 71, 0), "flat": (False, "cell size is not positive", 72, 72),
                      "cover": (False, "landcover is no number", 72, 1), None: (False, "cell without a place", 1, 1)}
    assert out["quarantine"].count() == 77 and out["seen"].get["failing"] == 77 and out["seen"].get["cells"] == 8 * 72
    typed = dem.withColumn("z", F.when(at("good"), None).otherwise(F.col("z").cast("double"))).filter("site IN ('good', 'fine')")
    alone = flows.build_features(typed.select(*KEY, "z"), layers.filter("site IN ('good', 'fine')").withColumn("landcover", F.col("landcover").cast("double")), 30.0, 31.0)
    a, b = (sorted(map(tuple, d.select(sorted(d.columns)).collect())) for d in (alone, out["features"]))
    assert a == b and len(a) == 144
