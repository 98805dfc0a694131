"""Files of many sites: their number must not grow with tasks or with steps times sites, and sites may have any number."""

import glob
import os

from pyspark.sql import functions as F

from catalog import QUERIES, q_sources

GIVEN = "/root/testdata/sf0.001"


def _folder(spark, tmp_path, monkeypatch, sites):
    """The one site of the smallest tables under several numbers; scratch folders go below ``tmp_path``."""
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{GIVEN}/{table}.parquet").filter(F.col(key) < 1500)
        moved = rows.withColumn("_site", F.explode(F.array(*[F.lit(s) for s in sites]))).withColumn(key, F.col(key) + F.col("_site") * 1500)
        moved.drop("_site").repartition(8).write.parquet(f"{tmp_path}/data/{table}.parquet")
    monkeypatch.setattr(q_sources, "scratch", lambda v, kind: f"{tmp_path}/{kind}")
    return f"{tmp_path}/data"


def test_step_grids_share_files_and_keep_sites_apart(spark, tmp_path, monkeypatch):
    data = _folder(spark, tmp_path, monkeypatch, [0, 5, 63, 64, 200])
    got = QUERIES["s12_read_step_grids"](spark, data).select("site", "variable", "step", "r", "c", "value")
    k = F.col("l_orderkey")
    want = spark.read.parquet(f"{data}/lineitem.parquet").groupBy(k, "l_linenumber").agg((F.max("l_quantity") / 10).alias("h")).select(
        F.floor(k / 1500).cast("int"), F.lit("hflow"), F.col("l_linenumber").alias("step"), F.floor(k % 1500 / 50).cast("int"), (k % 50).cast("int"), "h")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
    # Sites 0, 5 and 63, site 64 and site 200: three runs of seven steps.
    assert len(glob.glob(f"{tmp_path}/steps/name=*/*.txt")) == 3 * 7


def test_point_tables_of_more_than_9999_sites(spark, tmp_path, monkeypatch):
    data = _folder(spark, tmp_path, monkeypatch, [3, 1234, 12345])
    got = QUERIES["s13_read_xyz_csv"](spark, data)
    assert {r.step: r["count"] for r in got.groupBy("step").count().collect()} == {3: 1500, 1234: 1500, 12345: 1500}
    folders = sorted(os.path.basename(d) for d in glob.glob(f"{tmp_path}/xyz/name=*"))
    assert folders == ["name=pv0003", "name=pv1234", "name=pv12345"]
    assert len(glob.glob(f"{tmp_path}/xyz/name=*/*.csv")) == 3
