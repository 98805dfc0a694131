"""Views over the given tables that carry the shapes of hazard data.

The same text runs in Spark SQL and in DuckDB.  1,500 consecutive order keys
form one site of 30 x 50 cells.  Values are rounded by FLOOR: the engines' ROUND
differs in the last digit of exact halves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "cells": """
SELECT CAST(FLOOR(o_orderkey / 1500) AS INT) AS site,
       CAST(FLOOR((o_orderkey % 1500) / 50) AS INT) AS r,
       CAST(o_orderkey % 50 AS INT) AS c,
       o_orderkey AS cell_id,
       CASE WHEN o_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE)
            ELSE FLOOR((2.0 * (29 - FLOOR((o_orderkey % 1500) / 50)) + o_totalprice / 20000.0) * 100 + 0.5) / 100 END AS z
FROM orders""",
    "layers": """
SELECT o_orderkey AS cell_id,
       CASE o_custkey % 11 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40
            WHEN 4 THEN 50 WHEN 5 THEN 60 WHEN 6 THEN 70 WHEN 7 THEN 80 WHEN 8 THEN 90
            WHEN 9 THEN 95 ELSE 100 END AS landcover,
       CAST(200 + o_custkey % 401 AS DOUBLE) AS sand_raw,
       CAST(100 + (o_orderkey * 7) % 501 AS DOUBLE) AS silt_raw,
       CAST(50 + (o_orderkey * 13) % 451 AS DOUBLE) AS clay_raw,
       CAST(5 + o_custkey % 60 AS DOUBLE) AS soc_raw,
       CAST((o_orderkey * 31) % 101 AS INT) AS water_occurrence
FROM orders""",
    "labels_grid": """
SELECT o_orderkey AS cell_id,
       CASE WHEN FLOOR(o_orderkey / 1500) % 4 < 3
             AND FLOOR((o_orderkey % 1500) / 50) BETWEEN 10 AND 14
             AND o_orderkey % 50 BETWEEN 20 AND 30 THEN 1 ELSE 0 END AS label
FROM orders""",
    "obs": """
SELECT l_orderkey AS cell_id, l_shipdate AS acquired,
       CASE WHEN l_returnflag = 'R' THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit,
       CASE WHEN l_linestatus = 'O' THEN 'IW' ELSE 'EW' END AS mode,
       l_suppkey % 100 AS cloud_pct,
       CASE l_linenumber WHEN 1 THEN 1024 WHEN 2 THEN 2048 WHEN 3 THEN 1 ELSE 0 END AS qa60,
       l_linenumber AS scl,
       -5.0 - l_quantity / 2.0 AS vh,
       l_extendedprice * (0.3 + l_tax) AS b3,
       l_extendedprice * (0.2 + 5.0 * l_discount) AS b4,
       l_extendedprice AS b8
FROM lineitem""",
    "monthly_rain": """
SELECT l_orderkey AS cell_id, CAST(EXTRACT(MONTH FROM l_shipdate) AS INT) AS month,
       SUM(l_quantity) AS prec
FROM lineitem GROUP BY l_orderkey, EXTRACT(MONTH FROM l_shipdate)""",
    "steps": """
SELECT l_orderkey AS cell_id, l_linenumber AS step,
       MAX(l_quantity) / 10.0 AS h, MAX(l_discount) * 10.0 AS xmom, MAX(l_tax) * 10.0 AS ymom
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "weather_hourly": """
SELECT CAST(user_id % 3 AS INT) AS station, DATE_TRUNC('hour', ts) AS hour,
       SUM(CAST(ROUND(value * 100) AS BIGINT)) / CAST(1000 AS DOUBLE) AS rain_mm_h, MAX(value) AS temp_c,
       MAX(CAST(event_id % 100 AS INT)) AS weather_code
FROM events GROUP BY CAST(user_id % 3 AS INT), DATE_TRUNC('hour', ts)""",
    "dam_readings": """
SELECT user_id AS dam_id, ts, event_id, value AS level, CAST(60 AS DOUBLE) AS blue,
       CAST(90 AS DOUBLE) AS orange_lvl, CAST(120 AS DOUBLE) AS red, props
FROM events""",
    "alert_items": """
SELECT e.event_id, e.ts AS published, UPPER(n.n_name) AS title,
       CASE e.event_type WHEN 'error' THEN 'Very heavy rain' WHEN 'purchase' THEN 'Heavy rain'
            WHEN 'signup' THEN 'Moderate thunderstorms' ELSE 'Light rain' END || ' zone ' ||
       CAST(e.user_id % 20 AS VARCHAR(10)) AS description
FROM events e JOIN nation n ON n.n_nationkey = CAST(e.user_id % 25 AS INT)""",
    "scored": """
SELECT o_orderkey AS cell_id, CAST(FLOOR(o_orderkey / 1500) AS INT) AS site,
       CAST(FLOOR((o_orderkey % 1500) / 50) AS INT) AS r, CAST(o_orderkey % 50 AS INT) AS c,
       CASE WHEN o_orderkey % 53 = 0 THEN CAST(-9999 AS DOUBLE)
            ELSE FLOOR(o_totalprice / 500.0 + 0.5) / 1000 END AS p,
       CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS y,
       CAST(o_custkey % 5 AS INT) AS fold
FROM orders""",
    # Ready-made per-cell features, independent of the terrain operators.
    "stack": """
SELECT CAST(FLOOR(o.o_orderkey / 1500) AS INT) AS site,
       CAST(FLOOR((o.o_orderkey % 1500) / 50) AS INT) AS r, CAST(o.o_orderkey % 50 AS INT) AS c,
       o.o_orderkey AS cell_id,
       CASE WHEN o.o_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE)
            WHEN o.o_orderkey % 101 = 0 THEN CAST(NULL AS DOUBLE)
            ELSE FLOOR(o.o_totalprice / 20.0 + 0.5) / 100 END AS elevation,
       CASE WHEN o.o_orderkey % 211 = 0 THEN CAST(NULL AS DOUBLE)
            ELSE CAST((o.o_custkey * 7 + o.o_orderkey) % 450 AS DOUBLE) / 10.0 END AS slope,
       CAST((o.o_orderkey * 37) % 360 AS DOUBLE) AS aspect,
       CAST(o.o_custkey % 21 - 10 AS DOUBLE) / 10.0 AS plan_curvature,
       CAST(o.o_orderkey % 21 - 10 AS DOUBLE) / 10.0 AS profile_curvature,
       CAST(o.o_orderkey % 35 - 5 AS DOUBLE) AS twi,
       CASE WHEN o.o_orderkey % 307 = 0 THEN CAST('Infinity' AS DOUBLE)
            ELSE CAST((o.o_orderkey * 3) % 900 AS DOUBLE) END AS dist_to_stream,
       CAST(o.o_custkey % 18 AS DOUBLE) / 10.0 AS soil_depth,
       CAST(o.o_custkey % 6 AS DOUBLE) AS cohesion,
       CAST(25 + o.o_custkey % 11 AS DOUBLE) AS phi,
       CAST(o.o_orderkey % 50 AS DOUBLE) / 100.0 AS k_factor,
       CAST(o.o_custkey % 100 AS DOUBLE) / 100.0 AS c_factor,
       CAST(3000 AS DOUBLE) AS r_factor,
       CAST(10 + o.o_custkey % 40 AS DOUBLE) / 1000.0 AS manning_n,
       FLOOR(o.o_totalprice / 100.0 + 0.5) / 10 AS rusle_soil_loss,
       CASE WHEN o.o_orderkey % 13 = 0 THEN CAST(999 AS DOUBLE)
            ELSE CAST(o.o_orderkey % 300 AS DOUBLE) / 100.0 END AS factor_of_safety,
       CAST(o.o_custkey % 50 AS DOUBLE) / 10.0 AS avaflow_depth,
       CAST(o.o_orderkey % 70 AS DOUBLE) / 10.0 AS avaflow_velocity,
       CASE o.o_custkey % 11 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40
            WHEN 4 THEN 50 WHEN 5 THEN 60 WHEN 6 THEN 70 WHEN 7 THEN 80 WHEN 8 THEN 90
            WHEN 9 THEN 95 ELSE 100 END AS landcover,
       CASE WHEN FLOOR(o.o_orderkey / 1500) % 4 < 3
             AND FLOOR((o.o_orderkey % 1500) / 50) BETWEEN 10 AND 14
             AND o.o_orderkey % 50 BETWEEN 20 AND 30 THEN 1 ELSE 0 END AS label
FROM orders o""",
}


def closure(names) -> list[str]:
    """The views ``names`` need, in definition order."""
    wanted = set(names)
    return [n for n in VIEWS if n in wanted]


class Views:
    """Lazy DataFrames of the tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run ``text``; names of tables and views in it become DataFrames."""
        used = {t: self.table(t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
