"""Queries of weather, reservoir and alert feeds, and their streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.base import query, rnd
from catalog.q_sources import dam_bodies, scratch
from terravane.functions import feeds as K
from terravane.operators import feeds as W
from terravane.operators.joins import attach
from terravane.operators.places import first_named
from terravane.sources.feeds import read_dam_feed
from terravane.streaming import feeds as ST

NOW = dt.datetime(2024, 1, 10, 5, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-10 05:00:00'"
BASE = f"bi AS (SELECT station, CASE WHEN MAX(CASE WHEN hour = {NOW_SQL} THEN 1 ELSE 0 END) = 1 THEN COUNT(*) FILTER (hour < {NOW_SQL}) ELSE 0 END AS base_idx FROM weather_hourly GROUP BY station)"
INDEXED = "ix AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY station ORDER BY hour) - 1 AS idx, COUNT(*) OVER (PARTITION BY station) AS n FROM weather_hourly)"


@query("w1_current_index", f"WITH {BASE} SELECT station, base_idx FROM bi")
def _(v):
    return W.current_index(v.weather_hourly, NOW)


@query("w2_forecast_at", f"WITH {BASE}, {INDEXED} SELECT station, idx, hour, rain_mm_h, temp_c FROM ix JOIN bi USING (station) WHERE idx = GREATEST(0, LEAST(base_idx + 48, n - 1))")
def _(v):
    return W.forecast_at(v.weather_hourly, NOW, 48, {"rain_mm_h": 0.0, "temp_c": 26.0})


@query("w3_peak_rain", "SELECT station, hour, MAX(rain_mm_h) OVER (PARTITION BY station ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS peak FROM weather_hourly")
def _(v):
    return W.peak_rain(v.weather_hourly).select("station", "hour", "peak")


CODES = " ".join(f"WHEN {k} THEN '{t}'" for k, t in K.WEATHER_CODES.items())


@query("w4_weather_code_text", f"SELECT station, hour, CASE weather_code {CODES} ELSE 'Partly cloudy' END || CASE WHEN station > 0 THEN ' (+' || station * 24 || 'h)' ELSE '' END AS description FROM weather_hourly")
def _(v):
    return v.weather_hourly.select("station", "hour", K.weather_text(F.col("weather_code"), F.col("station") * 24).alias("description"))


@query("w5_source_priority", """WITH an AS (SELECT c_custkey AS place, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'primary' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'secondary' ELSE 'other' END AS source,
  GREATEST(c_acctbal / 100, c_acctbal / 50) AS rain FROM customer WHERE c_nationkey < 20 UNION ALL SELECT c_custkey, 'secondary', 3.5e0 FROM customer WHERE c_custkey % 3 = 0),
b AS (SELECT place, ARG_MIN({'source': source, 'rain': rain}, CASE source WHEN 'primary' THEN 0 ELSE 1 END) AS s FROM (SELECT place, source, CASE WHEN source = 'secondary' THEN MAX(rain) ELSE ANY_VALUE(rain) END AS rain
  FROM an WHERE source <> 'other' GROUP BY place, source) GROUP BY place)
SELECT c_custkey AS place, COALESCE(s.source, 'fallback') AS source, RND(COALESCE(s.rain, 1.5e0)) AS rainfall_mm_h, CASE WHEN s IS NULL THEN 26e0 ELSE 20e0 END AS temp_c FROM customer LEFT JOIN b ON place = c_custkey""")
def _(v):
    seg = F.col("c_mktsegment")
    src = F.when(seg.isin("BUILDING", "MACHINERY"), "primary").when(seg == "HOUSEHOLD", "secondary").otherwise("other")

    def answer(df, source, rain, instant):
        return df.select(F.col("c_custkey").alias("place"), source.alias("source"), F.lit(20.0).alias("temp_c"), F.lit(80.0).alias("humidity"),
                         rain.alias("rainfall_mm_h"), instant.alias("rain_instant_mm_h"), F.lit(1.0).alias("daily_total_mm"), F.lit(2.0).alias("wind_speed_kmh"),
                         F.lit("x").alias("description"))

    a = answer(v.customer.filter("c_nationkey < 20"), src, F.col("c_acctbal") / 100, F.col("c_acctbal") / 50)
    b = answer(v.customer.filter("c_custkey % 3 = 0"), F.lit("secondary"), F.lit(3.5), F.lit(1.0))
    # One answer per place and provider: the larger rain of the duplicates.
    both = a.unionByName(b)
    one = both.withColumn("_r", F.greatest("rainfall_mm_h", "rain_instant_mm_h")).groupBy("place", "source").agg(F.max_by(F.struct(*both.columns[2:]), "_r").alias("s")).select("place", "source", "s.*")
    out = W.source_priority(v.customer.select(F.col("c_custkey").alias("place")), one, ["primary", "secondary"])
    return out.select("place", "source", rnd("rainfall_mm_h").alias("rainfall_mm_h"), "temp_c")


@query("w6_unit_convert", """SELECT station, hour, RND(temp_c * 3.6e0) AS wind_kmh, COALESCE(CASE WHEN weather_code % 2 = 0 THEN rain_mm_h END, CASE WHEN weather_code % 3 = 0 THEN temp_c END, 0e0) AS rate,
 RND(rain_mm_h * 24) AS daily, RND(rain_mm_h / 1000 / 3600 * 1000000) AS um_s FROM weather_hourly""")
def _(v):
    code = F.col("weather_code")
    return v.weather_hourly.select("station", "hour", rnd(K.kmh(F.col("temp_c"))).alias("wind_kmh"),
        K.rain_rate(F.when(code % 2 == 0, F.col("rain_mm_h")), F.when(code % 3 == 0, F.col("temp_c"))).alias("rate"),
        rnd(K.day_total(F.col("rain_mm_h"))).alias("daily"), rnd(K.metres_per_second(F.col("rain_mm_h")) * 1000000).alias("um_s"))


@query("w7_daily_total", """WITH d AS (SELECT station, CAST(hour AS DATE) AS day, SUM(rain_mm_h) AS t FROM weather_hourly GROUP BY ALL)
SELECT station, day, RND(t) AS daily_total_mm, day = MIN(day) OVER (PARTITION BY station) AS first_day FROM d""")
def _(v):
    d = W.daily_total(v.weather_hourly)
    first = d.groupBy("station").agg(F.min("day").alias("_d0"))
    return attach(d, first, ["station"]).select("station", "day", rnd("daily_total_mm").alias("daily_total_mm"), (F.col("day") == F.col("_d0")).alias("first_day"))


DAM_SQL = """dn AS (SELECT event_id, 'dam_' || user_id AS name, 'IDUKKI' AS district, FLOOR(value) AS current_level, 0e0 AS inflow, 9.5e0 AS lat FROM events WHERE event_id % 4 = 0
 UNION ALL SELECT event_id, 'dam_' || user_id, '', FLOOR(value), CAST(event_id % 7 AS DOUBLE), NULL FROM events WHERE event_id % 4 < 2),
da AS (SELECT *, CASE WHEN current_level >= 120 THEN 'RED' WHEN current_level >= 90 THEN 'ORANGE' WHEN current_level >= 60 THEN 'BLUE' ELSE 'NORMAL' END AS alert FROM dn)"""


@query("w8_normalise_dam", f"WITH {DAM_SQL} SELECT name, district, current_level, inflow, 0e0 AS spillway_release, lat, alert FROM da")
def _(v):
    return W.normalise_dams(read_dam_feed(dam_bodies(v))).select("name", "district", "current_level", "inflow", "spillway_release", "lat", "alert")


@query("w9_dam_alert", """SELECT event_id, CASE WHEN level >= red THEN 'RED' WHEN level >= orange_lvl THEN 'ORANGE' WHEN level >= blue THEN 'BLUE' ELSE 'NORMAL' END AS alert FROM dam_readings""")
def _(v):
    return v.dam_readings.select("event_id", K.dam_alert(F.col("level"), F.col("red"), F.col("orange_lvl"), F.col("blue")).alias("alert"))


@query("w10_district_filter", "SELECT s_suppkey, n_name AS district FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE LOWER(n_name) LIKE '%ion\\_1%' ESCAPE '\\'")
def _(v):
    d = v.supplier.join(v.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.col("n_name").alias("district"))
    return W.district_filter(d, "Ion_1")


@query("w11_severity_sort", """WITH a AS (SELECT event_id, CASE WHEN level >= red THEN 'RED' WHEN level >= orange_lvl THEN 'ORANGE' WHEN level >= blue THEN 'BLUE' ELSE 'NORMAL' END AS alert FROM dam_readings)
SELECT event_id, alert, CASE alert WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 WHEN 'BLUE' THEN 2 ELSE 3 END AS rank FROM a ORDER BY rank, event_id""")
def _(v):
    a = v.dam_readings.select("event_id", K.dam_alert(F.col("level"), F.col("red"), F.col("orange_lvl"), F.col("blue")).alias("alert"))
    return W.severity_sort(a, "alert", "event_id").withColumn("rank", K.alert_rank(F.col("alert")))


AREA = (("NATION_2", "NATION_3"), "NATION_1")
REGIONAL = "rg AS (SELECT * FROM alert_items WHERE title IN ('NATION_2', 'NATION_3') OR CONTAINS(title, 'NATION_1'))"


@query("w12_regional_alerts", f"WITH {REGIONAL} SELECT event_id, title FROM rg")
def _(v):
    return W.regional_alerts(v.alert_items, *AREA).select("event_id", "title")


@query("w13_dedupe_alerts", f"WITH {REGIONAL} SELECT description, MIN(event_id) AS event_id FROM rg GROUP BY description")
def _(v):
    return W.dedupe_alerts(W.regional_alerts(v.alert_items, *AREA), "event_id").select("description", "event_id")


SEVERITY = "CASE WHEN CONTAINS(LOWER(description), 'very heavy') THEN 'RED' WHEN CONTAINS(LOWER(description), 'heavy') OR CONTAINS(LOWER(description), 'moderate thunderstorms') THEN 'ORANGE' ELSE 'YELLOW' END"


@query("w14_alert_severity", f"SELECT event_id, {SEVERITY} AS severity, 'Warning for ' || UPPER(title[1]) || LOWER(title[2:]) AS headline FROM alert_items")
def _(v):
    return W.present_alerts(v.alert_items).select("event_id", "severity", "headline")


@query("w15_antecedent_rain_48h", """WITH s AS (SELECT station, hour, SUM(rain_mm_h) OVER (PARTITION BY station ORDER BY hour RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND INTERVAL 1 SECONDS PRECEDING) AS t FROM weather_hourly)
SELECT station, hour, RND(COALESCE(t, 0)) AS rain_before, RND9(COALESCE(t, 0) / 48) AS intensity FROM s""")
def _(v):
    a = W.antecedent_rain(v.weather_hourly)
    return a.select("station", "hour", rnd("rain_before").alias("rain_before"), rnd("intensity", 9).alias("intensity"))


PLACES = """pq AS (SELECT c_custkey, CASE c_custkey % 20 WHEN 0 THEN ' Periyar bank ' WHEN 1 THEN 'NILA view' WHEN 2 THEN 'kallada and pamba' ELSE 'Town' END || ' ' || c_custkey AS place FROM customer),
pc AS (SELECT place, o_orderkey AS rank, CASE WHEN o_orderkey % 7 = 0 THEN 'Hill, Kerala, India' ELSE 'Hill, India' END AS display_name,
  CASE WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE CAST(6 + o_orderkey % 10 AS VARCHAR(9)) END AS lat, CAST(73 + o_orderkey % 7 AS VARCHAR(9)) AS lon FROM orders JOIN pq ON c_custkey = o_custkey WHERE c_custkey % 9 <> 4)"""
RIVER_SQL = "CASE WHEN CONTAINS(LOWER(pq.place), 'periyar') THEN 10.05e0 WHEN CONTAINS(LOWER(pq.place), 'pamba') THEN 9.35e0 WHEN CONTAINS(LOWER(pq.place), 'nila') THEN 10.8e0 WHEN CONTAINS(LOWER(pq.place), 'kallada') THEN 9e0 END"
RESOLVED = PLACES + f""",
ck AS (SELECT *, CASE WHEN CONTAINS(LOWER(display_name), 'kerala') THEN 0 WHEN TRY_CAST(lat AS DOUBLE) BETWEEN 8 AND 13 AND TRY_CAST(lon AS DOUBLE) BETWEEN 74.5 AND 78 THEN 1 END AS g FROM pc),
cb AS (SELECT * FROM ck WHERE g IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY place ORDER BY g, rank) = 1),
rp AS (SELECT pq.place, pq.c_custkey, COALESCE({RIVER_SQL}, TRY_CAST(cb.lat AS DOUBLE)) AS lat, CASE WHEN {RIVER_SQL} IS NULL THEN TRY_CAST(cb.lon AS DOUBLE) END AS cand_lon,
  CASE WHEN {RIVER_SQL} IS NOT NULL THEN 'river' WHEN cb.place IS NOT NULL THEN 'candidate' ELSE 'unmatched' END AS matched FROM pq LEFT JOIN cb USING (place))"""


def place_queries(v):
    k = F.col("c_custkey")
    head = F.when(k % 20 == 0, " Periyar bank ").when(k % 20 == 1, "NILA view").when(k % 20 == 2, "kallada and pamba").otherwise("Town")
    return v.customer.select(k, F.concat(head, F.lit(" "), k.cast("string")).alias("place"))


def place_candidates(v):
    k = F.col("o_orderkey")
    o = v.orders.join(place_queries(v).filter("c_custkey % 9 <> 4"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select("place", k.alias("rank"), F.when(k % 7 == 0, "Hill, Kerala, India").otherwise("Hill, India").alias("display_name"),
                    F.when(k % 11 == 0, "bad").otherwise((6 + k % 10).cast("string")).alias("lat"), (73 + k % 7).cast("string").alias("lon"))


@query("w16_resolve_place", f"WITH {RESOLVED} SELECT c_custkey, lat, cand_lon, matched FROM rp")
def _(v):
    r = W.resolve_place(place_queries(v), place_candidates(v))
    return r.select("c_custkey", "lat", F.when(F.col("bbox").isNull(), F.col("lon")).alias("cand_lon"), "matched")


# A name for every customer, some inside others ('town 12' in 'Town 123'): the first of the table that the text holds.
@query("w16_named_places", f"""WITH {PLACES}, nm AS (SELECT 'TOWN ' || c_custkey AS key, c_custkey * 7919 % 1000003 AS rank FROM customer UNION ALL SELECT 'NILA', 2000000),
ft AS (SELECT c_custkey, ARG_MIN(key, rank) AS key FROM pq JOIN nm ON CONTAINS(LOWER(place), LOWER(key)) GROUP BY c_custkey)
SELECT pq.c_custkey, ft.key, ft.key IS NOT NULL AS named FROM pq LEFT JOIN ft USING (c_custkey)""")
def _(v):
    k = F.col("c_custkey")
    names = v.customer.select(F.concat(F.lit("TOWN "), k.cast("string")).alias("key"), (k * 7919 % 1000003).cast("long").alias("rank")).unionByName(
        v.spark.range(1).select(F.lit("NILA").alias("key"), F.lit(2_000_000).cast("long").alias("rank")))
    found = first_named(place_queries(v), names, "place").join(names.withColumnRenamed("rank", "name_rank"), "name_rank", "left")
    return found.select("c_custkey", "key", F.col("key").isNotNull().alias("named"))


@query("w17_sanitize_name", "SELECT p_partkey, REPLACE(REPLACE(REPLACE(TRIM(LOWER(p_name || ', ' || p_brand || '. ')), ' ', '_'), ',', ''), '.', '') || '_' || p_size || 'h' AS name FROM part")
def _(v):
    n = F.concat("p_name", F.lit(", "), "p_brand", F.lit(". "))
    return v.part.select("p_partkey", K.safe_name(n, F.col("p_size")).alias("name"))


@query("w18_refresh_window", """SELECT dam_id, DATE_TRUNC('hour', ts) AS window_start, MAX(ts) AS last_ts, LAST(level ORDER BY ts, event_id) AS level FROM dam_readings GROUP BY dam_id, DATE_TRUNC('hour', ts)""")
def _(v):
    return W.refresh_window(v.dam_readings, "dam_id", "ts", 60, "level", tie="event_id")


def _stream(v):
    schema = v.events.schema
    s = ST.file_stream(v.spark, v.sf_dir, schema, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(v, stream):
    out = scratch(v, "stream")
    q = ST.run_to_table(stream, f"{out}/table", f"{out}/checkpoint")
    q.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{out}/table")


# The stream emits the windows that the watermark (two hours behind) has passed.
@query("w19_dam_stream", """SELECT dam_id, DATE_TRUNC('hour', ts) AS window_start, MAX(ts) AS last_ts, ARG_MAX(level, ts) AS level,
 CASE WHEN ARG_MAX(level, ts) >= 120 THEN 'RED' WHEN ARG_MAX(level, ts) >= 90 THEN 'ORANGE' WHEN ARG_MAX(level, ts) >= 60 THEN 'BLUE' ELSE 'NORMAL' END AS alert
FROM dam_readings GROUP BY dam_id, DATE_TRUNC('hour', ts) HAVING DATE_TRUNC('hour', MAX(ts)) + INTERVAL 3 HOURS <= (SELECT MAX(ts) FROM dam_readings)""")
def _(v):
    r = _stream(v).select(F.col("user_id").alias("dam_id"), "ts", F.col("value").alias("level"), F.lit(120.0).alias("red"), F.lit(90.0).alias("orange"), F.lit(60.0).alias("blue"))
    return _run(v, ST.dam_states(r))


@query("w19_alert_stream", f"WITH {REGIONAL}, ev AS (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'Very heavy rain' WHEN 'purchase' THEN 'Heavy rain' ELSE 'Light rain' END || ' zone ' || user_id % 20 AS description FROM events WHERE 'NATION_' || user_id % 25 IN ('NATION_2', 'NATION_3') OR CONTAINS('NATION_' || user_id % 25, 'NATION_1')) SELECT description, {SEVERITY} AS severity FROM ev")
def _(v):
    text = F.when(F.col("event_type") == "error", "Very heavy rain").when(F.col("event_type") == "purchase", "Heavy rain").otherwise("Light rain")
    items = _stream(v).select("event_id", F.col("ts").alias("published"), F.concat(F.lit("NATION_"), F.col("user_id") % 25).alias("title"),
                              F.concat(text, F.lit(" zone "), F.col("user_id") % 20).alias("description"))
    return _run(v, ST.alert_stream(items, districts=AREA[0], state=AREA[1])).select("description", "severity")


# Several files, the later ones with repeats of the earlier: once per description over the whole feed.
@query("w13_first_alerts_stream", f"WITH {REGIONAL} SELECT description, MIN(event_id) AS event_id, ANY_VALUE({SEVERITY}) AS severity FROM rg GROUP BY description")
def _(v):
    folder = scratch(v, "feed")
    items = v.alert_items
    items.withColumn("part", F.pmod(F.col("event_id"), F.lit(3))).repartition("part").write.partitionBy("part").parquet(folder)
    feed = ST.file_stream(v.spark, f"{folder}/part=*", items.schema)
    out = scratch(v, "stream")
    once = ST.first_alerts(feed, "event_id", districts=AREA[0], state=AREA[1])
    ST.run_to_table(once, f"{out}/table", f"{out}/checkpoint", mode="update").awaitTermination()
    rows = v.spark.read.schema(once.schema).parquet(f"{out}/table")
    return ST.latest_revision(rows).select("description", "event_id", "severity")


SITE_SCORE = """sv AS (SELECT site, LEAST(100e0, 100 * (0.3e0 * QUANTILE_CONT(p, 0.9) + 0.2e0 * MAX(p) + 0.3e0 * COALESCE(AVG(p) FILTER (p > 0.5), 0) + 0.2e0 * AVG(CASE WHEN p > 0.5 THEN 1e0 ELSE 0e0 END))) AS score,
  LEAST(100e0, 100 * AVG(2 * ABS(p - 0.5e0))) AS confidence FROM scored WHERE p BETWEEN 0 AND 1 GROUP BY site)"""


def place_sites(v):
    k = F.col("c_custkey")
    return place_queries(v).select("place", F.floor(k * 10 / 1500).cast("int").alias("site"))


def place_weather(v):
    return place_queries(v).filter("c_custkey % 4 <> 3").select("place", (F.col("c_custkey") % 120).cast("double").alias("rainfall_mm_h"))


PLACE_SITES = "ps AS (SELECT place, CAST(FLOOR(c_custkey * 10 / 1500) AS INT) AS site FROM pq), pw AS (SELECT place, CAST(c_custkey % 120 AS DOUBLE) AS rainfall_mm_h FROM pq WHERE c_custkey % 4 <> 3)"


@query("w20_join_scores_weather", f"WITH {PLACES}, {PLACE_SITES}, {SITE_SCORE} SELECT place, site, RND(score) AS score, rainfall_mm_h FROM ps LEFT JOIN sv USING (site) LEFT JOIN pw USING (place)")
def _(v):
    from terravane.operators.risk import site_scores

    j = W.join_scores_weather(place_sites(v), site_scores(v.scored), place_weather(v))
    return j.select("place", "site", rnd("score").alias("score"), "rainfall_mm_h")
