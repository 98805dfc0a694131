import datetime as dt

import pytest
from pyspark.sql import functions as F

from terravane.operators import feeds as W, imagery
from terravane.sources import feeds as SF, grids as SG, tables as ST
from terravane.streaming import feeds as stream


def test_ascii_grid_split_over_many_tasks(spark, tmp_path):
    rows, cols = 57, 13
    text = f"ncols {cols}\nnrows {rows}\nxllcenter 10\nyllcenter 20\ncellsize 2\nNODATA_value -9999\n"
    text += "\n".join(" ".join("-9999" if (r, c) == (3, 4) else f"{r * 100 + c}.5" for c in range(cols)) for r in range(rows)) + "\n"
    for step in (0, 7):
        (tmp_path / f"run_hflow_max{step:04d}.asc").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = SG.read_step_grids(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2 * rows * cols and {(r.variable, r.step) for r in got} == {("hflow_max", 0), ("hflow_max", 7)}
    for r in got:
        assert r.value == (None if (r.r, r.c) == (3, 4) else r.r * 100 + r.c + 0.5)
        assert (r.x, r.y) == (10 + 2 * r.c, 20 + 2 * (rows - 1 - r.r))


def test_registry_and_training_checks(spark, tmp_path):
    (tmp_path / "sites.json").write_text('{"site":"a","bbox":{"west":1,"south":2,"east":3,"north":4},"category":"Flood"}\n{"site":"b","category":"safe"}\n')
    reg = ST.read_registry(spark, str(tmp_path / "sites.json"))
    assert [r.site for r in ST.by_category(reg, "flood").collect()] == ["a"]
    assert ST.site_bbox(reg, "a") == (1.0, 2.0, 3.0, 4.0)
    with pytest.raises(KeyError):
        ST.site_bbox(reg, "zzz")
    (tmp_path / "bad.csv").write_text("row,col,slope\n1,2,3\n")
    with pytest.raises(ValueError):
        ST.read_training(spark, str(tmp_path / "bad.csv"))


def test_dam_feed_shapes_aliases_and_alerts(spark):
    bodies = [
        '[{"name":"A","redLevel":"10","blueLevel":"5","data":[{"waterLevel":"11"},{"waterLevel":"1"}]}]',
        '{"dams":[{"damName":"B","waterLevel":7,"blue_level":5},{"waterLevel":"high","redLevel":1}]}',
        "<html>busy</html>", None, "{}",
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = {r.name: r for r in W.normalise_dams(SF.read_dam_feed(df)).collect()}
    assert set(got) == {"A", "B", "Unknown"}
    assert (got["A"].alert, got["B"].alert, got["Unknown"].alert) == ("RED", "BLUE", "NORMAL")
    assert got["Unknown"].current_level is None and got["B"].inflow == 0.0
    order = [r.alert for r in W.severity_sort(W.normalise_dams(SF.read_dam_feed(df))).collect()]
    assert order == ["RED", "BLUE", "NORMAL"]


def test_rss_and_alerts(spark):
    xml = ("<rss><channel><title>t</title><item><title> idukki </title><description>Severe squall</description></item>"
           "<item><title>Elsewhere</title></item><item><title>North Kerala</title><description>Severe squall</description><link>u</link></item>"
           "<item><title>WAYANAD</title><description>heavy rain</description></item></channel></rss>")
    items = SF.read_alert_rss(spark.createDataFrame([(xml,)], "body string"))
    assert items.count() == 4
    kept = W.present_alerts(W.dedupe_alerts(W.regional_alerts(items), "pos")).collect()
    assert {(r.pos, r.severity, r.headline) for r in kept} == {(0, "RED", "Warning for Idukki"), (3, "ORANGE", "Warning for Wayanad")}


def test_weather_series(spark):
    start = dt.datetime(2024, 1, 1)
    hours = [start + dt.timedelta(hours=h) for h in range(60) if h != 5]
    df = spark.createDataFrame([(0, h, float(i % 17), None if i == 58 else 20.0) for i, h in enumerate(hours)], "station int, hour timestamp, rain_mm_h double, temp_c double")
    assert W.current_index(df, hours[10]).head().base_idx == 10
    assert W.current_index(df, start + dt.timedelta(hours=5)).head().base_idx == 0
    assert W.current_index(df, hours[10] + dt.timedelta(minutes=20), floor=True).head().base_idx == 10
    last = W.forecast_at(df, hours[10], 500, {"temp_c": 26.0}).head()
    assert last.idx == 58 and last.temp_c == 26.0
    peaks = {r.hour: r.peak for r in W.peak_rain(df).collect()}
    rain = [float(i % 17) for i in range(59)]
    assert all(peaks[h] == max(rain[max(0, i - 12):i + 12]) for i, h in enumerate(hours))
    before = {r.hour: r.rain_before for r in W.antecedent_rain(df).collect()}
    for i, h in enumerate(hours):
        assert before[h] == sum(rain[j] for j, g in enumerate(hours) if dt.timedelta(0) < h - g <= dt.timedelta(hours=48))


def test_fallback_filter(spark):
    df = spark.createDataFrame([(0, 10), (0, 40), (1, 40), (2, 90)], "site int, cloud_pct int")
    strict, relaxed = F.col("cloud_pct") < 20, F.col("cloud_pct") < 50
    got = imagery.with_fallback(df, strict, relaxed, on_empty="drop").collect()
    assert sorted(map(tuple, got)) == [(0, 10), (1, 40)]
    with pytest.raises(Exception, match="no scenes"):
        imagery.with_fallback(df, strict, relaxed).collect()


def test_streams_equal_batch_within_the_watermark(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(d, t0 + dt.timedelta(minutes=7 * i + d), float(50 + (i * 13 + d) % 90), 120.0, 90.0, 60.0) for i in range(40) for d in range(3)]
    flush = [(9, t0 + dt.timedelta(days=2), 1.0, 120.0, 90.0, 60.0)]
    schema = "dam_id int, ts timestamp, level double, red double, orange double, blue double"
    src = tmp_path / "in"
    for part in (rows[:60], rows[60:], flush, flush):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    s = stream.file_stream(spark, str(src), spark.createDataFrame([], schema).schema)
    q = stream.run_to_table(stream.dam_states(s, late="1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r.dam_id, r.window_start, r.last_ts, r.level) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = W.refresh_window(spark.createDataFrame(rows, schema), "dam_id", "ts", 60, "level").collect()
    assert got == {(r.dam_id, r.window_start, r.last_ts, r.level) for r in batch}

    items = [(i, t0 + dt.timedelta(minutes=i), "IDUKKI" if i % 2 else "DELHI", f" heavy rain {i % 5}") for i in range(30)]
    schema = "event_id int, published timestamp, title string, description string"
    src = tmp_path / "alerts"
    spark.createDataFrame(items, schema).coalesce(1).write.parquet(str(src))
    s = stream.file_stream(spark, str(src), spark.createDataFrame([], schema).schema)
    stream.run_to_table(stream.alert_stream(s), str(tmp_path / "out2"), str(tmp_path / "ck2")).awaitTermination()
    got = {(r.description, r.severity) for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    want = W.present_alerts(W.dedupe_alerts(W.regional_alerts(spark.createDataFrame(items, schema)), "event_id")).collect()
    assert got == {(r.description.strip(), r.severity) for r in want} and len(want) == 5
