"""Streams over several batches, with rows that come too late.

A batch judges lateness by the watermark of the batch before it, so a late row comes two batches after the row that
moves the watermark.
"""

from pyspark.sql import functions as F

from terravane.streaming import feeds as ST


def _stream(spark, tmp_path, batches, schema):
    """One file per batch, replayed in order of name and time."""
    import os
    import time

    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        name = next(f for f in os.listdir(f"{tmp_path}/part{i}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.link(f"{tmp_path}/part{i}/{name}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (time.time() - 1000 + i,) * 2)
    typed = spark.read.parquet(f"{tmp_path}/in/0.parquet").schema
    return ST.file_stream(spark, f"{tmp_path}/in", typed)


def test_late_alert_is_dropped_and_repeats_across_batches_are_one(spark, tmp_path):
    row = lambda t, text: ("IDUKKI", text, f"2024-01-01 {t}")
    batches = [[row("10:00:00", "Heavy rain")], [row("10:30:00", "Heavy rain"), row("20:00:00", "Light rain")], [row("20:10:00", "Light rain")], [row("09:00:00", "Too late")], [row("21:00:00", "Very heavy rain")]]
    items = _stream(spark, tmp_path, batches, "title string, description string, ts string").withColumnRenamed("ts", "published")
    q = ST.run_to_table(ST.alert_stream(items), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination()
    got = sorted(r.description for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == ["Heavy rain", "Light rain", "Very heavy rain"]


def test_late_reading_does_not_change_a_closed_window(spark, tmp_path):
    row = lambda t, level: (1, f"2024-01-01 {t}", level, 120.0, 90.0, 60.0)
    batches = [[row("10:10:00", 50.0), row("10:20:00", 95.0)], [row("15:00:00", 10.0)], [row("15:05:00", 11.0)], [row("10:50:00", 130.0)], [row("20:00:00", 10.0)]]
    readings = _stream(spark, tmp_path, batches, "dam_id int, ts string, level double, red double, orange double, blue double")
    q = ST.run_to_table(ST.dam_states(readings), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination()
    got = {str(r.window_start): (r.level, r.alert) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01 10:00:00"] == (95.0, "ORANGE") and got["2024-01-01 15:00:00"] == (11.0, "NORMAL")


def test_sliding_rain(spark, tmp_path):
    row = lambda h, x: (3, f"2024-01-01 {h:02d}:00:00", x)
    batches = [[row(0, 1.0), row(1, 2.0)], [row(2, 4.0)], [row(12, 0.0)], [row(20, 0.0)]]
    hourly = _stream(spark, tmp_path, batches, "station int, ts string, rain_mm_h double")
    q = ST.run_to_table(ST.rain_windows(hourly, hours=2), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination()
    got = {str(r.until): (r.rain, r.intensity) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01 01:00:00"] == (1.0, 0.5) and got["2024-01-01 02:00:00"] == (3.0, 1.5) and got["2024-01-01 03:00:00"] == (6.0, 3.0)


def test_first_alerts_equal_the_batch_result_beyond_any_watermark(spark, tmp_path):
    from terravane.operators import feeds as W

    row = lambda n, t, text: (n, "IDUKKI", text, f"2024-01-{t}")
    batches = [[row(1, "01 10:00:00", "Heavy rain"), row(2, "01 10:05:00", " Heavy rain "), row(3, "01 11:00:00", "Light rain")],
               [row(4, "09 10:00:00", "Heavy rain"), row(6, "09 10:00:00", "Hail")],
               [row(5, "09 09:00:00", "Hail"), row(7, "20 10:00:00", "Light rain"), row(8, "20 10:00:00", None)],
               [row(9, "21 10:00:00", None), (10, "ELSEWHERE", "Fog", "2024-01-21 10:00:00")]]
    schema = "n long, title string, description string, ts string"
    items = lambda part, where: _stream(spark, where, part, schema)
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted(map(str, W.dedupe_alerts(W.regional_alerts(everything), "n").select("n", "description").collect()))
    first = ST.run_to_table(ST.first_alerts(items(batches, tmp_path), "n"), f"{tmp_path}/out", f"{tmp_path}/check", mode="update")
    first.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == 5 and rows.filter("description = 'Hail'").agg(F.max("revision")).head()[0] == 1
    assert sorted(map(str, ST.latest_revision(rows).select("n", "description").collect())) == want


def test_first_alerts_go_on_from_their_checkpoint(spark, tmp_path):
    import os
    import time

    row = lambda n, text: (n, "IDUKKI", text, f"2024-01-0{n} 10:00:00")
    batches = [[row(1, "Heavy rain")], [row(2, "Heavy rain"), row(3, "Light rain")], [row(4, "Light rain"), row(5, "Hail")]]
    stream = _stream(spark, tmp_path, batches, "n long, title string, description string, ts string")
    held = f"{tmp_path}/2.parquet"
    os.link(f"{tmp_path}/in/2.parquet", held)
    os.unlink(f"{tmp_path}/in/2.parquet")

    def go(s):
        assert ST.run_to_table(ST.first_alerts(s, "n"), f"{tmp_path}/out", f"{tmp_path}/check", mode="update").awaitTermination(90)

    go(stream)
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3]
    # A second run starts where the first one stopped, with its state.
    os.link(held, f"{tmp_path}/in/2.parquet")
    os.utime(f"{tmp_path}/in/2.parquet", (time.time(),) * 2)
    go(ST.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in/0.parquet").schema))
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3, 5]


def test_first_alerts_with_a_time_to_live_run_on_an_interval(spark, tmp_path):
    row = lambda n, text: (n, "IDUKKI", text, f"2024-01-0{n} 10:00:00")
    items = _stream(spark, tmp_path, [[row(1, "Heavy rain"), row(2, "Heavy rain")], [row(3, "Heavy rain"), row(4, "Hail")]], "n long, title string, description string, ts string")
    q = ST.run_to_table(ST.first_alerts(items, "n", keep_minutes=600), f"{tmp_path}/out", f"{tmp_path}/check", mode="update", available_now=False, interval="1 second")
    try:
        for _ in range(60):
            if q.awaitTermination(1) or (q.lastProgress or {"batchId": 0})["batchId"] >= 2:
                break
    finally:
        q.stop()
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 4]
