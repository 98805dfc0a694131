"""Structured Streaming jobs over reservoir and alert feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from terravane.functions import feeds as K

LATE = "2 hours"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, max_files: int = 1) -> DataFrame:
    """Replay Parquet files in arrival order."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def dam_stream(readings: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Readings ``(dam_id, ts, level, red, orange, blue)`` with their alert; rows later
    than the watermark are dropped by the stateful steps that follow."""
    return readings.withWatermark(ts, late).withColumn(
        "alert", K.dam_alert(F.col("level"), F.col("red"), F.col("orange"), F.col("blue"))
    )


def dam_states(readings: DataFrame, minutes: int = 60, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Latest reading and alert per dam and refresh window."""
    return (
        dam_stream(readings, ts, late)
        .groupBy("dam_id", F.window(ts, f"{minutes} minutes").alias("w"))
        .agg(F.max_by(F.struct("level", "alert"), F.struct(ts, "level", "alert")).alias("b"), F.max(ts).alias("last_ts"))
        .select("dam_id", F.col("w.start").alias("window_start"), "last_ts", "b.level", "b.alert")
    )


def alert_stream(items: DataFrame, ts: str = "published", late: str = LATE, districts: Sequence[str] = tuple(K.DISTRICTS),
                 state: str = K.STATE) -> DataFrame:
    """Regional alerts with severity, each description once within the watermark."""
    return (
        items.filter(K.is_regional(F.col("title"), tuple(districts), state))
        .withColumn("description", F.trim("description"))
        .withWatermark(ts, late)
        .dropDuplicatesWithinWatermark(["description"])
        .withColumn("severity", K.alert_severity(F.col("description")))
        .withColumn("headline", K.alert_title(F.col("title")))
    )


class _FirstItem(StatefulProcessor):
    """Keeps the place in the feed of the item that was passed on for a description; hands on what comes earlier."""

    def __init__(self, schema: T.StructType, order: str, keep_ms: int | None):
        self.schema, self.order, self.keep_ms = schema, order, keep_ms

    def init(self, handle) -> None:
        kind = T.StructType([T.StructField("place", self.schema[self.order].dataType), T.StructField("revision", T.IntegerType())])
        self.first = handle.getValueState("first", kind, self.keep_ms) if self.keep_ms else handle.getValueState("first", kind)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        best = None
        for part in rows:
            part = part.dropna(subset=[self.order])
            if len(part):
                least = part.loc[[part[self.order].idxmin()]]
                best = least if best is None or least[self.order].iloc[0] < best[self.order].iloc[0] else best
        known = self.first.get() if self.first.exists() else None
        if best is None or (known is not None and not best[self.order].iloc[0] < known[0]):
            if known is not None and self.keep_ms:
                self.first.update(known)  # seen again: kept for another term
            return iter([])
        revision = 0 if known is None else known[1] + 1
        place = best[self.order].iloc[0]
        self.first.update((place.item() if hasattr(place, "item") else place, revision))
        return iter([best[[f.name for f in self.schema]].assign(revision=pd.array([revision], "int32"))])

    def close(self) -> None:
        pass


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_alerts(items: DataFrame, order: str, key: str = "description", keep_minutes: int | None = None, districts: Sequence[str] = tuple(K.DISTRICTS),
                 state: str = K.STATE) -> DataFrame:
    """Regional alerts of a stream, each description once over the whole feed: the streaming form of
    :func:`terravane.operators.feeds.dedupe_alerts`.

    State per trimmed description is the place in the feed (``order``) of the item that was passed on.  A repeat is dropped however late it
    comes, and no watermark is needed.  If a file brings an item from before it, that item follows with a higher
    ``revision``: the row of the highest revision of a description is the one the batch operator finds.  ``keep_minutes`` lets
    descriptions that are not seen for so long be forgotten, which bounds the state of an endless feed; such a stream runs on an interval, for
    one that forgets has no last batch.  NULL descriptions are one
    key, items without ``order`` are dropped.  Needs the RocksDB state store, which this sets for the session.
    """
    items.sparkSession.conf.set(*STATE_STORE)
    found = items.filter(K.is_regional(F.col("title"), tuple(districts), state))
    schema = found.schema
    out = T.StructType([*schema.fields, T.StructField("revision", T.IntegerType())])
    once = found.withColumn("_key", F.trim(F.col(key))).groupBy("_key").transformWithStateInPandas(
        _FirstItem(schema, order, keep_minutes * 60_000 if keep_minutes else None), out, "Update", "ProcessingTime" if keep_minutes else "None")
    return once.withColumn("severity", K.alert_severity(F.col("description"))).withColumn("headline", K.alert_title(F.col("title")))


def latest_revision(rows: DataFrame, key: str = "description") -> DataFrame:
    """The last revision of every description written by :func:`first_alerts`."""
    cols = [c for c in rows.columns if c != "revision"]
    best = rows.groupBy(F.trim(F.col(key)).alias("_key")).agg(F.max_by(F.struct(*cols), "revision").alias("b"))
    return best.select("b.*")


def rain_windows(hourly: DataFrame, hours: int = 48, slide: str = "1 hour", ts: str = "ts", rain: str = "rain_mm_h", late: str = LATE) -> DataFrame:
    """Sliding antecedent rain per station."""
    return (
        hourly.withWatermark(ts, late)
        .groupBy("station", F.window(ts, f"{hours} hours", slide).alias("w"))
        .agg(F.sum(rain).alias("rain"))
        .select("station", F.col("w.end").alias("until"), "rain", (F.col("rain") / float(hours)).alias("intensity"))
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True,
                 interval: str | None = None) -> StreamingQuery:
    """Start a stream into a Parquet folder; exactly once through its checkpoint.  In mode 'update' each batch is written to its own folder
    ``batch=<n>``, which a batch that is run again replaces."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval or "10 minutes")
    return writer.start()
