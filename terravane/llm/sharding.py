"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terravane.llm.texts import stage, text_of

# Slots are numbered inside this many slices of a shard: shards x slices offsets are broadcast.
SLICES = 1024


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of key and shard; the smallest cost wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double")
    return -F.log((bits + 0.5) * F.lit(2.0**-53)) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key.  A share of keys in proportion to its weight goes to each shard; a shard added
    at the end takes keys only into itself.  A NULL key is a key like any other."""
    spelled = F.coalesce(key.cast("string"), F.lit("\x00null"))
    table = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    costs = F.transform(table, lambda s: F.struct(_cost(spelled, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard")))
    return F.array_min(costs)["shard"]


def shard_alerts(
    alerts: DataFrame, weights: Sequence[float] = (1.0,) * 40, grown_weight: float = 1.0,
    alert_id: str = "alert_id", description: str = "description", overhead: int = 16, slices: int = SLICES,
) -> DataFrame:
    """Place every alert in a shard by its stable key: ``alert_id`` and the weights alone decide.

    Returns ``alert_id, size, text_crc32, shard, slot, grown_shard``: bytes of the description plus
    ``overhead``, its CRC-32, the shard, the place in the shard (0, 1, ... without gaps) and the shard
    with one more of ``grown_weight``.  A NULL description has size ``overhead`` and CRC 0; a NULL key is
    one key; repeated rows keep one slot each; an empty table gives an empty table; other columns
    of ``alerts`` are ignored.

    The text is read once and not shuffled.  Slots: rank inside a slice of the shard, plus the rows of
    the slices before it, so no task sorts a whole shard.
    """
    key, text = F.col(alert_id), text_of(description)
    placed = stage(alerts.select(
        key.alias("alert_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
    ).withColumn("slice", F.pmod(F.xxhash64("alert_id", "text_crc32", "size"), F.lit(slices)).cast("int")), "shards")
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    # At most len(weights) * slices rows: a proven bound for the broadcast.
    starts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("shard", "slice").orderBy("alert_id", "text_crc32", "size")
    return placed.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["shard", "slice"]).select(
        "alert_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot"), "grown_shard")
