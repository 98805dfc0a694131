"""Shared pieces: words, staging in the shared folder, row keys, held-out rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import checkpoint_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Everything that is no word character once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_of(col: str | Column) -> Column:
    """The text, NULL as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` does that for pure ASCII and is much faster there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: maximal runs of digits, letters a-z and anything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def word_count(text: Column) -> Column:
    """``size(words(text))`` without lower-casing."""
    return F.size(F.array_remove(F.split(text, SEPARATORS_ANY_CASE), "")).cast("long")


def row_key(*cols: str | Column) -> list[Column]:
    """128 bits that stand for the named values, equal for repeated rows.  NULL has its own key."""
    spelled = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\x00null")) for c in cols]
    return [F.xxhash64(*spelled).alias(KEY[0]), F.xxhash64(F.lit(1), *spelled).alias(KEY[1])]


KEY = ["_k1", "_k2"]


def held_out(key: Column, parts: int, part: int) -> Column:
    """Rows whose crc32 of the key as text leaves ``part`` modulo ``parts``; a NULL key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and go on from the files.

    Cuts the lineage; the files outlive executors and keep column pruning.
    """
    folder = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that long texts do not add up in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
