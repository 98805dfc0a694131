"""Joins that stay safe when a key is hot or a side grows with the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.session import settle

# A side is broadcast only after counting at most this many rows (~10 MB).
BROADCAST_ROWS = 100_000
# Keys with more rows than this are joined with salt.
HOT_ROWS = 1_000_000
SALTS = 64


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join that spreads every key of ``big`` over ``salts`` partitions.

    The rows of ``small`` (one or few per key) are repeated once per salt.
    """
    keys = list(on)
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Shuffle join with the hot keys of ``big`` apart: rows of keys above
    :data:`HOT_ROWS` are salted, all others joined as they are."""
    keys = list(on)
    hot = settle(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > HOT_ROWS).select(*keys))
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return big.join(small, keys, how)
    hot = F.broadcast(hot) if found <= BROADCAST_ROWS else hot
    cold = big.join(hot, keys, "left_anti").join(small, keys, how)
    warm = salted_join(big.join(hot, keys, "left_semi"), small.join(hot, keys, "left_semi"), keys, how)
    return cold.unionByName(warm)


def attach(big: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group statistics onto every row of a large table.

    ``stats`` has one row per group.  It is materialised once and counted: up to
    :data:`BROADCAST_ROWS` it is broadcast, so ``big`` is not shuffled and a hot
    group costs nothing; beyond that hot keys are split off and salted.
    """
    stats = settle(stats)
    if stats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(stats), list(on), how)
    return skew_join(big, stats, on, how)


def attach_single(big: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a global aggregate (exactly one row) on every row.

    No row gives no rows; more than one raises, for any choice among them would be arbitrary.
    """
    packed = one_row.agg(F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*one_row.columns)).alias("_row")).filter("_rows > 0")
    several = F.raise_error(F.concat(F.lit("expected one row of statistics, got "), F.col("_rows").cast("string")))
    # The check stands in the join key, so no pruning of columns can take it away.
    keyed = packed.select(F.when(F.col("_rows") == 1, F.lit(1)).otherwise(several.cast("int")).alias("_one"), "_row.*")
    return big.withColumn("_one", F.lit(1)).join(F.broadcast(keyed), "_one").drop("_one")


def top_n(
    df: DataFrame, by: Sequence[str], order: Sequence, n: int, rank: str = "rn", spread: Sequence[str] = ("r", "c")
) -> DataFrame:
    """First ``n`` rows of each group by ``order``, numbered from 1 in ``rank``.

    Two levels: every group is first cut to ``n`` rows inside each of
    :data:`SALTS` slices, so that no task ever sorts a whole hot group.
    """
    from pyspark.sql import Window as W

    salt = F.pmod(F.xxhash64(*[F.col(x) for x in spread]), F.lit(SALTS))
    slices = W.partitionBy(*by, "_slice").orderBy(*order)
    final = W.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_slice", salt)
        .withColumn("_pre", F.row_number().over(slices))
        .filter(F.col("_pre") <= n)
        .withColumn(rank, F.row_number().over(final))
        .filter(F.col(rank) <= n)
        .drop("_slice", "_pre")
    )
