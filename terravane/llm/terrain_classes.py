"""Classes of terrain cells: exact k-means over whole-number feature vectors, each nearest centroid found by Orchard's search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.texts import small_batches, stage

CLASSES = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
# Scaled components stay below 2**27: squared distances of up to 128 components are then whole numbers of a long.
LARGEST = 2**27
MOST_COMPONENTS = 128


def scaled(features: Column, width: int, scale: int = SCALE) -> tuple[Column, Column]:
    """The vector as ``floor(scale * x)``, and whether it is kept: exactly ``width`` components, all finite and small enough."""
    good = lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / scale, F.lit(False))  # noqa: E731  NaN is the largest number
    keep = F.coalesce((F.size(features) == width) & F.forall(features, good), F.lit(False))
    return F.transform(features, lambda x: F.floor(x.cast("double") * scale).cast("int")), keep


def neighbour_lists(centroids):
    """Per centroid all centroids by distance, itself first, and those squared distances; ties by number."""
    import numpy as np

    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    # A centroid leads its own list even if another one lies on the same spot.
    for c in range(len(order)):
        order[c] = np.concatenate([[c], order[c][order[c] != c]])
    return order, np.take_along_axis(apart, order, axis=1)


def orchard(vectors, centroids, start):
    """Nearest centroid (ties: the smaller number), squared distance, and the distances that were computed.

    Each vector walks the list of its present centroid; a closer one makes it jump to that one's list, centroids it has
    seen are marked, and it stops at the first entry strictly beyond twice its present distance.  All vectors of a batch
    take their steps together.
    """
    import numpy as np

    order, gaps = neighbour_lists(centroids)
    n, k = len(vectors), len(centroids)
    now = start.astype(np.int64).copy()
    best = ((vectors - centroids[now]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), dtype=bool)
    seen[np.arange(n), now] = True
    place = np.ones(n, dtype=np.int64)
    walking, measured = np.arange(n), n
    while len(walking):
        walking = walking[place[walking] < k]
        at, spot = now[walking], place[walking]
        # sqrt(gap) > 2 sqrt(best) exactly when gap > 4 best, in whole numbers.
        near = gaps[at, spot] <= 4 * best[walking]
        walking, at, spot = walking[near], at[near], spot[near]
        place[walking] += 1
        other = order[at, spot]
        new = ~seen[walking, other]
        rows, other = walking[new], other[new]
        if not len(rows):
            continue
        seen[rows, other] = True
        far = ((vectors[rows] - centroids[other]) ** 2).sum(axis=1)
        measured += len(rows)
        closer = (far < best[rows]) | ((far == best[rows]) & (other < now[rows]))
        rows, other, far = rows[closer], other[closer], far[closer]
        now[rows], best[rows], place[rows] = other, far, 1
    return now, best, measured


def _matrix(column, width: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(cells: DataFrame, centroids, width: int) -> list:
    """Per centroid and component the sum of its cells, and their number; what reaches the driver is classes times width."""
    import pyarrow as pa

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        k = len(centroids)
        total, number = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("vector"), width)
            found = orchard(x, centroids, batch.column("start").to_numpy(zero_copy_only=False))[0]
            for c in range(k):
                mine = x[found == c]
                total[c] += mine.sum(axis=0)
                number[c] += len(mine)
        kept = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(kept, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(kept))),
             pa.array(total[kept].reshape(-1)), pa.array(np.repeat(number[kept], width))], ["class", "k", "s", "n"])

    parts = cells.select("vector", "start").mapInArrow(partial, "class int, k int, s long, n long")
    # A cell's component is below 2**27: decimals hold the sum of any number of cells.
    return parts.groupBy("class", "k").agg(F.sum(F.col("s").cast("decimal(19,0)")).alias("s"), F.sum("n").alias("n")).collect()


def terrain_classes(cells: DataFrame, key: Sequence[str] = ("site", "r", "c"), features: str = "features", width: int = 64, classes: int = CLASSES,
                    rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Class of every cell by its feature vector: k-means in whole numbers, the same on every layout of the data.

    ``cells``: the key columns of a cell (``site, r, c``) and an array ``features`` (numbers, such as the scaled feature stack).
    Components become ``floor(scale * x)``.  Centroids 0, 1, ... start as the cells with the smallest SHA-256 of
    ``<seed>:<key joined by ':'>`` and are replaced ``rounds`` times by the floor of the mean of their cells; one without cells
    stays.  Returns one row per kept cell: the key, ``class`` (ties: the smaller number), ``distance`` (squared), ``class_inertia``,
    ``inertia`` (sums of distances; NULL beyond a long) and ``centroid`` (array, final).

    Nearest centroids come from Orchard's search; it starts at the class of the first round, which is stored with the vector.
    Cells whose vector is NULL, has another width or a component that is NULL, not finite or beyond 2**27 once scaled have no
    row.  A NULL key part counts as empty text; repeated rows are cells of their own; of cells with one hash the smaller
    vector starts; with fewer cells than ``classes`` every cell starts one; an empty table gives an empty table; other columns,
    whatever their names, are ignored.  To the driver go ``classes * width`` numbers a round.
    """
    import numpy as np
    import pyarrow as pa

    if not 1 <= width <= MOST_COMPONENTS:
        raise ValueError(f"width must be 1 to {MOST_COMPONENTS}")
    spark = cells.sparkSession
    small_batches(spark, 4096)
    names = [f"key{i}" for i in range(len(key))]
    vector, keep = scaled(F.col(features), width, scale)
    base = cells.filter(keep).select(*[F.col(k).alias(n) for k, n in zip(key, names)], vector.alias("vector"))
    spelled = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    first = base.select(F.sha2(spelled.cast("binary"), 256).alias("h"), "vector").orderBy("h", "vector").limit(classes).collect()
    kinds = ", ".join(f"`{n}` {base.schema[n].dataType.simpleString()}" for n in names)
    shown = [F.col(n).alias(k) for k, n in zip(key, names)]
    if not first:
        return base.select(*shown, F.lit(0).alias("class"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "class_inertia", "inertia")],
                           F.array().cast("array<bigint>").alias("centroid")).limit(0)
    centroids = np.array([row["vector"] for row in first], dtype=np.int64)

    def classed(centroids, start: str | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("vector"), width)
                begin = batch.column(start).to_numpy(zero_copy_only=False) if start else np.zeros(len(x), dtype=np.int64)
                found, far, _ = orchard(x, centroids, begin)
                keys = [batch.column(n) for n in names]
                if start:
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(found.astype(np.int32)), pa.array(far)], [*names, "class", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([*keys, batch.column("vector"), pa.array(found.astype(np.int32))], [*names, "vector", "start"])

        return run

    begun = stage(base.mapInArrow(classed(centroids, None), f"{kinds}, vector array<int>, start int"), "cells")
    for _ in range(rounds):
        new = centroids.copy()
        for row in _sums(begun, centroids, width):
            new[row["class"], row["k"]] = int(row["s"]) // row["n"]
        if np.array_equal(new, centroids):
            break  # further rounds would repeat this one
        centroids = new
    found = stage(begun.mapInArrow(classed(centroids, "start"), f"{kinds}, class int, distance long"), "classed")
    # At most one row per class, and one for all: bounded by the number of classes.
    sums = found.groupBy("class").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s"))
    whole = sums.agg(F.sum("s").alias("all"))
    spots = spark.createDataFrame([(c, [int(x) for x in row]) for c, row in enumerate(centroids)], "class int, centroid array<bigint>")
    about = sums.join(F.broadcast(spots), "class").crossJoin(F.broadcast(whole)).select(
        "class", F.col("s").try_cast("long").alias("class_inertia"), F.col("all").try_cast("long").alias("inertia"), "centroid")
    return found.join(F.broadcast(about), "class").select(*shown, "class", "distance", "class_inertia", "inertia", "centroid")


def feature_vectors(stack: DataFrame, features: Sequence[str], key: Sequence[str] = ("site", "r", "c")) -> DataFrame:
    """The named columns of a feature stack as one array ``features`` per cell."""
    return stack.select(*key, F.array(*[F.col(f).cast("double") for f in features]).alias("features"))
