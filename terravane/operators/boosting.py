"""Newton boosting of regression trees on binned features, for all folds of a cross-validation at once.

The training table becomes blocks: one row holds some thousand cells as bytes of bin numbers with their margins.  Each level of
the trees is one job: tasks add gradient and curvature per (booster, node, feature, bin), reducers add the tasks, the driver
receives sums whose size depends on the learner's settings only and picks the splits.  The smaller child of a split is
summed, its sibling is the parent less the child.  A fold is a booster that leaves its rows out, so five folds and the model over
all rows cost as many jobs as one model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import checkpoint_root

# Cells of a block, and of a partition.
BLOCK, PART = 16_384, 262_144
# Points of a feature's sketch, and tasks whose sketches meet in one merge.
SKETCH, FAN_IN = 1024, 256
# Rounds between tables that cut the lineage.
ROUNDS_KEPT = 25
# Nodes whose sums travel together.
NODES_TOGETHER = 8
MISSING = 255
SMALLEST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """The learner's defaults; ``bins`` is the number of thresholds per feature."""

    rounds: int = 500
    rate: float = 0.05
    depth: int = 8
    child_weight: float = 5.0
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """A tree as arrays over the places of a full binary tree; children of i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int16), np.zeros(n), np.zeros(n, np.int16), np.zeros(n, bool), np.zeros(n), np.zeros(n))


# ---- bins: a mergeable sketch of weighted quantiles --------------------------------
def pruned(values, weights, size: int = SKETCH):
    """Sorted distinct values with their weights; beyond ``size`` points neighbours are joined into equal shares of the weight.

    A pruned point stands for the values up to it, so each pruning moves a rank by at most the total over ``size``.
    """
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.array([], dtype=np.int64)
    values, weights = values[first], np.add.reduceat(weights, first) if len(first) else weights[:0]
    if len(values) <= size:
        return values, weights
    upto = np.cumsum(weights)
    share = np.minimum((upto * (size / upto[-1])).astype(np.int64), size - 1)
    last = np.flatnonzero(np.concatenate([share[1:] != share[:-1], [True]]))
    starts = np.concatenate([[0], last[:-1] + 1])
    return values[last], np.add.reduceat(weights, starts)


def thresholds(values, weights, bins: int):
    """At most ``bins`` thresholds that part the weight evenly; all values but the smallest if they are few enough.  Left is below."""
    if len(values) <= bins + 1:
        return values[1:].copy()
    upto = np.cumsum(weights) - weights
    at = np.searchsorted(upto, upto[-1] * np.arange(1, bins + 1) / (bins + 1))
    return np.unique(values[np.clip(at, 1, len(values) - 1)])


def sketch(df: DataFrame, features: Sequence[str], weight: str, size: int = SKETCH) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Weighted sketch of each feature: per task, merged in slices of tasks, then whole; at most ``size`` points each reach the driver."""
    import pyarrow as pa

    names = list(features)
    schema = "k int, slice int, v double, w double"

    def batch_of(k, part, v, w):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.full(len(v), part, np.int32)), pa.array(v), pa.array(w)],
                                          ["k", "slice", "v", "w"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [(np.array([]), np.array([])) for _ in names]
        for batch in batches:
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.float64)
            for k, name in enumerate(names):
                x = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
                ok = np.isfinite(x)
                held[k] = pruned(np.concatenate([held[k][0], x[ok]]), np.concatenate([held[k][1], w[ok]]), size)
        part = TaskContext.get().partitionId() // FAN_IN
        for k, (v, w) in enumerate(held):
            yield batch_of(k, part, v, w)

    def merged(table: pa.Table) -> pa.Table:
        v, w = pruned(table.column("v").to_numpy(), table.column("w").to_numpy(), size)
        k, part = table.column("k")[0].as_py(), table.column("slice")[0].as_py()
        return pa.Table.from_batches([batch_of(k, part, v, w)])

    parts = df.select(*names, weight).mapInArrow(local, schema)
    parts = parts.groupBy("k", "slice").applyInArrow(merged, schema).groupBy("k").applyInArrow(merged, schema)
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {n: (np.array([]), np.array([])) for n in names}
    rows = parts.toPandas()
    for k, group in rows.groupby("k"):
        order = np.argsort(group["v"].to_numpy())
        out[names[k]] = (group["v"].to_numpy()[order], group["w"].to_numpy()[order])
    return out


# ---- blocks --------------------------------------------------------------------
def _binned(x, edges):
    b = np.searchsorted(edges, x, side="right").astype(np.uint8)
    b[~np.isfinite(x)] = MISSING
    return b


def _blocks(df: DataFrame, features: Sequence[str], edges: list[np.ndarray], label: str, fold: str | None, boosters: int) -> DataFrame:
    """``n, bins, y, fold, key, margin``: bin numbers feature by feature; margins booster by booster, 0 at first."""
    import pyarrow as pa

    names = list(features)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bins = np.stack([_binned(batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64), e) for f, e in zip(names, edges)])
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(np.int8)
            part = batch.column("_fold").to_numpy(zero_copy_only=False).astype(np.int32)
            key = batch.column("_key").to_numpy(zero_copy_only=False)
            made = [bins, y, part, key, np.zeros((boosters, n))]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in made]],
                                             ["n", "bins", "y", "fold", "key", "margin"])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK))
    rows = df.select(*names, F.col(label).cast("int").alias("_y"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("_fold"), "_key")
    return rows.mapInArrow(make, "n int, bins binary, y binary, fold binary, key binary, margin binary")


def _unpack(row: dict, features: int, boosters: int):
    n = row["n"]
    return (np.frombuffer(row["bins"], np.uint8).reshape(features, n), np.frombuffer(row["y"], np.int8), np.frombuffer(row["fold"], np.int32),
            np.frombuffer(row["key"], np.int64), np.frombuffer(row["margin"]).reshape(boosters, n))


def drawn(key, tree: int, share: float, seed: int):
    """Rows of a tree: a hash of row and tree below the share, the same in every run."""
    if share >= 1:
        return np.ones(len(key), dtype=bool)
    h = (key.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h < np.uint64(int(share * 2**64))


def drawn_columns(features: int, tree: int, share: float, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([seed, tree]))
    return np.sort(rng.choice(features, max(1, int(share * features)), replace=False))


def place(tree: Tree, bins, depth: int):
    """Place of each row in a tree that is grown to ``depth`` levels of splits."""
    at = np.zeros(bins.shape[1], dtype=np.int64)
    rows = np.arange(bins.shape[1])
    for _ in range(depth):
        f = tree.feature[at]
        inner = f >= 0
        if not inner.any():
            break
        b = bins[np.maximum(f, 0), rows]
        right = np.where(b == MISSING, ~tree.missing_left[at], b > tree.cut[at])
        at = np.where(inner, 2 * at + 1 + right, at)
    return at


def gradients(margin, y, positive: float):
    p = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, positive, 1.0)
    return w * (p - y), w * p * (1 - p)


# ---- splits --------------------------------------------------------------------
def best_splits(sums, l2: float, child_weight: float):
    """Per node the best ``(gain, column, bin, missing left)`` of histograms ``sums[node, column, bin, (g, h)]``; the last bin is 'missing'.

    Gain is half of what the split adds to G² / (H + l2).  Ties: the first column, the smallest bin, missing to the right.
    """
    g, h = sums[..., 0], sums[..., 1]
    total_g, total_h = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
    best = None
    for to_left in (False, True):
        left_g, left_h = np.cumsum(g[..., :-1], axis=2), np.cumsum(h[..., :-1], axis=2)
        if to_left:
            left_g, left_h = left_g + g[..., -1:], left_h + h[..., -1:]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = 0.5 * (left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2))
        gain = np.where((left_h >= child_weight) & (right_h >= child_weight) & (left_h > 0) & (right_h > 0), gain, -np.inf)
        flat = gain.reshape(len(gain), -1)
        at = flat.argmax(axis=1)
        found = flat[np.arange(len(flat)), at], at // gain.shape[2], at % gain.shape[2], np.full(len(flat), to_left)
        if best is None:
            best = found
        else:
            better = found[0] > best[0] + 1e-12
            best = tuple(np.where(better, new, old) for new, old in zip(found, best))
    return best


def _level(blocks: DataFrame, trees: list[Tree], depth: int, wanted: list[list[int]], columns: np.ndarray, tree: int, positives: list[float],
           settings: Settings, features: int, bins: int) -> list[np.ndarray]:
    """Histograms ``[node, column, bin, 2]`` of the wanted places of every booster, summed over all blocks."""
    import pyarrow as pa

    boosters = len(trees)
    shape = (len(columns), bins, 2)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = [np.zeros((len(w), *shape)) for w in wanted]
        for batch in batches:
            for row in batch.to_pylist():
                x, y, fold, key, margin = _unpack(row, features, boosters)
                use = drawn(key, tree, settings.rows, settings.seed)
                for b, places in enumerate(wanted):
                    if not places:
                        continue
                    at = place(trees[b], x, depth)
                    slot = np.full(2 ** (depth + 1), -1, dtype=np.int64)
                    slot[places] = np.arange(len(places))
                    node = np.where(use & (fold != b), slot[at], -1)
                    rows = np.flatnonzero(node >= 0)
                    g, h = gradients(margin[b, rows], y[rows], positives[b])
                    for j, f in enumerate(columns):
                        code = x[f, rows].astype(np.int64)
                        code[code == MISSING] = bins - 1
                        code += node[rows] * bins
                        size = len(places) * bins
                        sums[b][:, j, :, 0] += np.bincount(code, weights=g, minlength=size).reshape(-1, bins)
                        sums[b][:, j, :, 1] += np.bincount(code, weights=h, minlength=size).reshape(-1, bins)
        part = TaskContext.get().partitionId()
        for b, s in enumerate(sums):
            for lo in range(0, len(s), NODES_TOGETHER):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([lo], pa.int32()), pa.array([part], pa.int32()),
                                                  pa.array([s[lo : lo + NODES_TOGETHER].tobytes()], pa.binary())], ["booster", "lo", "part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        # In the order of the parts: sums of floats must not depend on who comes first.
        table = table.sort_by("part")
        total = sum(np.frombuffer(s) for s in table.column("sums").to_pylist())
        return table.slice(0, 1).set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))

    schema = "booster int, lo int, part int, sums binary"
    out = [np.zeros((len(w), *shape)) for w in wanted]
    for row in blocks.mapInArrow(local, schema).groupBy("booster", "lo").applyInArrow(added, schema).collect():
        part = np.frombuffer(row["sums"]).reshape(-1, *shape)
        out[row["booster"]][row["lo"] : row["lo"] + len(part)] = part
    return out


def _grow(blocks: DataFrame, edges: list[np.ndarray], positives: list[float], tree: int, settings: Settings) -> list[Tree]:
    """The next tree of every booster: one job per level."""
    features, bins = len(edges), max(len(e) for e in edges) + 2
    columns = drawn_columns(features, tree, settings.columns, settings.seed)
    # Bins beyond a feature's last threshold are empty; a split there has an empty side.
    trees = [Tree.empty(settings.depth) for _ in positives]
    held: list[dict[int, np.ndarray]] = [{} for _ in trees]
    wanted: list[list[int]] = [[0] for _ in trees]
    derived: list[dict[int, tuple[int, int]]] = [{} for _ in trees]
    for depth in range(settings.depth + 1):
        if depth == settings.depth or not any(wanted):
            break
        sums = _level(blocks, trees, depth, wanted, columns, tree, positives, settings, features, bins)
        for b, t in enumerate(trees):
            now = dict(zip(wanted[b], sums[b]))
            now.update({big: held[b][parent] - now[small] for big, (parent, small) in derived[b].items()})
            places = sorted(now)
            wanted[b], derived[b], held[b] = [], {}, {}
            if not places:
                continue
            stacked = np.stack([now[p] for p in places])
            gain, column, cut, left = best_splits(stacked, settings.l2, settings.child_weight)
            for i, p in enumerate(places):
                g, h = stacked[i, 0].sum(axis=0)
                t.value[p] = -settings.rate * g / (h + settings.l2)
                if not gain[i] > SMALLEST_GAIN:
                    continue
                f = columns[column[i]]
                t.feature[p], t.cut[p], t.missing_left[p], t.gain[p] = f, cut[i], left[i], gain[i]
                # Beyond the last threshold all values are left and only missing ones right.
                t.threshold[p] = edges[f][cut[i]] if cut[i] < len(edges[f]) else np.inf
                side = stacked[i, column[i], : cut[i] + 1].sum(axis=0) + (stacked[i, column[i], -1] if left[i] else 0)
                for child, (cg, ch) in ((2 * p + 1, side), (2 * p + 2, np.array([g, h]) - side)):
                    t.value[child] = -settings.rate * cg / (ch + settings.l2)
                small, big = (2 * p + 1, 2 * p + 2) if side[1] <= h - side[1] else (2 * p + 2, 2 * p + 1)
                wanted[b].append(small)
                derived[b][big] = (p, small)
                held[b][p] = stacked[i]
            wanted[b].sort()
    return trees


def _advanced(blocks: DataFrame, trees: list[Tree], features: int, depth: int) -> DataFrame:
    """Blocks whose margins include the trees."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for row in batch.to_pylist():
                x, _, _, _, margin = _unpack(row, features, len(trees))
                new.append(np.stack([m + t.value[place(t, x, depth)] for m, t in zip(margin, trees)]).tobytes())
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(new, pa.binary()))

    return blocks.mapInArrow(run, blocks.schema)


@dataclass
class NewtonModel:
    """Trees over named features: P(event) is the logistic function of the sum of their leaves."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    def probability(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Add P(event); 0 for a model without trees, whose training saw a single class."""
        trees = self.trees
        if not trees:
            return df.withColumn(name, F.lit(0.0))

        @F.pandas_udf("double")
        def score(x):
            v = np.stack(x.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, 1))
            margin, rows = np.zeros(len(v)), np.arange(len(v))
            for t in trees:
                at = np.zeros(len(v), dtype=np.int64)
                while True:
                    f = t.feature[at]
                    if not (f >= 0).any():
                        break
                    value = v[rows, np.maximum(f, 0)]
                    right = np.where(np.isfinite(value), value >= t.threshold[at], ~t.missing_left[at])
                    at = np.where(f >= 0, 2 * at + 1 + right, at)
                margin += t.value[at]
            import pandas as pd

            return pd.Series(1 / (1 + np.exp(-margin)))

        inputs = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features])
        return df.withColumn(name, score(inputs))

    def importance(self) -> list[float]:
        """Mean gain of the splits on each feature, as shares of 1."""
        gain, times = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(gain, t.feature[inner], t.gain[inner])
            np.add.at(times, t.feature[inner], 1)
        mean = gain / np.maximum(times, 1)
        return (mean / mean.sum() if mean.sum() else mean).tolist()

    def table(self, spark: SparkSession) -> DataFrame:
        """``tree, node, feature, threshold, missing_left, value, gain``: reached places only; leaves have no feature.  A row without tree names the inputs."""
        rows = [(-1, i, f, None, None, None, None) for i, f in enumerate(self.features)]
        for k, t in enumerate(self.trees):
            reached = [0]
            while reached:
                p = reached.pop()
                inner = t.feature[p] >= 0
                rows.append((k, p, self.features[t.feature[p]] if inner else None, float(t.threshold[p]) if inner else None,
                             bool(t.missing_left[p]) if inner else None, float(t.value[p]), float(t.gain[p]) if inner else None))
                if inner:
                    reached += [2 * p + 1, 2 * p + 2]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, value double, gain double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NewtonModel:
        rows = spark.read.parquet(path).toPandas()
        names = rows[rows.tree < 0].sort_values("node")
        model = NewtonModel(names.feature.tolist())
        place_of = {f: i for i, f in enumerate(model.features)}
        for _, group in rows[rows.tree >= 0].groupby("tree"):
            t = Tree.empty(int(np.log2(group.node.max() + 1)))
            for r in group.itertuples():
                t.value[r.node] = r.value
                if r.feature is not None:
                    t.feature[r.node], t.threshold[r.node], t.missing_left[r.node], t.gain[r.node] = place_of[r.feature], r.threshold, r.missing_left, r.gain
            model.trees.append(t)
        return model


def fit_boosters(df: DataFrame, features: Sequence[str], label: str = "label", fold: str | None = None, folds: int = 0, positive: str | float = "balance",
                 settings: Settings = Settings()) -> list[NewtonModel]:
    """Boosters ``0 .. folds - 1``, each without the rows of its fold, and a last one over all rows.

    ``positive`` weighs events: a number, or 'balance' for non-events per event among the rows a booster sees.  Labels other than 1 are no
    event; a booster that sees a single class has no trees.  NULL, NaN and infinite features are missing: splits learn
    where they go.  The driver holds the trees and sums of ``boosters * 2**(depth - 1) * features * bins`` numbers at a time.
    """
    spark = df.sparkSession
    names = list(features)
    if not names or settings.bins > MISSING - 2:
        raise ValueError(f"need features and at most {MISSING - 2} bins")
    inputs = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f) for f in names]
    y = (F.coalesce(F.col(label), F.lit(0)) == 1).cast("int").alias("_label")
    rows = df.select(*inputs, y, (F.coalesce(F.col(fold), F.lit(-1)) if fold else F.lit(-1)).cast("int").alias("_fold"))
    folder = f"{checkpoint_root(spark)}/boosting-{uuid.uuid4().hex}"
    keyed = rows.withColumn("_key", F.xxhash64(*rows.columns))
    keyed.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(keyed.schema).parquet(f"{folder}/rows")
    seen = {(r["_fold"], r["_label"]): r["n"] for r in rows.groupBy("_fold", "_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = [[sum(n for (k, c), n in seen.items() if c == kind and k != b) for kind in (0, 1)] for b in range(folds)]
    number.append([sum(n for (k, c), n in seen.items() if c == kind) for kind in (0, 1)])
    positives = [n / p if p and positive == "balance" else 1.0 if positive == "balance" else float(positive) for n, p in number]
    models = [NewtonModel(names) for _ in positives]
    total = sum(seen.values())
    if not total:
        return models
    # Curvature at the start is the weight over 4: the sketch parts the weight evenly.
    weighted = rows.withColumn("_w", F.when(F.col("_label") == 1, F.lit(positives[-1])).otherwise(F.lit(1.0)))
    points = sketch(weighted, names, "_w")
    edges = [thresholds(*points[f], settings.bins) for f in names]
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-total // BLOCK)), -(-total // PART))
    # Dealt and ordered by the rows' own values: a task run again makes the same blocks.
    dealt = rows.repartition(parts, "_key").sortWithinPartitions("_key", *names)
    blocks = _blocks(dealt, names, edges, "_label", "_fold", len(positives))
    blocks.write.parquet(f"{folder}/blocks-0")
    schema = blocks.schema
    now = spark.read.schema(schema).parquet(f"{folder}/blocks-0").persist(StorageLevel.MEMORY_AND_DISK)
    live = [all(n) for n in number]
    before = None
    for k in range(settings.rounds):
        if not any(live):
            break
        # The first level reads the new margins, after which the former ones are not needed.
        grown = _grow(now, edges, positives, k, settings)
        if before is not None:
            before.unpersist()
        for m, t, ok in zip(models, grown, live):
            if ok:
                m.trees.append(t)
        if k + 1 == settings.rounds:
            break
        after = _advanced(now, grown, len(names), settings.depth)
        if (k + 1) % ROUNDS_KEPT == 0:
            after.write.parquet(f"{folder}/blocks-{k + 1}")
            after = spark.read.schema(schema).parquet(f"{folder}/blocks-{k + 1}")
        before, now = now, after.persist(StorageLevel.MEMORY_AND_DISK)
    for blocks in (before, now):
        if blocks is not None:
            blocks.unpersist()
    return models
