"""Quality of alert texts by a factorisation machine over hashed words and structure of the text."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.texts import small_batches, text_of

WORD_FIELDS = 1 << 15
RANK = 8
TRAINING_ROWS = 20_000
KNOWN_WORDS = 600_000
# Epochs at most, and epochs without a lower loss of the rows kept back after which fitting ends.
EPOCHS, PATIENCE = 60, 3
# Structure features, each cut in this many steps.
STEPS = 12
STRUCTURE = (
    "characters", "words", "word_length", "upper", "digits", "marks", "spaces", "lines", "line_length", "distinct_words",
    "distinct_lines", "top_word", "marks_in_words", "beyond_ascii", "repeated_marks", "long_words",
)
WIDTH = WORD_FIELDS + len(STRUCTURE) * STEPS
_UPPER, _DIGIT, _SPACE = range(65, 91), range(48, 58), (9, 10, 13, 32)
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]


class Features:
    """Indices and values of the features of a text; what is known of a word is remembered in one number."""

    def __init__(self, known: int = KNOWN_WORDS):
        import numpy as np

        self.known, self.words = known, {}
        self.kind = np.zeros(256, dtype=np.int64)
        for i, group in enumerate((_UPPER, _DIGIT, _MARKS, _SPACE, range(128, 256)), 1):
            self.kind[list(group)] = i

    def _word(self, w: bytes) -> int:
        """Field of the word, its length (to 255), whether it ends in an odd mark, whether it is long."""
        from zlib import crc32

        last = w[-1:]
        marked = w[-1] < 128 and not last.isalnum() and last not in b".,;:"
        return crc32(w.strip(b".,;:")) % WORD_FIELDS | min(len(w), 255) << 16 | marked << 24 | (len(w) > 20) << 25

    def structure(self, raw: bytes, info, counts, total: int) -> list[float]:
        """Numbers in 0 to 1 for each of :data:`STRUCTURE`."""
        import numpy as np

        n, m = max(len(raw), 1), max(total, 1)
        octets = np.frombuffer(raw, dtype=np.uint8)
        by = np.bincount(self.kind, weights=np.bincount(octets, minlength=256), minlength=6) / n
        lines = raw.split(b"\n")
        again = octets[1:][octets[1:] == octets[:-1]]
        repeated = np.count_nonzero(self.kind[again] == 3)
        log = lambda v, top: min(1.0, math.log1p(v) / math.log1p(top))
        return [
            log(len(raw), 1e6), log(total, 2e5), min(1.0, float(((info >> 16) & 255) @ counts) / m / 20), by[1], min(1.0, 5 * by[2]), min(1.0, 3 * by[3]),
            min(1.0, 3 * by[4]), log(len(lines), 1e4), log(len(raw) / len(lines), 1e5), len(counts) / m, len(set(lines)) / len(lines),
            float(counts.max(initial=0)) / m, float((info >> 24 & 1) @ counts) / m, by[5], min(1.0, 20 * repeated / n), min(1.0, 5 * float((info >> 25) @ counts) / m),
        ]

    def __call__(self, text: str):
        import numpy as np
        from collections import Counter

        raw = text.encode("utf-8", "surrogatepass")
        parts = Counter(raw.split())
        if len(self.words) > self.known:
            self.words.clear()
        known = self.words
        new = set(parts).difference(known)
        if new:
            known.update((w, self._word(w)) for w in new)
        info = np.fromiter(map(known.__getitem__, parts), dtype=np.int64, count=len(parts))
        counts = np.fromiter(parts.values(), dtype=np.int64, count=len(parts))
        times = np.log1p(counts)
        norm = math.sqrt(float(times @ times)) or 1.0
        numbers = np.clip(np.array(self.structure(raw, info, counts, int(counts.sum()))), 0.0, 0.999999)
        steps = WORD_FIELDS + np.arange(len(STRUCTURE)) * STEPS + (numbers * STEPS).astype(np.int64)
        return np.concatenate([info & 0xFFFF, steps]), np.concatenate([times / norm, np.full(len(STRUCTURE), 0.5)])


def interactions(v, x, starts):
    """Sum over pairs i < j of <v_i, v_j> x_i x_j per row, as half of (square of the sum minus sum of the squares)."""
    import numpy as np

    vx = v * x[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    return 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), starts)), sums


def _joined(rows, part):
    """Features of some rows end to end: indices, values, length of each row and where it starts."""
    import numpy as np

    idx = np.concatenate([rows[i][0] for i in part])
    x = np.concatenate([rows[i][1] for i in part])
    lens = np.array([len(rows[i][0]) for i in part])
    return idx, x, lens, np.concatenate([[0], np.cumsum(lens)[:-1]])


def logits(rows, part, w0, w, v):
    import numpy as np

    out = []
    for lo in range(0, len(part), 512):
        idx, x, _, starts = _joined(rows, part[lo : lo + 512])
        out.append(w0 + np.add.reduceat(w[idx] * x, starts) + interactions(v[idx], x, starts)[0])
    return np.clip(np.concatenate(out), -30, 30)


def log_loss(z, y) -> float:
    import numpy as np

    return float(np.mean(np.logaddexp(0, z) - y * z))


def calibrate(z, y, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic of ``z`` on rows that were not fitted, towards targets that are never quite 0 or 1."""
    import numpy as np

    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    x, theta = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    # A weak pull to slope 1 and shift 0 keeps few rows from running away.
    loss = lambda t: float(np.sum(np.logaddexp(0, x @ t) - target * (x @ t))) + 0.05 * float(((t - [1.0, 0.0]) ** 2).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (p - target) + 0.1 * (theta - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        move, now = np.linalg.solve(h, g), loss(theta)
        while loss(theta - move) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        theta = theta - move
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def fit(rows, y, rank: int = RANK, width: int = WIDTH, epochs: int = EPOCHS, patience: int = PATIENCE, batch: int = 512, rate: float = 0.05, ridge: float = 1e-4, seed: int = 7):
    """Logistic loss by AdaGrad on mini-batches: bias, linear weights, factors.

    Every sixth row is kept back.  Epochs go on until the loss of these rows has not fallen for ``patience`` of them (``epochs`` at most); the best
    weights stay, and slope and shift are calibrated on the rows kept back.  Small tables take smaller batches, at least 20 an epoch.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype=np.float64)
    back = np.arange(len(rows)) % 6 == 5
    if not 0 < y[back].sum() < back.sum() or not 0 < y[~back].sum() < (~back).sum():
        back[:] = False  # too few rows to keep any back
    own, kept = np.flatnonzero(~back), np.flatnonzero(back)
    watched = kept if len(kept) else own
    batch = min(batch, max(16, len(own) // 20))
    w0, w, v = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), np.zeros(width), rng.normal(0, 0.02, (width, rank))
    gw, gv, g0 = np.full(width, 1e-3), np.full((width, rank), 1e-3), 1e-3
    best, since = (math.inf, None), 0
    for _ in range(epochs):
        order = own[rng.permutation(len(own))]
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            idx, x, lens, starts = _joined(rows, part)
            vi = v[idx]
            pairs, sums = interactions(vi, x, starts)
            z = w0 + np.add.reduceat(w[idx] * x, starts) + pairs
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            each = np.repeat(d, lens) * x
            slots, place = np.unique(idx, return_inverse=True)
            dw = np.bincount(place, weights=each, minlength=len(slots)) / len(part) + ridge * w[slots]
            inner = each[:, None] * (np.repeat(sums, lens, axis=0) - vi * x[:, None])
            dv = np.stack([np.bincount(place, weights=inner[:, f], minlength=len(slots)) for f in range(rank)], 1) / len(part) + ridge * v[slots]
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            g0 += float(d.mean()) ** 2
            w[slots] -= rate * dw / np.sqrt(gw[slots])
            v[slots] -= rate * dv / np.sqrt(gv[slots])
            w0 -= rate * float(d.mean()) / math.sqrt(g0)
        loss = log_loss(logits(rows, watched, w0, w, v), y[watched])
        if loss < 0.995 * best[0]:
            best, since = (loss, (w0, w.copy(), v.copy())), 0
        else:
            since += 1
            if since >= patience:
                break
    w0, w, v = best[1] if best[1] is not None else (w0, w, v)
    slope, shift = calibrate(logits(rows, kept, w0, w, v), y[kept]) if len(kept) else (1.0, 0.0)
    return w0, w.astype(np.float32), v.astype(np.float32), slope, shift


def train(alerts: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, alert_id: str = "alert_id", description: str = "description", quality: str = "quality"):
    """The machine, learnt from at most ``rows`` labelled alerts, chosen by a hash of their ids; None without both labels."""
    import pandas as pd

    small_batches(alerts.sparkSession)
    known = labels.filter(F.col(quality).isNotNull() & F.col(alert_id).isNotNull())
    one = known.groupBy(F.col(alert_id).alias("alert_id")).agg(F.max(quality).cast("int").alias("quality"))
    few = one.orderBy(F.xxhash64("alert_id"), "alert_id").limit(rows)  # bounded, so it may be broadcast
    texts = alerts.select(F.col(alert_id).alias("alert_id"), text_of(description).alias("description")).join(F.broadcast(few), "alert_id")

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        features = Features()
        for frame in frames:
            made = [features(t) for t in frame["description"]]
            yield pd.DataFrame({"alert_id": frame["alert_id"], "y": frame["quality"], "i": [m[0].astype(np.int32).tobytes() for m in made], "x": [m[1].astype(np.float32).tobytes() for m in made]})

    kind = texts.schema["alert_id"].dataType.simpleString()
    data = texts.select("alert_id", "quality", "description").mapInPandas(made, f"alert_id {kind}, y int, i binary, x binary").toPandas()
    if data["y"].nunique() < 2:
        return None
    import numpy as np

    data = data.sort_values(["alert_id", "i"]).reset_index(drop=True)  # the same order on every run
    pairs = [(np.frombuffer(i, dtype=np.int32).astype(np.int64), np.frombuffer(x, dtype=np.float32).astype(np.float64)) for i, x in zip(data["i"], data["x"])]
    return fit(pairs, data["y"].to_numpy())


def score_quality(alerts: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.5, alert_id: str = "alert_id", description: str = "description", quality: str = "quality") -> DataFrame:
    """Probability that a description is of quality 1, as ``labels(alert_id, quality)`` mark it.

    Returns one row per row of ``alerts``: ``alert_id, description, score, predicted``.  Words are hashed into 32,768 fields, structure and
    lengths into steps; both interact by factors of rank 8, scored in time linear in the features.  NULL counts as the empty
    text, which has a score too; without labels of both kinds all scores are 0.5; repeated rows get equal scores; other
    columns of ``alerts`` are ignored and never features.
    """
    import pyarrow as pa

    machine = train(alerts, labels, rows, alert_id, description, quality)
    small_batches(alerts.sparkSession)
    base = alerts.select(F.col(alert_id).alias("alert_id"), F.col(description).alias("description"))
    shared = alerts.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        features, machine = Features(), shared.value
        for batch in batches:
            scores = []
            for text in batch.column("description").to_pylist():
                z = 0.0
                if machine is not None:
                    w0, w, v, slope, shift = machine
                    idx, x = features(text or "")
                    vx = v[idx] * x[:, None]
                    s = vx.sum(0)
                    z = slope * (w0 + float(w[idx] @ x) + 0.5 * float((s * s).sum() - (vx * vx).sum())) + shift
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(np.array(scores) >= threshold).cast(pa.int32())], [*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(scored, f"{kinds}, score double, predicted int")
