"""Personal data in alert texts: fixed patterns, and a skip-chain conditional random field that adds to them.

Nodes of the field are mentions: what a pattern matches and other digit groups or addresses.  Mentions that follow each
other are chain neighbours; mentions with the same digits or the same mailbox, wherever they stand, are skip
neighbours.  Loopy message passing makes the labels of a document agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.texts import small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAINING_ROWS = 20_000
CONFIDENCE = 0.8
# Prior of the skip table: log-odds that similar mentions have the same label, private or not.
AGREEMENT = 10.0
# The base patterns.  Possessive runs and look-behinds only save work, they match the same spans.
MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# Other mentions: digits in the manner of a number that is written in groups, an address without a full domain.
GROUPED = re.compile(r"\(?[0-9](?:[ ().\-/]{0,2}[0-9])+")
AT = re.compile(r"(?<![^\s(<\[])[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)[A-Za-z0-9-]+)*")
DIGITS_ONLY = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @ back over mailbox characters, not beyond the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in MAILBOX:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def matched(text: str) -> list[tuple[int, int, str, bool]]:
    """``start, stop, kind, kept`` of every pattern match; failing ones are not kept."""
    out = [(a, b, "email", True) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        out.append((m.start(), m.end(), "ip", all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))))
    for m in CARD.finditer(text):
        digits = DIGITS_ONLY.sub("", m.group())
        out.append((m.start(), m.end(), "card", 14 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append((m.start(), m.end(), "phone", 10 <= len(DIGITS_ONLY.sub("", m.group())) <= 15))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


class Mention:
    __slots__ = ("start", "stop", "label", "features", "key")

    def __init__(self, text: str, start: int, stop: int, label: int, shape: str):
        self.start, self.stop, self.label = start, stop, label
        said = text[start:stop]
        digits = DIGITS_ONLY.sub("", said)
        before, after = text[max(0, start - 1) : start], text[stop : stop + 1]
        self.features = [
            0, 1 + min(len(digits), 20), 22 + min(said.count("."), 4), 27 + min(said.count("-"), 4), 32 + min(said.count(" "), 4),
            37 + ("(" in said), 39 + (said[:1] == "+"), 41 + ("@" in said), 43 + (len(digits) >= 12 and luhn(digits)),
            45 + (before.isalnum()), 47 + (after.isalnum()), 49 + ["email", "ip", "card", "phone", "group", "at"].index(shape),
            55 + (shape == "ip" and all(len(p) <= 3 and int(p) <= 255 for p in said.split("."))),
        ]
        # Similar mentions: the same mailbox, or the same last digits however they are grouped.
        self.key = "@" + re.split(r"\s?(?:@|\(at\)|\[at\])", said, maxsplit=1)[0].lower() if shape in ("email", "at") else digits[-7:] if len(digits) >= 7 else None


FEATURES = 57


def mentions(text: str) -> list[Mention]:
    """Mentions in order, none inside another; a kept match comes before a failing one, that before other groups."""
    found = matched(text)
    # A failing number of few digits is part of a group or nothing.
    spans = [(0 if kept else 1, -(b - a), a, b, kind, kept) for a, b, kind, kept in found if kept or kind != "card" or b - a >= 12]
    if DIGIT.search(text):
        spans += [(2, -(m.end() - m.start()), m.start(), m.end(), "group", False) for m in GROUPED.finditer(text) if len(DIGITS_ONLY.sub("", m.group())) >= 7]
    if "@" in text or "at)" in text or "at]" in text:
        spans += [(2, -(m.end() - m.start()), m.start(), m.end(), "at", False) for m in AT.finditer(text)]
    taken: list[tuple[int, int]] = []
    out = []
    import bisect

    for _, _, a, b, shape, kept in sorted(spans):
        i = bisect.bisect(taken, (a, b))
        if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
            continue
        taken.insert(i, (a, b))
        out.append(Mention(text, a, b, LABELS.index(shape) if kept else 0, shape))
    return sorted(out, key=lambda m: m.start)


def neighbours(nodes: list[Mention], reach: int = 200) -> list[tuple[int, int, int]]:
    """Edges ``i, j, kind``: 0 chain (next mention, not far off), 1 skip (the mention with the same key before, and for a
    mention that no pattern keeps also the nearest kept one of its key, wherever it stands).

    Each mention has at most two skip edges of its own, so the edges grow with the mentions, not with their pairs.
    """
    edges = [(i, i + 1, 0) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].stop <= reach]
    last: dict[str, int] = {}
    for i, m in enumerate(nodes):
        if m.key is not None:
            if m.key in last:
                edges.append((last[m.key], i, 1))
            last[m.key] = i
    before, after, kept = [-1] * len(nodes), [-1] * len(nodes), {}
    for i, m in enumerate(nodes):
        before[i] = kept.get(m.key, -1)
        if m.label and m.key is not None:
            kept[m.key] = i
    kept = {}
    for i in reversed(range(len(nodes))):
        after[i] = kept.get(nodes[i].key, -1)
        if nodes[i].label and nodes[i].key is not None:
            kept[nodes[i].key] = i
    known = {(i, j) for i, j, kind in edges if kind == 1}
    for i, m in enumerate(nodes):
        if not m.label and m.key is not None:
            near = min((j for j in (before[i], after[i]) if j >= 0), key=lambda j: (abs(nodes[j].start - m.start), j), default=None)
            if near is not None and (edge := (min(i, near), max(i, near))) not in known:
                known.add(edge)
                edges.append((*edge, 1))
    return edges


def marginals(unary, edges, pairwise, rounds: int | None = None, damping: float = 0.3, settled: float = 1e-6):
    """Sum-product messages along all edges; exact on chains, loopy with skip edges.

    Goes on until no message changes by more than ``settled``, or for ``rounds``; without them for two rounds a mention
    at most, and 100, as loops need not settle.
    """
    import numpy as np

    n, k = unary.shape
    if not edges:
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    source = np.array([e[0] for e in edges] + [e[1] for e in edges])
    target = np.array([e[1] for e in edges] + [e[0] for e in edges])
    table = pairwise[np.array([e[2] for e in edges] * 2)]
    back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
    message = np.zeros((len(source), k))
    for _ in range(2 * n + 100 if rounds is None else rounds):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        z = out[:, :, None] + table
        top = z.max(1, keepdims=True)
        new = (top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0]
        new -= new.max(1, keepdims=True)
        change = np.abs(new - message).max()
        message = damping * message + (1 - damping) * new
        if change <= settled:
            break
    belief = unary.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _rows(text: str) -> list[tuple[int, list[int], list[int]]]:
    """Per mention: label, features, labels of its neighbours (5 chain counts, 5 skip counts).

    A mention that no pattern keeps but that is similar to a kept one has no known label: it is left out.
    """
    nodes = mentions(text)
    private = {m.key for m in nodes if m.label and m.key is not None}
    around = [[0] * (2 * len(LABELS)) for _ in nodes]
    for i, j, kind in neighbours(nodes):
        around[i][kind * len(LABELS) + nodes[j].label] += 1
        around[j][kind * len(LABELS) + nodes[i].label] += 1
    return [(m.label, m.features, a) for m, a in zip(nodes, around) if m.label or m.key not in private]


def train(alerts: DataFrame, rows: int = TRAINING_ROWS, alert_id: str = "alert_id", description: str = "description", ridge: float = 1.0, steps: int = 300):
    """Weights (features x labels) and edge tables (chain, skip) by pseudo-likelihood.

    The labels to learn from are what the fixed patterns keep, in about ``rows`` alerts chosen by a hash of id and text
    among those with a digit or an @.  The skip table is also given the prior that similar mentions agree.
    """
    import numpy as np
    import pandas as pd

    small_batches(alerts.sparkSession)
    base = alerts.select(F.col(alert_id).alias("alert_id"), text_of(description).alias("description")).filter(F.col("description").rlike("[0-9@]"))
    n = base.count()
    share = min(1.0, rows / n) if n else 1.0
    sample = base.filter(F.pmod(F.xxhash64("alert_id", "description"), F.lit(1_000_000)) < int(share * 1_000_000))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Equal rows are counted in each task, so that a much repeated mention is one row.
        from collections import Counter

        count: Counter = Counter()
        for frame in frames:
            for text in frame["description"]:
                count.update((y, tuple(x), tuple(a)) for y, x, a in _rows(text))
        keys = list(count)
        if keys:
            yield pd.DataFrame({"y": [k[0] for k in keys], "x": [list(k[1]) for k in keys], "a": [list(k[2]) for k in keys], "n": [count[k] for k in keys]})

    seen = sample.mapInPandas(made, "y int, x array<int>, a array<int>, n long").groupBy("y", "x", "a").agg(F.sum("n").alias("n")).toPandas()
    k = len(LABELS)
    agree = AGREEMENT * np.eye(k)
    if not len(seen):
        return np.zeros((FEATURES, k)), np.stack([np.zeros((k, k)), agree])
    width = FEATURES + 2 * k
    x = np.zeros((len(seen), width))
    for i, f in enumerate(seen["x"]):
        x[i, list(f)] = 1
    x[:, FEATURES:] = np.array(seen["a"].tolist())
    y = np.eye(k)[seen["y"].to_numpy()]
    weight = np.sqrt(seen["n"].to_numpy(float))
    w = np.zeros((width, k))
    prior = np.zeros((width, k))
    prior[FEATURES + k :] = agree
    w, look, t = prior.copy(), prior.copy(), 1.0
    rate = 1.0 / (0.5 * (weight[:, None] * x**2).sum(0).max() * 8 + ridge)
    for _ in range(steps):
        z = x @ look
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = look - rate * (x.T @ (weight[:, None] * (p - y)) + ridge * (look - prior))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    chain, skip = w[FEATURES : FEATURES + k], w[FEATURES + k :]
    return w[:FEATURES], np.stack([(chain + chain.T) / 2, (skip + skip.T) / 2])


def find_spans(text: str, unary, pairwise, confidence: float = CONFIDENCE) -> list[tuple[int, int, str, bool]]:
    """``start, stop, kind, base``: kept matches, and mentions that the field labels with confidence."""
    base = [(a, b, kind, True) for a, b, kind, kept in matched(text) if kept]
    nodes = mentions(text)
    if len(nodes) > 1 and any(m.label for m in nodes) and not all(m.label for m in nodes):
        import numpy as np

        # What the patterns keep is observed: it is no node of the field, its row of the edge table goes to its neighbours.
        hidden = [i for i, m in enumerate(nodes) if not m.label]
        place = {i: k for k, i in enumerate(hidden)}
        scores = np.array([unary[nodes[i].features].sum(0) for i in hidden])
        edges = []
        for i, j, kind in neighbours(nodes):
            if i in place and j in place:
                edges.append((place[i], place[j], kind))
            elif i in place:
                scores[place[i]] += pairwise[kind][:, nodes[j].label]
            elif j in place:
                scores[place[j]] += pairwise[kind][nodes[i].label]
        p = marginals(scores, edges, pairwise)
        best = p.argmax(1)
        base += [(nodes[i].start, nodes[i].stop, LABELS[b], False) for k, i in enumerate(hidden) if (b := best[k]) and p[k, b] >= confidence]
    return sorted(base, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def private_spans(alerts: DataFrame, rows: int = TRAINING_ROWS, confidence: float = CONFIDENCE, alert_id: str = "alert_id", description: str = "description") -> DataFrame:
    """Personal data in every whole description.

    Returns one row per row of ``alerts``, all its columns and ``spans array<struct<kind, start, stop, base>>`` in code points, stop
    exclusive, by start and then kind; ``base`` marks the fixed patterns.  A NULL or empty text has no spans;
    repeated rows get equal spans; an empty table gives an empty table.  ``spans`` must not be a column of ``alerts``.
    """
    import pyarrow as pa

    unary, pairwise = train(alerts, rows, alert_id, description)
    small_batches(alerts.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "stop": b, "base": s} for a, b, k, s in find_spans(text or "", unary, pairwise, confidence)]
                for text in batch.column(description).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema)
    return alerts.mapInArrow(found, schema + ", spans array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>")


def spelled(spans: Column) -> Column:
    """``kind:start:stop``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(s["stop"] <= a["at"], a).otherwise(F.struct(
        F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")),
                 F.when(s["start"] >= a["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")).alias("out"), s["stop"].alias("at")))
    rest = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)
