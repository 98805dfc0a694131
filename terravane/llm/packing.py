"""Token pieces of alert texts and their packing into sequences by hierarchical best fit."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.texts import small_batches, stage, text_of

CAPACITY = 4096
END_ID = 1
# A worker keeps the ids of at most this many words and word forms.
KNOWN_WORDS = 500_000
# Bins of a later round that one task takes.
BINS_PER_TASK = 20_000
PIECE = "alert_id {id}, piece int, start long, length long, ids binary"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer file with its word-end ids, once per worker."""
    import os

    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ends = np.zeros(tok.get_vocab_size() + 1, dtype=bool)
    for token, i in tok.get_vocab().items():
        ends[i] = token.endswith("</w>")
    return tok, ends


# Python takes these four for white space, the tokenizer does not.
NO_SPACE = re.compile(r"[\x1c-\x1f]")
BETWEEN = re.compile(r"[^\S\x1c-\x1f]+")


class WordIds:
    """Ids of whole texts by way of their white-space separated parts.

    The tokenizer of this file drops white space and never joins across it, so the ids of a text are
    those of its parts in order.  Parts that recur are looked up; words of letters are tokenized many at a time and
    told apart by their word-end tokens.
    """

    def __init__(self, path: str, known: int = KNOWN_WORDS):
        self.tok, self.ends = tokenizer(path)
        self.known = known
        self.words: dict[str, bytes] = {}
        self.forms: dict[str, bytes] = {}

    def _encode(self, part: str) -> bytes:
        import numpy as np

        return np.array(self.tok.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        import numpy as np

        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                raw, a = ids.tobytes(), 0
                for w, b in zip(some, cut.tolist()):
                    self.words[w] = raw[4 * a : 4 * b]
                    a = b
            else:  # some word is more than one token run
                self.words.update((w, self._encode(w)) for w in some)

    def _plain(self, part: str) -> tuple[str, ...] | None:
        """A part as (marks, word in lower case, marks), where taking it apart cannot change its ids."""
        import unicodedata

        core = part.strip(punctuation)
        if not core.isalpha() or "<|" in part or "Σ" in core or "İ" in core:
            return None
        if not core.isascii() and not unicodedata.is_normalized("NFC", core):
            return None
        at = part.index(core)
        return part[:at], core.lower(), part[at + len(core) :]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.known:
            self.words.clear()
        if len(self.forms) > self.known:
            self.forms.clear()
        out = []
        for text in texts:
            parts = [x for x in BETWEEN.split(text) if x] if NO_SPACE.search(text) else text.split()
            new = set(parts).difference(self.forms)
            if new:
                plain = {p: self._plain(p) for p in new}
                wanted = {x for p in plain.values() if p for x in p}.difference(self.words)
                self._learn_words([w for w in wanted if w.isalpha()])
                self.words.update((w, self._encode(w)) for w in wanted if not w.isalpha())
                for p, x in plain.items():
                    self.forms[p] = self._encode(p) if x is None else b"".join([self.words[y] for y in x])
            out.append(b"".join(map(self.forms.__getitem__, parts)))
        return out


def token_pieces(
    alerts: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    alert_id: str = "alert_id", description: str = "description",
) -> DataFrame:
    """Token ids of every description, closed by ``end_id``; more than ``capacity`` ids are cut into pieces of that size.

    Returns ``alert_id, piece, start, length, ids`` (ids as little-endian unsigned 32-bit).  A NULL or empty text is one
    piece of the end id alone; repeated rows give repeated pieces; other columns are ignored.
    """
    import pyarrow as pa

    small_batches(alerts.sparkSession)
    base = alerts.select(F.col(alert_id).alias("alert_id"), text_of(description).alias("description"))
    schema = PIECE.format(id=base.schema["alert_id"].dataType.simpleString())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            keys, n = batch.column("alert_id"), batch.num_rows
            for lo in range(0, n, 64):
                rows, cols = [], ([], [], [], [])
                for i, ids in enumerate(encode(batch.column("description").slice(lo, 64).to_pylist())):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        rows.append(lo + i)
                        for c, v in zip(cols, (k, s // 4, len(part) // 4, part)):
                            c.append(v)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]],
                    ["alert_id", "piece", "start", "length", "ids"])

    return base.mapInArrow(pieces, schema)


def best_fit(sizes, capacity: int = CAPACITY):
    """Best fit of sizes in descending order: (bin of each item, offset of each item, fill of each bin).

    Bins are found by their free space: one bit per amount of free space that some open bin has.
    """
    import numpy as np

    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            stack = free_bins[free]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            free_bins[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fill, dtype=np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = 8, length: str = "length", bins_per_task: int = BINS_PER_TASK) -> DataFrame:
    """Hierarchical residual packing: all columns of ``pieces`` plus ``sequence_id`` and ``offset``.

    Every partition packs its own pieces by best fit and emits the bins with at most ``slack`` free places.  The
    underfull bins go, as items, to fewer partitions for another round, until one task has held them all or
    a round joins fewer than one in fifty of them.  Rows of a round: the partition's, or about ``bins_per_task`` bins.
    Every length must lie between 1 and ``capacity``; ties and repeated rows are packed one by one; an empty
    table gives an empty table.
    """
    import numpy as np
    import pandas as pd

    from pyspark import TaskContext

    names = pieces.columns

    def round_of(step: int):
        def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frames = [f for f in frames if len(f)]
            if not frames:
                return
            rows = pd.concat(frames, ignore_index=True)
            if step == 0:
                which, first = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
                totals = rows[length].to_numpy(np.int64)
            else:
                _, which = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
                first = rows["offset"].to_numpy(np.int64)
                totals = np.bincount(which, weights=rows[length].to_numpy()).astype(np.int64)
            bins, offsets, fill = best_fit(totals, capacity)
            base = (step << 58) + (TaskContext.get().partitionId() << 32)
            rows["sequence_id"] = base + bins[which]
            rows["offset"] = offsets[which] + first
            rows["done"] = (capacity - fill)[bins[which]] <= slack
            for lo in range(0, len(rows), 10_000):
                yield rows.iloc[lo : lo + 10_000]

        return packed

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, done boolean"
    step, tasks, before, parts = 0, None, None, []
    todo = pieces
    while True:
        rows = stage(todo.mapInPandas(round_of(step), schema), f"packed{step}")
        parts.append(rows.filter("done"))
        rest = rows.filter("NOT done")
        left = rest.agg(F.count_distinct("sequence_id")).first()[0] if step else rest.filter("offset = 0").count()
        if tasks == 1 or left <= 1 or (before is not None and left > 0.98 * before):
            parts.append(rest)
            break
        step, before = step + 1, left
        tasks = max(1, math.ceil(left / bins_per_task))
        todo = rest.drop("done").repartition(tasks, "sequence_id")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*names, "sequence_id", "offset")
