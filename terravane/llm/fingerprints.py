"""Fingerprints of alert texts from prefix polynomial hashes, and of texts that take over half of the next one.

A prefix array of c[i] * B^i modulo a prime gives the hash of any span in O(1), so equality of spans is one
comparison and the longest common extension of two texts a binary search.  The fingerprint keeps the hashes of
prefixes and suffixes at growing lengths, and the smallest hashes of all spans of a fixed width.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.texts import small_batches, text_of

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 69069069)
SPAN = 32
SKETCH = 16
GROWTH = 1.25
ROWS_PER_RANGE = 4096
MOST_RANGES = 2048


def grid(length: int, growth: float = GROWTH) -> list[int]:
    """Lengths 1, 2, 3, ... growing by about ``growth``, up to ``length``."""
    out, g = [], 1
    while g <= length:
        out.append(g)
        g = max(g + 1, int(g * growth))
    return out


class Powers:
    """Powers of a base and of its inverse modulo a prime, as long as the longest text so far."""

    def __init__(self, base: int, prime: int):
        self.base, self.inverse, self.prime = base, pow(base, -1, prime), prime
        self.up = self.down = None

    def upto(self, n: int) -> Powers:
        import numpy as np

        if self.up is None or len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            p = np.uint64(self.prime)
            for name, b in (("up", self.base), ("down", self.inverse)):
                table = np.ones(size, dtype=np.uint64)
                k = 1
                while k < size:  # doubling: b^(i+k) = b^i * b^k
                    table[k : 2 * k] = table[:k] * np.uint64(pow(b, k, self.prime)) % p
                    k *= 2
                setattr(self, name, table)
        return self


class Prefixes:
    """Prefix arrays of one text under one prime: ``span(i, j)`` is the hash of [i, j), wherever it stands."""

    def __init__(self, codes, powers: Powers):
        import numpy as np

        self.powers, self.p = powers.upto(len(codes) + 1), np.uint64(powers.prime)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers.up[: len(codes)] % self.p, out=self.sums[1:])

    def span(self, i, j):
        return (self.sums[j] - self.sums[i]) % self.p * self.powers.down[i] % self.p

    def windows(self, width: int):
        """Hashes of all spans of ``width``."""
        sums = self.sums
        return (sums[width:] - sums[:-width]) % self.p * self.powers.down[: len(sums) - width] % self.p


class Fingerprints:
    """``n:hash:prefixes:suffixes:sketch`` of texts, numbers in hexadecimal."""

    def __init__(self):
        self.powers = [Powers(b, p) for b, p in zip(BASES, PRIMES)]

    def __call__(self, text: str) -> str:
        import numpy as np

        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n = len(codes)
        if not n:
            return "0::::"
        one, two = (Prefixes(codes, p) for p in self.powers)
        g = np.array(grid(n))
        zero = np.zeros(len(g), dtype=np.int64)
        mix = lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
        ahead = mix(one.span(zero, g), two.span(zero, g))
        behind = mix(one.span(n - g, np.full(len(g), n)), two.span(n - g, np.full(len(g), n)))
        spans = one.windows(min(SPAN, n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        # Few values lie below a bound of a small share of the range: only those are sorted.
        low = spans[spans < np.uint64(min(1 << 32, (8 * SKETCH << 32) // len(spans)))]
        least = np.unique(low)[:SKETCH]
        if len(least) < SKETCH:
            least = np.unique(spans)[:SKETCH]
        words = lambda v: v.astype(">u4").tobytes().hex()
        return f"{n:x}:{int(one.span(0, n)):08x}{int(two.span(0, n)):08x}:{words(ahead)}:{words(behind)}:{words(least)}"


def _extension(a: str, b: str, lengths: list[int]) -> int:
    """Longest grid length at which two rows of hashes agree, by binary search: they agree up to a place and not beyond."""
    lo, hi = 0, min(len(a), len(b)) // 8
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[8 * mid - 8 : 8 * mid] == b[8 * mid - 8 : 8 * mid]:
            lo = mid
        else:
            hi = mid - 1
    return lengths[lo - 1] if lo else 0


def likeness(a: str, b: str) -> float:
    """Share of the text that two fingerprints agree on, 0 to 1; equal fingerprints have 1.

    The larger of: common beginning and end by the longest common extensions, and the likeness of the sets of spans.
    Resolution: extensions are found at stored lengths that grow by GROWTH, so each may be up to a fifth too short; the sets are
    known by SKETCH smallest hashes, in steps of 1/16, so a common passage of a few percent usually gives 0.
    """
    if a == b:
        return 1.0
    na, _, pa, sa, ka = a.split(":")
    nb, _, pb, sb, kb = b.split(":")
    x, y = int(na, 16), int(nb, 16)
    if not x or not y:
        return 0.0
    lengths = grid(min(x, y))
    ends = min(_extension(pa, pb, lengths) + _extension(sa, sb, lengths), min(x, y)) / max(x, y)
    u, v = {ka[i : i + 8] for i in range(0, len(ka), 8)}, {kb[i : i + 8] for i in range(0, len(kb), 8)}
    union = sorted(u | v)[: max(len(u), len(v))]
    return min(0.999999, max(ends, len(set(union) & u & v) / len(union)))


def _ranges(alerts: DataFrame, rows: int, most: int) -> list[int]:
    """Bounds of ranges of ids with about ``rows`` rows each, at most ``most`` of them."""
    n = alerts.count()
    parts = max(1, min(most, n // rows))
    if parts == 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(alerts.select(F.percentile_approx("alert_id", shares, 100 * parts).alias("q")).first()["q"] or []))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds not above the key, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]), lambda b: b <= key)) * step
    return coarse + F.size(F.filter(F.slice(every, coarse + 1, F.lit(step)), lambda b: b <= key))


def fingerprint_alerts(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of all descriptions, and of each with its second half replaced by the beginning of the next.

    The next alert is the one with the next smaller ``alert_id``, after the last the first; the last floor(n / 2) code points
    give way to as many of its first (or all).  Returns one row per row of ``alerts``: ``alert_id, n_chars, fingerprint, edited_sha256,
    edited_fingerprint, near_edited, near_next``.  A NULL text is empty; NULL ids come last; rows that repeat an id follow each other in
    the order of a hash of their texts; a single row is its own next; other columns are ignored.

    One shuffle of the texts, by ranges of ids.  The first text of a range is also sent to the range before it, so
    ranges need nothing else from each other; a range is streamed in order.
    """
    import pyarrow as pa

    small_batches(alerts.sparkSession, 256)
    base = alerts.select(F.col(alert_id).alias("alert_id"), text_of(description).alias("description"))
    bounds = _ranges(base, rows_per_range, MOST_RANGES)
    placed = base.withColumn("part", F.when(F.col("alert_id").isNull(), F.lit(-1)).otherwise(_range_of(F.col("alert_id"), bounds))).withColumn(
        "tie", F.xxhash64("description"))
    # First row of each range, in descending order of ids; one row per range, so the list is bounded.
    order = F.struct(F.col("alert_id").alias("k"), F.negative(F.shiftright("tie", 1)).alias("t"))
    firsts = {r["part"]: r["first"] for r in placed.groupBy("part").agg(F.max(order).alias("first")).collect()}
    parts = sorted(firsts, reverse=True)
    above = {p: parts[i - 1] for i, p in enumerate(parts)}  # the top range's first row follows the lowest range
    kind = base.schema["alert_id"].dataType.simpleString()
    guests = alerts.sparkSession.createDataFrame(
        [(p, firsts[p]["k"], firsts[p]["t"], above[p]) for p in parts], f"part int, _k {kind}, _t long, target int")
    mine = (F.col("alert_id").eqNullSafe(F.col("_k"))) & (F.negative(F.shiftright("tie", 1)) == F.col("_t"))
    joined = placed.join(F.broadcast(guests), "part").withColumn("to", F.explode(
        F.when(mine, F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("target").alias("part"), F.lit(1).alias("guest")))).otherwise(
            F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))))))
    sent = joined.select("to.part", "to.guest", "alert_id", "tie", "description")
    sorted_ranges = sent.repartition(max(1, len(parts)), "part").sortWithinPartitions(
        "part", "guest", F.col("alert_id").desc_nulls_last(), F.shiftright("tie", 1), "tie")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        make, held, out = Fingerprints(), None, []

        def row(this, following):
            _, key, text, mark = this
            half = len(text) // 2
            edited = text[: len(text) - half] + following[2][:half]
            other = mark if edited == text else make(edited)
            return (key, len(text), mark, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), other, likeness(mark, other), likeness(mark, following[3]))

        names = ["alert_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            ids = batch.column("alert_id")
            columns = (batch.column("part").to_pylist(), batch.column("guest").to_pylist(), ids.to_pylist(), batch.column("description").to_pylist())
            for part, guest, key, text in zip(*columns):
                if held is None and guest:
                    continue  # a second guest of the same range
                now = (part, key, text, make(text))
                if held is not None:
                    out.append(row(held, now))
                held = None if guest else now
            if out:
                types = [ids.type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []

    return sorted_ranges.mapInArrow(
        walk, f"alert_id {kind}, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double")
