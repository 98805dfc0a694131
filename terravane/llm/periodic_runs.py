"""Periodic runs of words in alert texts: tiles per octave of periods, boundary Z-functions, fragments stitched per text and period."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from terravane.llm.texts import KEY, row_key, small_batches, stage, text_of

LEAST_WORDS = 12
# Boundaries of a tile lie in a core of at least this many words, or of four times the octave's smallest period.
CORE = 4096


def spacing(octave: int, least: int = LEAST_WORDS) -> int:
    """Distance of boundaries for periods ``2**octave`` to ``2**(octave + 1) - 1``.

    A run of period p matches itself p words later at ``max(p, least - p)`` positions in a row or more: so many
    neighbouring positions always hold a boundary.
    """
    low = 1 << octave
    return min(max(p, least - p) for p in {low, 2 * low - 1, *range(low, min(2 * low, least))})


def tiles_of(words: int, octave: int, least: int = LEAST_WORDS, core: int = CORE) -> list[tuple[int, int, int, int]]:
    """``(first boundary, end of boundaries, first word, end of words)`` of each tile of an octave."""
    gap, low = spacing(octave, least), 1 << octave
    step = gap * -(-max(core, 4 * low) // gap)
    return [(t, min(t + step, words), max(0, t - gap), min(words, t + step + gap + 2 * low)) for t in range(0, words, step)]


def next_same(ids, gram: int):
    """Distance from each word to the next place where the same ``gram`` words stand; a huge number if there is none.

    Groups of words are told apart by hashes: equal groups are always found, different ones may very rarely be taken for equal,
    which costs a look at a boundary and changes no result.
    """
    import numpy as np

    n = len(ids) - gram + 1
    away = np.full(max(len(ids), 1), np.iinfo(np.int64).max, dtype=np.int64)
    if n < 2:
        return away
    h = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(gram):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    away[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return away


def z_function(s, start: int, until: int) -> dict[int, int]:
    """``z[i]``: length of the longest common beginning of ``s`` and ``s[i:]``, for ``start <= i < until`` where it is not 0.

    ``s`` is a string or a list.  Positions are found by the first symbol; inside the rightmost match known so far the value is
    looked up, so no symbol is compared again, and beyond it compared in doubling stretches.
    """
    z: dict[int, int] = {}
    n = len(s)
    until = min(until, n)
    left = right = 0
    i = 0
    while True:
        try:
            i = s.index(s[0], i + 1, until)
        except ValueError:
            break
        length = 1
        if i < right:
            known = z.get(i - left, 0)
            if known < right - i:
                if known:
                    z[i] = known
                continue
            length = right - i
        step = 8
        while i + length < n:
            step = min(step, n - i - length)
            if s[length : length + step] == s[i + length : i + length + step]:
                length += step
                step *= 2
            elif step == 1:
                break
            else:
                step = max(1, step // 4)
        z[i] = length
        if i + length > right:
            left, right = i, i + length
    return z if start <= 1 else {i: v for i, v in z.items() if i >= start}


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def is_power(root) -> bool:
    """Whether a string or list is a shorter one written several times."""
    n = len(root)
    return any(root[n // r :] == root[: n - n // r] for r in prime_factors(n))


def _has_period(s, most: int) -> bool:
    """Whether a string is seen to have a period of at most ``most``.

    Around a boundary that rules out all longer periods of the octave: a run of period p holds there p words and as many
    as the shorter period, or all of its own, so both periods hold in it and p is a multiple of a smaller one.
    """
    if most < 1 or not isinstance(s, str) or len(s) <= most:
        return False
    d = s.find(s[: len(s) - most], 1)
    return 0 < d <= most and s[d:] == s[:-d]


def solve_tile(ids, octave: int, first: int, offset: int, words: int, least: int = LEAST_WORDS, core: int = CORE) -> list[tuple[int, int, int]]:
    """Fragments ``(period, from, until)`` of one tile: stretches of positions whose word stands again ``period`` words later.

    ``ids`` are the tile's words from word ``offset`` of a text of ``words`` words on; ``first`` is its first boundary.  At a boundary m one
    Z-function of the words from m on and one of the words before m, read backwards, give for every period how far the match reaches
    to both sides; neighbouring boundaries take over beyond their distance.  Fragments that are whole and too short for a run, and those
    whose period is a multiple of a smaller one, are left out.
    """
    import numpy as np

    low, gap, gram = 1 << octave, spacing(octave, least), -(-least // 2)
    high = 2 * low
    step = gap * -(-max(core, 4 * low) // gap)
    last = min(first + step, words)
    near = next_same(ids, gram) < high
    if not near.any():
        return []
    # A boundary matters only if a repeated group of words starts around it.
    before = np.concatenate([[0], np.cumsum(near)])
    marks = np.arange(first, last, gap) - offset
    alive = marks[before[np.minimum(marks + gap, len(ids))] > before[np.maximum(marks - gap, 0)]].tolist()
    # Symbols of a string compare fastest; a tile of more different words than there are symbols is compared as a list.
    text = ids.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") if int(ids.max()) < 0x10FFFF else ids.tolist()
    back = text[::-1]
    n, blank = len(text), chr(0x10FFFF) if isinstance(text, str) else [-1]
    found: dict[int, list[list[int]]] = {}
    for m in alive:
        around = text[max(0, m - gap) : m + high + gap]
        if _has_period(around, low - 1):
            continue
        ahead = z_function(text[m : min(n, m + high + gap)], low, high)
        if not ahead:
            continue
        # Backwards: the words before m against those before m + p, both at most to the neighbouring boundary.
        behind, reach = {}, min(m, gap)
        if reach:
            top = min(n, m + high - 1)
            own = back[n - m : n - m + reach]
            behind = z_function(own + blank + back[n - top : n - (m + low) + reach], reach + 1, 1 << 62)
        for p, forward in ahead.items():
            lo = m - min(reach, behind.get(reach + 1 + (min(n, m + high - 1) - (m + p)), 0)) if reach else m
            hi = m + min(forward, gap)
            spans = found.setdefault(p, [])
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
    out = []
    begin, end = first - offset - gap, (last - 1 - first) // gap * gap + first - offset + gap
    for p, spans in found.items():
        for lo, hi in spans:
            whole = (lo > begin or lo + offset == 0) and (hi < end or hi + offset + p >= words)
            if whole and hi - lo < max(p, least - p):
                continue
            if not is_power(text[lo : lo + p]):
                out.append((p, lo + offset, hi + offset))
    return out


def _word_ids(words: list[bytes]):
    import numpy as np

    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32)


def _repeats(ids, least: int):
    """Distances to the next same group of words, or None where no run is possible."""
    import numpy as np

    if len(ids) < least:
        return None
    away = next_same(ids, -(-least // 2))
    return away if (away < np.iinfo(np.int64).max).any() else None


# Bytes of texts and tiles that a task gathers before it hands them on.
FLUSH = 4 << 20


def _cut(least: int, core: int, kind):
    """Texts in which a group of words recurs, and a row for each tile around such places; the other texts have no run."""
    import pyarrow as pa

    schema = pa.schema([("link", kind), *[(k, pa.int64()) for k in KEY], ("text", pa.binary()), ("octave", pa.int32()), ("first", pa.int64()),
                        ("origin", pa.int64()), ("words", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            links, k1, k2 = (batch.column(c).to_pylist() for c in ("link", *KEY))
            rows, size = [], 0
            for row, text in enumerate(batch.column("text")):
                words = text.as_buffer().to_pybytes().split()
                ids = _word_ids(words)
                away = _repeats(ids, least)
                if away is None:
                    continue
                joined, n = b" ".join(words), len(ids)
                rows.append((links[row], k1[row], k2[row], joined, None, None, None, None, None))
                size += len(joined)
                for octave in range((n // 2).bit_length()):
                    near = np.concatenate([[0], np.cumsum(away[:n] < (2 << octave))])
                    gap = spacing(octave, least)
                    for first, last, begin, end in tiles_of(n, octave, least, core):
                        if near[min(n, last + gap)] > near[max(0, first - gap)]:
                            rows.append((None, k1[row], k2[row], None, octave, first, begin, n, ids[begin:end].tobytes()))
                            size += 4 * (end - begin)
                            if size > FLUSH:
                                yield _record(rows, schema)
                                rows, size = [], 0
            if rows:
                yield _record(rows, schema)

    return run


def _record(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _solve(least: int, core: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=np.int32)
                got = solve_tile(ids, row["octave"], row["first"], row["origin"], row["words"], least, core)
                if got:
                    p, lo, hi = (pa.array(x, pa.int64()) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([*[pa.array([row[k]] * len(got), pa.int64()) for k in KEY], p, lo, hi], [*KEY, "period", "lo", "hi"])

    return run


def _plain(least: int):
    """Texts in which no group of words recurs: no runs, all words kept."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, kept = [], [], []
            for row, text in enumerate(batch.column("text")):
                words = text.as_buffer().to_pybytes().split()
                if len(words) >= least and _repeats(_word_ids(words), least) is not None:
                    continue
                rows.append(row)
                n.append(len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("link").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["link", "n_words", "collapsed"])

    return run


def _collapse():
    """Words of a text without those a run repeats."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            n, kept = [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = text.split(b" ") if text else []
                n.append(len(words))
                if runs:
                    over = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(over, [r["start"] + r["period"] for r in runs], 1)
                    np.add.at(over, [r["start"] + r["length"] for r in runs], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(over)[:-1] == 0).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("link"), pa.array(n, pa.int64()), batch.column("runs"), pa.array(kept, pa.string())], ["link", "n_words", "runs", "collapsed"])

    return run


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def stitched(fragments: DataFrame, by: list[str], least: int = LEAST_WORDS) -> DataFrame:
    """Runs ``start, length, period`` from fragments ``period, lo, hi`` of one text: those that touch are one."""
    order = W.partitionBy(*by, "period").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = fragments.withColumn("_new", F.when(F.col("lo") <= reached, 0).otherwise(1)).withColumn(
        "_part", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = parts.groupBy(*by, "period", "_part").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.first("period")).alias("length"))
    return runs.filter(F.col("length") >= F.greatest(F.lit(least), 2 * F.col("period"))).select(*by, "start", "length", "period")


def periodic_runs(alerts: DataFrame, least: int = LEAST_WORDS, core: int = CORE, link: str = "link", description: str = "description") -> DataFrame:
    """Periodic runs of words in every alert's description, and the description without the repetitions.

    Words are maximal stretches of anything but space, tab, line feed, vertical tab, form feed and carriage return.  A run is a stretch of words with
    smallest period q (words q apart are equal), of at least ``max(least, 2 q)`` words, that no neighbouring word extends.  Returns one row per row
    of ``alerts``: ``link, n_words, runs`` (array of ``start, length, period`` by start, then period; words count from 0) and ``collapsed`` (the words
    that no run contains after its first q words, joined by one space).

    Texts are cut into overlapping tiles for each octave of periods, only around places where a group of ``least / 2`` words recurs within the
    octave (a run always has one); tiles are dealt out and solved alone, their fragments meet per text and period.  Equal texts share
    their tiles.  NULL and empty texts have no words; repeated rows and NULL links keep their rows; an empty table gives an
    empty table; other columns, whatever their names, are ignored.
    """
    spark = alerts.sparkSession
    small_batches(spark, 256)
    base = alerts.select(F.col(link).alias("link"), text_of(description).alias("text"))
    base = base.select("link", *row_key("text"), F.col("text").cast("binary").alias("text"))
    kind = base.schema["link"].dataType.simpleString()
    keys = ", ".join(f"{k} long" for k in KEY)
    cut = stage(base.mapInArrow(_cut(least, core, to_arrow_type(base.schema["link"].dataType)), (
        f"link {kind}, {keys}, text binary, octave int, first long, origin long, words long, ids binary")), "cut")
    tiles, texts = cut.filter("ids IS NOT NULL").drop("link", "text"), cut.filter("ids IS NULL").select("link", *KEY, "text")
    # One tile for all copies of a text; copies meet as partial results, and the key deals the tiles out.
    dealt = tiles.groupBy(*KEY, "octave", "first").agg(*[F.first(c).alias(c) for c in ("origin", "words", "ids")])
    fragments = dealt.mapInArrow(_solve(least, core), f"{keys}, period long, lo long, hi long")
    runs = stitched(fragments, KEY, least).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.select(*KEY, F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    # At most one run starts per word and period, so the list of a text is bounded by the text.
    with_runs = texts.join(runs, KEY, "left").select("link", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    collapsed = with_runs.mapInArrow(_collapse(), f"link {kind}, n_words long, runs {RUNS}, collapsed string")
    plain = base.select("link", "text").mapInArrow(_plain(least), f"link {kind}, n_words long, collapsed string")
    return collapsed.unionByName(plain.select("link", "n_words", F.array().cast(RUNS).alias("runs"), "collapsed"))
