"""Near-repeated alerts by b-bit MinHash: bands propose, packed low bits estimate, full sets decide."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.components import components
from terravane.llm.texts import KEY, row_key, small_batches, stage, text_of

SHINGLE = 3
# Similarity as a fraction of whole numbers: 85 of 100.
SIMILAR = (85, 100)
# 32 bands of 8 minima: a pair of similarity 0.85 shares no band once in 26,000.
BANDS, ROWS = 32, 8
# Low bits kept of each minimum.
BITS = 2
# Up to so many texts around a pivot are compared directly, larger crowds by their differences from it.
FEW = 8
# Keys of at most this many texts (24 MB) are broadcast, beyond it both sides are shuffled.
BROADCAST_KEYS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Shingles:
    """Sets of word n-grams as sorted 64-bit hashes; a text of fewer words, but not none, is one n-gram."""

    def __init__(self, size: int = SHINGLE, known: int = 300_000):
        self.size, self.known, self.words = size, known, {}

    def __call__(self, text: bytes):
        import numpy as np
        from xxhash import xxh3_64_intdigest as digest

        parts, known = text.translate(_LOWER).split(), self.words
        if len(known) > self.known:
            known.clear()
        for p in parts:
            if p not in known:
                known[p] = digest(p)
        w = np.array([known[p] for p in parts], dtype=np.uint64)
        if not len(w):
            return w
        n, size = max(1, len(w) - self.size + 1), min(self.size, len(w))
        h = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            h = (h ^ w[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return np.unique(h)


def minima(values, multipliers, offsets):
    """The minimum of every hash function over a set of 64-bit hashes, taken on 32 of their bits."""
    import numpy as np

    low = ((values ^ (values >> np.uint64(29))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(len(multipliers), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(low), 256):
        part = low[at : at + 256, None] * multipliers[None, :]
        part += offsets[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def _functions(number: int):
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(20240502))
    return rng.integers(0, 2**31, number, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, number, dtype=np.uint32)


def packed_bits(least, bits: int = BITS):
    """The low bits of all minima in 64-bit words: one run of bits per bit position, so that equal minima leave all their places equal."""
    import numpy as np

    mixed = least * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    planes = np.concatenate([((mixed >> np.uint32(i)) & np.uint32(1)).astype(np.uint8) for i in range(bits)])
    return np.packbits(np.concatenate([planes, np.zeros(-len(planes) % 64, dtype=np.uint8)])).view(np.int64)


def estimated_similarity(a: str, b: str, number: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Similarity of two packed signatures, corrected for minima that differ but share their low bits.

    The places of one minimum lie in different planes of ``number`` bits, which are whole words; a minimum counts as equal if it is
    in all planes.  Of different minima 1 in ``2**bits`` looks equal: s = (e - c) / (1 - c).
    """
    words = number // 64
    equal = F.lit(0)
    for i in range(words):
        apart = F.lit(0).cast("long")
        for plane in range(bits):
            at = F.lit(i + plane * words)
            apart = apart.bitwiseOR(F.get(a, at).bitwiseXOR(F.get(b, at)))
        equal = equal + (F.lit(64) - F.bit_count(apart))
    chance = 1 / 2**bits
    return (equal / F.lit(float(number)) - chance) / (1 - chance)


def surely_different(similarity: float, number: int = BANDS * ROWS, bits: int = BITS, deviations: float = 8.0) -> float:
    """Estimate below which a pair of the given similarity falls less than once in 10**11 (binomial tail, 256 minima, 8 deviations)."""
    chance = 1 / 2**bits
    e = similarity + (1 - similarity) * chance
    return (e - deviations * (e * (1 - e) / number) ** 0.5 - chance) / (1 - chance)


def signatures(alerts: DataFrame, shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    """``link, _k1, _k2, node, n, bands, bits`` of alerts ``link, _k1, _k2, text``: name and size of the set of shingles, a hash per band,
    packed low bits.  Texts without words have no node."""
    import pyarrow as pa

    number = bands * rows
    if number % 64:
        raise ValueError("bands * rows must be a multiple of 64")
    kind = alerts.schema["link"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_hexdigest

        shingles, (mul, add) = Shingles(shingle), _functions(number)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                s = shingles(text.as_buffer().to_pybytes())
                if not len(s):
                    out.append((None, 0, None, None))
                    continue
                least = minima(s, mul, add)
                h, grid = salt.copy(), least.reshape(bands, rows).astype(np.uint64)
                for i in range(rows):
                    h = (h ^ grid[:, i]) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(31)
                out.append((xxh3_128_hexdigest(s.tobytes()), len(s), h.view(np.int64), packed_bits(least, bits)))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("link", *KEY)], *columns], ["link", *KEY, "node", "n", "bands", "bits"])

    return alerts.mapInArrow(run, f"link {kind}, {KEY[0]} long, {KEY[1]} long, node string, n long, bands array<bigint>, bits array<bigint>")


def _sets(base: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of the wanted nodes ``node, own_link, own_1, own_2``, from the texts of ``base``: ``link, _k1, _k2, text``."""
    import pyarrow as pa

    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    wanted = F.broadcast(wanted) if few else wanted
    same = (F.col(KEY[0]) == F.col("own_1")) & (F.col(KEY[1]) == F.col("own_2")) & F.col("link").eqNullSafe(F.col("own_link"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sets = [shingles(t.as_buffer().to_pybytes()).view("int64") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    # Repeated rows have the same text under the same link: one of them is enough.
    return base.join(wanted, same).select("node", "text").mapInArrow(made, "node string, shingles array<bigint>").dropDuplicates(["node"])


def _similar(both: Column, a: Column, b: Column, similar: tuple[int, int]) -> Column:
    return both.cast("long") * similar[1] >= (a + b - both).cast("long") * similar[0]


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with both sets and the number of shingles they share."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))


def differing_members(members: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Candidate pairs ``a, b`` inside crowds: every pair that is linked, without comparing all members with each other.

    ``members``: ``pivot, node, n, np, diff, root``, where ``diff`` holds the shingles in which a member and its pivot differ, ``n`` and ``np``
    are the sizes of their sets.  The sets of two members x and y differ in ``|dx| + |dy| - 2 |dx & dy|`` shingles, and a link allows
    ``k (nx + ny)`` of them at most, ``k = (1 - s) / (1 + s)``: so linked members share at least ``(|dx| + |dy| - k (nx + ny)) / 2`` differences.
    Members linked to the pivot are in one class already.  Any other has more than ``k (n + np)`` differences, which makes it share at least one,
    and more than ``(1 - k) / 2`` of its partner's.  Differences are ordered by their number in the crowd, rare ones first: two
    members that share c of them meet in the first ``|d| - c + 1`` of each.
    """
    up, down = similar
    k, slack = (down - up) / (down + up), 1e-6
    d = F.size("diff")
    # A partner's set is larger by 1 / s at most, so k (nx + ny) is n (1 - s) / s at most; sizes of differences are apart by no more.
    most = F.col("n") * ((down - up) / up)
    linked = F.lit(down - up) * (F.col("n") + F.col("np")) >= F.lit(up + down) * d
    least_any = F.greatest(F.lit(0.0), d - most)
    least_open = F.greatest(least_any, k * (F.col("n") * (up / down) + F.col("np")))
    shared = lambda partner: F.greatest(F.lit(1), F.ceil((d + partner - most) / 2 - slack))
    half = F.floor(d * ((1 - k) / 2) - slack) + 1
    sized = members.select("pivot", "node", "n", "root", "diff", d.alias("d"), linked.alias("linked"), (d - shared(least_any) + 1).alias("to_any"),
                           (d - F.greatest(shared(least_open), half) + 1).alias("to_open"))
    spread = sized.select("pivot", "node", F.explode("diff").alias("e"))
    often = spread.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    met = spread.join(often, ["pivot", "e"]).groupBy("pivot", "node").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("es"))
    ranked = sized.drop("diff").join(met, ["pivot", "node"])
    # Differences that only one member has come first and meet nobody.
    lonely = F.col("d") - F.size("es")

    def rows(df: DataFrame, first: str, side: str) -> DataFrame:
        reach = F.least(F.size("es"), F.greatest(F.lit(0), F.col(first) - lonely)).cast("int")
        return df.select("pivot", F.posexplode(F.transform(F.slice("es", F.lit(1), reach), lambda t: t["e"])).alias("i", "e"),
                         *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "d")], lonely.alias("lonely")).withColumn(
            f"place_{side}", F.col("i") + F.col("lonely")).drop("i", "lonely")

    opened, closed = ranked.filter("NOT linked"), ranked.filter("linked")
    fits = (F.col("n_a") * down >= F.col("n_b") * up) & (F.col("n_b") * down >= F.col("n_a") * up) & (F.col("root_a") != F.col("root_b"))
    # With both sizes known: from their first shared difference on, both must have as many as they need.
    needed = F.greatest(F.lit(1), F.ceil((F.col("d_a") + F.col("d_b") - k * (F.col("n_a") + F.col("n_b"))) / 2 - slack))
    fits = fits & (F.col("place_a") + needed <= F.col("d_a")) & (F.col("place_b") + needed <= F.col("d_b"))
    mixed = rows(opened, "to_any", "a").join(rows(closed, "to_open", "b"), ["pivot", "e"]).filter(fits)
    alike = rows(opened, "to_open", "a").join(rows(opened, "to_open", "b"), ["pivot", "e"]).filter(fits & (F.col("node_a") < F.col("node_b")))
    return mixed.unionByName(alike).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def near_repeats(alerts: DataFrame, similar: tuple[int, int] = SIMILAR, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS,
                 few: int = FEW, link: str = "link", description: str = "description") -> DataFrame:
    """Class of near-repeated alerts of every alert of a feed.

    Two alerts are linked if their sets of word n-grams share ``similar[0]`` of ``similar[1]`` parts of all they hold.  Words are maximal stretches
    of anything but space and the control characters tab to carriage return, A-Z lower-cased; a text of fewer words than ``shingle`` is
    one n-gram.  Returns one row per row of ``alerts``: ``link, n_shingles, class_link`` (the smallest link that the alert is connected with,
    itself included) and ``kept`` (whether it is that one).

    Texts that share a band of minima are candidates (a pair at 0.85 is met with probability 0.99996).  The text of a band that stands in the
    fullest bands is its pivot; all others of the band are compared with it on their full sets, unless the corrected estimate from the packed
    low bits rules that out (for a pair at 0.85 less than once in 10**11).  Those still apart are then compared with each other: in small groups
    in the same way, in crowds by the rare shingles in which they differ from the pivot, which finds all of them.

    NULL, empty and wordless texts have no shingles and are alone; repeated rows share a class; a NULL link takes the class of its text
    without naming it, and is not kept if the class has a name; a link that stands for several texts does not connect them; an empty table
    gives an empty table; other columns, whatever their names, are ignored.
    """
    small_batches(alerts.sparkSession)
    limit = surely_different(similar[0] / similar[1], bands * rows, bits)
    base = alerts.select(F.col(link).alias("link"), text_of(description).alias("text"))
    base = base.select("link", *row_key("text"), F.col("text").cast("binary").alias("text"))
    signed = stage(signatures(base, shingle, bands, rows, bits), "signed")
    # A node is a set of shingles; its text is looked up by one of its rows.
    one = F.min(F.struct("link", *KEY))
    own = stage(signed.filter("node IS NOT NULL").groupBy("node").agg(one.alias("one"), *[F.first(c).alias(c) for c in ("n", "bands", "bits")]), "own")
    spread = own.select("node", F.posexplode("bands").alias("band", "value"))
    full = spread.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = stage(spread.join(full, ["band", "value"]), "met")
    # The text in the fullest bands lies in the middle of its crowd.
    crowd = met.groupBy("node").agg(F.sum("size").alias("crowd"))
    pivots = met.join(crowd, "node").groupBy("band", "value").agg(F.max_by("node", F.struct("crowd", "node")).alias("pivot"))
    around = stage(met.join(pivots, ["band", "value"]).select("pivot", "node").distinct(), "around")
    wanted = own.join(around.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("one.link").alias("own_link"), *[F.col(f"one.{k}").alias(f"own_{i + 1}") for i, k in enumerate(KEY)])
    sets = stage(_sets(base, wanted, shingle), "sets")
    sketch = own.select("node", "n", "bits")

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketch.toDF("a", "na", "ca"), "a").join(sketch.toDF("b", "nb", "cb"), "b")
        small, large = F.least("na", "nb"), F.greatest("na", "nb")
        near = near.filter((small * similar[1] >= large * similar[0]) & (estimated_similarity("ca", "cb", bands * rows, bits) >= limit))
        return _compared(near.select("a", "b"), sets).filter(_similar(F.col("both"), F.size("sa"), F.size("sb"), similar)).select("a", "b")

    links = stage(linked(around.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))), "links")
    roots = stage(components(links), "roots")
    placed = around.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1 AND size > 2")
    apart = stage(placed.join(mixed.select("pivot", "size"), "pivot"), "apart")
    if not apart.isEmpty():
        small = apart.filter(F.col("size") <= few + 1).filter("node != pivot").select("pivot", "node", "root")
        pairs = small.toDF("pivot", "a", "ra").join(small.toDF("pivot", "b", "rb"), "pivot").filter("a < b AND ra != rb").select("a", "b").distinct()
        crowds = apart.filter(F.col("size") > few + 1)
        seen = _compared(crowds.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "root"), sets)
        diff = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
        members = stage(seen.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "root", F.size("sa").alias("np"), F.size("sb").alias("n"),
                                    diff.alias("diff")), "members")
        pairs = stage(pairs.unionByName(differing_members(members, similar)).distinct(), "pairs")
        more = stage(linked(pairs), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = stage(components(links), "roots")
    named = own.select("node", F.col("one.link").alias("link")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A link of one row may be NULL: the smallest of all rows of the class names it.
    rooted = signed.select("node", "link").groupBy("node").agg(F.min("link").alias("least")).join(named.select("node", "root"), "node")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_link")), "root").select("node", "class_link")
    out = signed.select("link", "node", "n").join(classes, "node", "left")
    class_link = F.coalesce("class_link", "link")
    return out.select("link", F.col("n").alias("n_shingles"), class_link.alias("class_link"),
                      F.when(F.col("link").isNull(), class_link.isNull()).otherwise(F.col("link") == class_link).alias("kept"))
