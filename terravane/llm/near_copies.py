"""Near copies among alert texts: word n-gram Jaccard join by a MinHash LSH forest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.bit_copies import differing_members
from terravane.llm.components import components
from terravane.llm.texts import small_batches, stage, text_of

SHINGLE = 5
SIMILARITY = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999
# Up to so many texts around a pivot are compared directly, larger crowds by their differences from it.
FEW = 8
# Members of a class that one task compares with each other.
BLOCK = 512
# Up to this many keys (24 MB) a list of keys is broadcast to the texts, beyond it both are shuffled.
BROADCAST_KEYS = 1_000_000
_SPACE = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def prefix_length(trees: int = TREES, depth: int = DEPTH, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Longest prefix of the tries at which a pair of the given similarity meets in some tree with at least ``recall``.

    Starts at full depth and shortens: P(meet) = 1 - (1 - s^k)^trees.
    """
    k = depth
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


class Shingles:
    """Sets of word n-grams as sorted 64-bit hashes; hashes of words are remembered."""

    def __init__(self, size: int = SHINGLE, known: int = 300_000):
        self.size, self.known, self.words = size, known, {}

    def word_hashes(self, text: str):
        import numpy as np
        from xxhash import xxh3_64_intdigest as digest

        # UTF-8 bytes: anything but digits, letters a-z and bytes beyond ASCII becomes a space.
        parts = text.encode("utf-8", "surrogatepass").translate(_SPACE).split(b" ")
        known = self.words
        if len(known) > self.known:
            known.clear()
        for p in [p for p in parts if p not in known]:
            known[p] = digest(p)
        return np.array([known[p] for p in parts if p], dtype=np.uint64)

    def __call__(self, text: str):
        """A text of fewer words, but not none, is one shingle."""
        import numpy as np

        w = self.word_hashes(text)
        if not len(w):
            return w
        n = max(1, len(w) - self.size + 1)
        h = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
        for k in range(min(self.size, len(w))):
            h = (h ^ w[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return np.unique(h)


def _marks(trees: int, k: int):
    """Multipliers and offsets of the hash functions: ``k`` for each tree."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(20240501))
    size = trees * k
    return (rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)), rng.integers(0, 2**63, size, dtype=np.uint64)


def _prefixes(values, trees: int, levels: list[int], multipliers, offsets):
    """Per length in ``levels`` one 64-bit value per tree, the tree's first minima folded together; and one bit of every minimum, in 64-bit words."""
    import numpy as np

    k = max(levels)
    least = np.full(trees * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(values), 512):
        part = values[lo : lo + 512, None] * multipliers[None, :]
        part += offsets[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    ones = ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.uint8)
    bits = np.packbits(np.concatenate([ones, np.zeros(-len(ones) % 64, dtype=np.uint8)])).view(np.int64)
    least = least.reshape(trees, k)
    out, at = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), {}
    for i in range(k):
        out = (out ^ least[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        at[i + 1] = out.view(np.int64)
    return [at[n] for n in levels], bits


def most_different_bits(minima: int, similarity: float = SIMILARITY, deviations: float = 5.5) -> int:
    """Bits of ``minima`` that a pair of the given similarity differs in at most, but for rare exceptions.

    A minimum differs with probability 1 - s, its bit with half of that.  Pairs beyond it are put off, not dropped: the last turn
    does without this bound.
    """
    p = (1 - similarity) / 2
    return math.ceil(minima * p + deviations * (minima * p * (1 - p)) ** 0.5)


def signatures(alerts: DataFrame, levels: list[int], trees: int = TREES, shingle: int = SHINGLE,
               alert_id: str = "alert_id", description: str = "description") -> DataFrame:
    """``alert_id, k1, k2, n, prefixes, bits``: key of the set of shingles, its size, per length in ``levels`` one trie prefix per tree, bits of the minima.

    Texts without words have a NULL key.
    """
    import pyarrow as pa

    small_batches(alerts.sparkSession)
    base = alerts.select(F.col(alert_id).alias("alert_id"), text_of(description).alias("description"))
    kind = base.schema["alert_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest

        shingles, (mul, add) = Shingles(shingle), _marks(trees, max(levels))
        for batch in batches:
            k1, k2, n, prefixes, bits = [], [], [], [], []
            for text in batch.column("description").to_pylist():
                s = shingles(text)
                n.append(len(s))
                if len(s):
                    a, b = np.frombuffer(xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist()
                    k1.append(a)
                    k2.append(b)
                    p, b = _prefixes(s, trees, levels, mul, add)
                    prefixes.append(p)
                    bits.append(b)
                else:
                    bits.append(None)
                    k1.append(None)
                    k2.append(None)
                    prefixes.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("alert_id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()),
                 pa.array(prefixes, pa.list_(pa.list_(pa.int64()))), pa.array(bits, pa.list_(pa.int64()))], ["alert_id", "k1", "k2", "n", "prefixes", "bits"])

    return base.mapInArrow(signed, f"alert_id {kind}, k1 long, k2 long, n int, prefixes array<array<bigint>>, bits array<bigint>")


def _sets(alerts: DataFrame, wanted: DataFrame, shingle: int, alert_id: str, description: str) -> DataFrame:
    """``node, shingles`` of the wanted nodes, computed again from their texts."""
    import pyarrow as pa

    base = alerts.select(F.col(alert_id).alias("node"), text_of(description).alias("description"))
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    texts = base.join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    kind = base.schema["node"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sets = [shingles(t).view("int64") for t in part.column("description").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(made, f"node {kind}, shingles array<bigint>")


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have at least the given Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(
        both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _inside(members: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """``node, links``: for each member of a class, the alerts of other members that are similar to it.

    A class is dealt into blocks of about ``block`` members by a hash; every pair of blocks is one group, whose pairs
    are counted by a matrix product over the shingles that at least two members share, never listed.
    """
    import pandas as pd

    sized = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("q"))
    dealt = members.join(sized, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("q")).cast("int"))
    blocks = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select(
        "root", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "copies").join(sets, "node")
    kind = members.schema["node"].dataType.simpleString()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.drop_duplicates("node")
        lists = [np.asarray(x, dtype=np.int64) for x in group["shingles"]]
        size = np.array([len(x) for x in lists], dtype=np.float64)
        owner = np.repeat(np.arange(len(lists)), size.astype(np.int64))
        _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(lists), len(lists)), dtype=np.float32)
        width = 4096
        cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            m = np.zeros((len(lists), width), dtype=np.float32)
            m[owner[a:b], column[a:b] - n * width] = 1
            common += m @ m.T
        near = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
        np.fill_diagonal(near, False)
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        if lo != hi:  # pairs inside one block are counted in its own group
            mine = group["i"].to_numpy()
            near &= mine[:, None] != mine[None, :]
        return pd.DataFrame({"node": group["node"], "links": (near @ group["copies"].to_numpy(np.float64)).astype(np.int64)})

    return blocks.groupBy("root", "lo", "hi").applyInPandas(count, f"node {kind}, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_copies(
    alerts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH,
    recall: float = RECALL, block: int = BLOCK, alert_id: str = "alert_id", description: str = "description", count_links: bool = True,
) -> DataFrame:
    """Class of near copies of every alert, and the number of other alerts that are similar to it.

    Returns one row per row of ``alerts``: ``alert_id, class_id, copy_id`` and, if asked for, ``n_links``.  ``copy_id`` is the smallest id with
    the same set of word n-grams, ``class_id`` the smallest id that similar pairs connect it with, ``n_links`` the number of other
    rows of the class with at least ``similarity``.

    Each text stands in ``trees`` tries by its minima.  Beginning with prefixes of ``depth`` minima, the texts of a prefix are compared with the most
    central of them; prefixes are shortened by one minimum at a time until a pair of ``similarity`` meets with probability ``recall``, and
    at each length only prefixes that hold several classes are looked at.  What then still meets in different classes is compared with each other: a
    few texts around a pivot directly, crowds by the rare shingles in which they differ from it, which finds every link.

    NULL, empty and wordless texts are alone; a text of fewer words than ``shingle`` is one shingle; repeated rows are
    copies of each other; a NULL id joins the class of its text without naming it; ids that name several texts
    connect them; an empty table gives an empty table; other columns are ignored.
    """
    # From the longest prefixes down to the length that meets the recall.
    levels = list(range(depth, prefix_length(trees, depth, similarity, recall) - 1, -1))
    signed = stage(signatures(alerts, levels, trees, shingle, alert_id, description), "signed")
    classes = stage(signed.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("alert_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    # One row per set and tree; only those that share the shortest prefix with another set matter.
    own = signed.filter("k1 IS NOT NULL").join(classes.select("k1", "k2", "node"), ["k1", "k2"]).filter("alert_id = node")
    names = [f"p{k}" for k in levels]
    each = F.arrays_zip(*[F.get("prefixes", F.lit(i)).alias(n) for i, n in enumerate(names)])
    spread = own.select("node", "n", F.posexplode(each).alias("tree", "p")).select("node", "n", "tree", "p.*")
    shared = spread.groupBy("tree", names[-1]).agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).filter(
        "head < last").drop("head", "last")
    met = stage(spread.join(shared, ["tree", names[-1]]).distinct(), "met")
    sets = stage(_sets(alerts, met.select("node").distinct(), shingle, alert_id, description), "sets")
    # The text that stands in the fullest prefixes lies in the middle of its crowd: the pivot of the prefixes it is in.
    met = stage(met.join(met.groupBy("node").agg(F.sum("size").alias("crowd")), "node"), "met")
    sketched = own.select("node", "bits").dropDuplicates(["node"])
    words, most_bits = -(-trees * depth // 64), most_different_bits(trees * depth, similarity)

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b, na, nb`` without those whose bits are far apart."""
        apart = F.lit(0)
        for i in range(words):
            apart = apart + F.bit_count(F.get("ba", F.lit(i)).bitwiseXOR(F.get("bb", F.lit(i))))
        both = pairs.join(sketched.toDF("a", "ba"), "a").join(sketched.toDF("b", "bb"), "b")
        return both.filter(apart <= most_bits).select("a", "b")

    alike = (F.col("na") >= similarity * F.col("nb")) & (F.col("nb") >= similarity * F.col("na"))
    links = roots = None
    for name in names:
        at = _rooted(met, roots) if roots is not None else met.withColumn("root", F.col("node"))
        middle = F.max(F.struct("crowd", "node", "n", "root")).alias("m")
        mixed = at.groupBy("tree", name).agg(middle, F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select(
            "tree", name, F.col("m.node").alias("a"), F.col("m.n").alias("na"), F.col("m.root").alias("ra"))
        pairs = at.join(mixed, ["tree", name]).filter("root != ra").select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")).filter(alike).distinct()
        found = _links(close(pairs), sets, similarity)
        links = stage(found if links is None else links.unionByName(found), "links")
        roots = stage(components(links), "roots")
    # What meets at the shortest prefixes and is still apart: everything around a pivot that is in several classes.
    at = _rooted(met, roots)
    pivots = at.groupBy("tree", names[-1]).agg(F.max(F.struct("crowd", "node")).alias("m")).select("tree", names[-1], F.col("m.node").alias("pivot"))
    around = stage(at.join(pivots, ["tree", names[-1]]).select("pivot", "node", "n", "root").distinct(), "around")
    several = around.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
    apart = stage(around.join(several.select("pivot", "size"), "pivot"), "apart")
    if not apart.isEmpty():
        small = apart.filter(F.col("size") <= FEW + 1).select("pivot", "node", "n", "root")
        direct = small.toDF("pivot", "a", "na", "ra").join(small.toDF("pivot", "b", "nb", "rb"), "pivot").filter(alike & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")))
        crowds = apart.filter(F.col("size") > FEW + 1).filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "root")
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        seen = crowds.join(left, "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        # An id may stand for several texts: a member is an id with its set.
        member = lambda k: F.struct(F.col(k).alias("id"), F.xxhash64(f"s{k}").alias("of"))
        members = stage(seen.select(member("a").alias("pivot"), member("b").alias("node"), "root", F.size("sa").alias("np"), F.size("sb").alias("n"),
                                    F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("diff")), "members")
        share = Fraction(similarity).limit_denominator(10_000)
        to_pivot = members.filter((F.col("np") >= similarity * F.col("n")) & (F.col("n") >= similarity * F.col("np")) &
                                  (F.size("diff") * (1 + similarity) <= (1 - similarity) * (F.col("np") + F.col("n")) + 1e-6))
        pairs = direct.select("a", "b").unionByName(to_pivot.select(F.col("pivot.id").alias("a"), F.col("node.id").alias("b"))).unionByName(
            differing_members(members, (share.numerator, share.denominator)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))
        pairs = stage(pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        links = stage(links.unionByName(_links(pairs, sets, similarity)), "links")
        roots = stage(components(links), "roots")

    named = classes.join(roots, "node", "left").select("k1", "k2", F.col("node").alias("copy_id"), F.coalesce("root", "node").alias("class_id"), "copies")
    if count_links:
        members = roots.join(classes.groupBy("node").agg(F.sum("copies").alias("copies")), "node")
        linked = _inside(members, sets, similarity, block)
        named = named.join(linked.withColumnRenamed("node", "copy_id"), "copy_id", "left").withColumn(
            "n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    else:
        named = named.withColumn("n_links", F.lit(None).cast("long"))
    out = signed.select("alert_id", "k1", "k2").join(named.drop("links", "copies"), ["k1", "k2"], "left").select(
        "alert_id", F.coalesce("class_id", "alert_id").alias("class_id"), F.coalesce("copy_id", "alert_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out if count_links else out.drop("n_links")


def keep_one(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description", **options) -> DataFrame:
    """One alert of each class of near copies, all columns as they are: the one whose id names the class.

    Of rows that repeat an id one stays per text; rows with a NULL id stay unless a class of others has their text.
    """
    classes = near_copies(alerts, alert_id=alert_id, description=description, count_links=False, **options)
    other = stage(classes.filter("alert_id != class_id OR (alert_id IS NULL AND class_id IS NOT NULL)").select(F.col("alert_id").alias("_gone")).distinct(), "gone")
    if other.isEmpty():
        kept = alerts
    else:
        few = other.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        named = alerts.join(F.broadcast(other) if few else other, F.col(alert_id) == F.col("_gone"), "left_anti")
        kept = named
    repeated = stage(alerts.groupBy(F.col(alert_id).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id"), "repeated")
    if repeated.isEmpty():
        return kept
    # Ids name single rows as a rule: only those that repeat are reduced.
    again = kept.join(repeated, F.col(alert_id).eqNullSafe(F.col("_id")), "left_semi")
    once = kept.join(repeated, F.col(alert_id).eqNullSafe(F.col("_id")), "left_anti")
    return once.unionByName(again.dropDuplicates([alert_id, description]))
