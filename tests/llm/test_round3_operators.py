"""Classes of cells, periodic runs and near repeats against brute force, with their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm import bit_copies as B
from terravane.llm import periodic_runs as R
from terravane.llm import terrain_classes as C
from terravane.sources.feeds import read_alert_rss

CELLS = "site string, r int, c int, features array<double>, class string, vector int"


# ---- classes of cells ---------------------------------------------------------------
def plain_classes(rows, width, classes, rounds, seed=3, scale=1024):
    kept = [(k, [int(np.floor(scale * x)) for x in v]) for k, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) and abs(x) < C.LARGEST / scale for x in v)]
    name = lambda k: hashlib.sha256(":".join([str(seed), *("" if x is None else str(x) for x in k)]).encode()).hexdigest()
    centroids = [v for _, v in sorted(((name(k), v) for k, v in kept))[:classes]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at) if a == i]
            if mine:
                centroids[i] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(k, near(v)[1], near(v)[0]) for k, v in kept], centroids


def test_classes_equal_plain_k_means_with_ties_repeats_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(("a" if i % 3 else "b", i // 7, i % 7), (rng.integers(-3, 4, 5) / 2.0).tolist()) for i in range(160)]
    rows += rows[:4] + [((None, 1, None), [0.5] * 5), (("a", 1, 1), None), (("a", 2, 2), [1.0] * 4), (("a", 3, 3), [1.0, float("nan"), 0.0, 0.0, 0.0]),
                        (("a", 4, 4), [1.0, None, 0.0, 0.0, 0.0]), (("a", 5, 5), [float("inf")] * 5), (("a", 6, 6), [1e9] * 5)]
    df = spark.createDataFrame([(*k, v, "own", 7) for k, v in rows], CELLS)
    want, centroids = plain_classes(rows, 5, 6, 4)
    got = C.terrain_classes(df.repartition(5), width=5, classes=6, rounds=4).collect()
    spelled = lambda items: sorted(map(repr, items))
    assert spelled(((r["site"], r["r"], r["c"]), r["class"], r["distance"]) for r in got) == spelled(want)
    for r in got:
        assert r["centroid"] == centroids[r["class"]] and r["inertia"] == sum(d for *_, d in want)
        assert r["class_inertia"] == sum(d for _, k, d in want if k == r["class"])


def test_few_cells_and_empty_tables_have_classes(spark):
    two = spark.createDataFrame([("a", 0, 0, [1.0, 2.0], "", 0), ("a", 0, 1, [9.0, 2.0], "", 0)], CELLS)
    got = C.terrain_classes(two, width=2).collect()
    assert {r["class"] for r in got} == {0, 1} and all(r["inertia"] == 0 for r in got)
    assert C.terrain_classes(two.limit(0), width=2).collect() == []
    with pytest.raises(ValueError):
        C.terrain_classes(two, width=0)


def test_orchard_measures_fewer_distances_than_all_and_finds_the_same():
    rng = np.random.default_rng(1)
    middles = rng.integers(-50_000, 50_000, (20, 16))
    x = middles[rng.integers(0, 20, 3000)] + rng.integers(-300, 300, (3000, 16))
    found, far, measured = C.orchard(x, middles, np.zeros(3000, dtype=np.int64))
    all_far = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (found == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all() and measured < 3000 * 20
    again = C.orchard(x, middles, found)[2]
    assert again < measured and again <= 3000 * 3


def test_classes_of_a_feature_stack(spark):
    stack = spark.range(60).select(F.lit("meppadi").alias("site"), (F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c"),
                                   (F.col("id") % 10 > 4).cast("int").alias("slope"), F.lit(0.25).alias("twi"))
    got = C.terrain_classes(C.feature_vectors(stack, ["slope", "twi"]), width=2, classes=2, rounds=3)
    assert got.groupBy("class").count().count() <= 2 and got.count() == 60


# ---- periodic runs -------------------------------------------------------------------
def plain_runs(w, least=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, 2 * p) and not any(all(w[i + k] == w[i + k + q] for k in range(size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda t: (t[0], t[2]))


def plain_collapsed(w, runs):
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def bulletin(rng):
    n, kinds = rng.choice([0, 1, 11, 12, 13, 40, 120, 260]), rng.choice([1, 2, 3, 40])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 3:
            a, p, e = rng.randrange(n), rng.randint(1, n // 3), rng.randint(1, n)
            for i in range(a + p, e):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("core", [1, 24, R.CORE])
def test_runs_equal_brute_force_whatever_the_tiles(spark, core):
    rng = random.Random(core)
    texts = [bulletin(rng) for _ in range(120)]
    rows = [(f"l{i}", rng.choice([" ", "\n", "\t\x0b ", "\r\x0c"]).join(w), 1) for i, w in enumerate(texts)]
    rows += [("none", None, 1), ("empty", "", 1), ("blank", " \t\n", 1), (None, "rain " * 30, 1), ("l5", rows[5][1], 1), ("nbsp", "a b " * 14, 1)]
    got = R.periodic_runs(spark.createDataFrame(rows, "link string, description string, tiles int").repartition(4), core=core).collect()
    words = lambda t: [x.decode() for x in (t or "").encode().split()]
    want = []
    for link, text, _ in rows:
        w = words(text)
        runs = plain_runs(w)
        want.append((link, len(w), runs, plain_collapsed(w, runs)))
    assert sorted(map(repr, want)) == sorted(repr((r.link, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed)) for r in got)


def test_runs_of_very_long_texts_and_empty_tables(spark):
    rng = random.Random(4)
    part = [f"w{rng.randrange(5000)}" for _ in range(9000)]
    texts = {"one word": "rain " * 50_000, "long period": " ".join(part * 3), "plain": " ".join(f"v{i}" for i in range(60_000))}
    df = spark.createDataFrame(list(texts.items()), "link string, description string")
    got = {r.link: [(x.start, x.length, x.period) for x in r.runs] for r in R.periodic_runs(df).collect()}
    assert got == {"one word": [(0, 50_000, 1)], "long period": [(0, 27_000, 9000)], "plain": []}
    assert R.periodic_runs(df.limit(0)).collect() == []


def test_op12_equals_brute_force_on_whole_documents(spark, tmp_path):
    from terravane.llm.queries import QUERIES

    rng = random.Random(9)
    rows = [(i, None if i == 3 else " ".join(bulletin(rng)), "en") for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, text, _ in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=(None,) * 3)
        want[i] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{z},{q}\n" for s, z, q in runs)), sha(plain_collapsed(w, runs)))
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == want


# ---- near repeats --------------------------------------------------------------------
def shingles(text, size=3):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain_repeats(rows):
    """Rows linked by their sets, components by their smallest link."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    names = {}
    for i, (link, _) in enumerate(rows):
        if link is not None:
            names[find(i)] = min(names.get(find(i), link), link)
    return [(link, len(s), names.get(find(i), link)) for i, ((link, _), s) in enumerate(zip(rows, sets))]


def edited(rng, w, k):
    w = list(w)
    for i in rng.sample(range(len(w)), k):
        w[i] = f"x{rng.randrange(10**6)}"
    return w


def repeats_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], T.StructType([
        T.StructField("link", T.LongType() if isinstance(rows[0][0], int) else T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("node", T.IntegerType()), T.StructField("pivot", T.IntegerType())]))
    out = B.near_repeats(df.repartition(6), **options).collect()
    for r in out:
        assert r.kept == (r.link == r.class_link)
    return sorted(((r.link, r.n_shingles, r.class_link) for r in out), key=repr)


@pytest.mark.parametrize("edits", [(0, 1, 2, 3), (4, 5, 6, 7, 8), (2, 2, 9, 14)])
def test_a_crowd_of_near_copies_equals_brute_force(spark, edits):
    rng = random.Random(sum(edits))
    base = [f"b{i}" for i in range(130)]
    rows = [(i, " ".join(edited(rng, base, rng.choice(edits)))) for i in range(260)]
    # Copies that share an edit link with each other where the base is far.
    far = edited(rng, base, 16)
    rows += [(300 + i, " ".join(edited(rng, far, rng.choice((0, 1, 3))))) for i in range(40)]
    assert repeats_of(spark, rows) == sorted(plain_repeats(rows), key=repr)


def test_candidates_of_a_crowd_stay_in_proportion(spark, monkeypatch):
    counted = {}
    plain = B.stage
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice((1, 2, 4, 6, 8, 12))))) for i in range(600)]
    monkeypatch.setattr(B, "stage", lambda df, name: counted.__setitem__(name, plain(df, name)) or counted[name])
    repeats_of(spark, rows)
    assert counted["pairs"].count() <= 10 * len(rows)  # 180,000 pairs lie in the crowd


def test_links_at_the_edge_wordless_repeated_and_upper_case_texts(spark):
    w = [f"b{i}" for i in range(102)]  # 100 shingles; n of 100 and n of them: 85 of 100 is a link, 84 of 100 none
    rows = [("a", " ".join(w)), ("b", " ".join(w[:87])), ("c", " ".join(w[:86])), ("d", None), ("e", ""), ("f", " \t"), ("g", "Heavy RAIN"), ("h", "heavy rain"),
            ("i", "heavy"), (None, "HEAVY rain"), ("k", " ".join(w)), ("k", " ".join(w)), ("m", "Ärger"), ("n", "ärger"), (None, "alone here today")]
    got = repeats_of(spark, rows)
    assert got == sorted(plain_repeats(rows), key=repr)
    of = {x[0]: x[2] for x in got}
    assert of["b"] == "a" and of["h"] == "g" and of["m"] == "m"
    assert repeats_of(spark, [("z", None)]) == [("z", 0, "z")]


def test_recall_just_above_the_threshold_is_at_least_nine_tenths(spark):
    rng = random.Random(8)
    rows, pairs = [], 0
    for i in range(150):
        base = [f"p{i}q{k}" for k in range(120)]
        other = edited(rng, base, 3)
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if len(a & b) / len(a | b) >= 0.85:
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
            pairs += 1
    assert pairs >= 100
    found = sum(1 for link, _, c in repeats_of(spark, rows) if c != link)
    assert found >= 0.9 * pairs


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(0)
    mul, add = B._functions(256)
    for share in (0.2, 0.6, 0.9):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 400, dtype=np.uint64)
            k = int(400 * 2 * share / (1 + share))
            y = np.concatenate([x[:k], rng.integers(0, 2**63, 400 - k, dtype=np.uint64)])
            bits = [B.packed_bits(B.minima(np.unique(v), mul, add)).tolist() for v in (x, y)]
            errors.append((bits[0], bits[1], k / (800 - k)))
        df = spark.createDataFrame(errors, "a array<bigint>, b array<bigint>, s double")
        off = df.agg(F.avg(B.estimated_similarity("a", "b") - F.col("s"))).head()[0]
        assert abs(off) < 0.02


def test_operators_run_on_the_alert_feed(spark):
    item = "<item><title>{0}</title><description>{1}</description><pubDate>d</pubDate><link>http://x/{2}</link></item>"
    texts = ["Heavy rain in the hills today and tomorrow " * 4, "heavy rain in the hills today and TOMORROW " * 4, "Dam level rising"]
    body = "<rss><channel>" + "".join(item.format("IDUKKI", t, i) for i, t in enumerate(texts)) + "</channel></rss>"
    feed = read_alert_rss(spark.createDataFrame([(body,)], "body string"))
    runs = {r.link: len(r.runs) for r in R.periodic_runs(feed).collect()}
    assert runs == {"http://x/0": 1, "http://x/1": 1, "http://x/2": 0}
    assert {r.link: r.class_link for r in B.near_repeats(feed).collect()} == {"http://x/0": "http://x/0", "http://x/1": "http://x/0", "http://x/2": "http://x/2"}


def test_queries_of_the_round_have_their_columns(spark):
    from terravane.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    near = QUERIES["op13_bit_minhash"](spark, sf)
    assert near.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.collect()) == sorted(plain_repeats(rows)) and len(rows) == n
    assert "op11_clusters" in ORACLES
