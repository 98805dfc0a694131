"""Words, contamination, sharding, near copies against brute force, and their edge cases."""

import re
from itertools import combinations

import pytest

from terravane.llm.components import components
from terravane.llm.contamination import keep_uncontaminated, probe_hits
from terravane.llm.near_copies import keep_one, near_copies, prefix_length
from terravane.llm.sharding import shard_alerts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, probes, window=13):
    w, hit, ids = words(text), set(), set()
    for pid, probe in probes:
        p = words(probe)
        for s in range(max(1, len(p) - window + 1)) if p else ():
            g = p[s : s + window]
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    ids.add(str(pid))
    return len(w), len(hit), sorted(ids)


LONG = " ".join(f"w{i}" for i in range(40))
TEXTS = [
    (1, LONG), (2, "ÀÉ Straße Σας RED alert " + LONG[: LONG.index("w20")] + "end"), (3, None), (4, ""), (5, "... !!"), (6, "red alert"), (6, "red alert"),
    (7, "the the the the the the the the the the the the the the the"), (None, "red alert now"), (8, "a Σας red-ALERT b " * 300), (9, "ÀÉ straße"), (10, "àé straße"),
]
PROBES = [(1, LONG[: LONG.index("w30")]), (2, "Red, Alert"), (3, "the " * 14), (4, None), (5, "!!"), (10, "red alert"), (11, "ÀÉ Straße"), (12, "absent words here")]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_probe_hits_equal_brute_force(spark, alerts, limit):
    probes = spark.createDataFrame(PROBES, "probe_id long, description string")
    out = probe_hits(alerts(TEXTS), probes, broadcast_windows=limit).collect()
    got = sorted(((r.alert_id, r.description, r.n_words, r.n_hit, list(r.probe_ids)) for r in out), key=str)
    want = sorted(((i, t, *brute_hits(t, PROBES)) for i, t in TEXTS), key=str)
    assert got == want


def test_contamination_of_empty_tables(spark, alerts):
    none = spark.createDataFrame([], "probe_id long, description string")
    assert [r.n_hit for r in probe_hits(alerts([(1, "a b")]), none).collect()] == [0]
    assert probe_hits(alerts([]), none).count() == 0
    probes = spark.createDataFrame(PROBES, "probe_id long, description string")
    kept = keep_uncontaminated(alerts(TEXTS), probes)
    assert kept.columns == ["alert_id", "description", "word"]
    assert sorted(r.description or "" for r in kept.collect()) == sorted((t or "") for _, t in TEXTS if not (lambda n, h, _: h and 20 * h >= n)(*brute_hits(t, PROBES)))


def test_shards_are_stable_gapless_and_weighted(spark, alerts):
    rows = [(i, f"text {i}") for i in range(4000)] + [(7, "text 7"), (None, None), (None, "")]
    out = shard_alerts(alerts(rows), weights=[1.0] * 7 + [3.0], slices=4).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert 0.24 < len(by[7]) / len(rows) < 0.36  # weight 3 of 10
    moved = sum(r.grown_shard == 8 for r in out) / len(rows)
    assert 0.06 < moved < 0.12  # one of eleven parts
    assert len({(r.alert_id, r.shard) for r in out}) == len({r.alert_id for r in out})
    assert {(r.size, r.text_crc32) for r in out if r.alert_id is None} == {(16, 0)}
    again = shard_alerts(alerts(rows).repartition(5), weights=[1.0] * 7 + [3.0], slices=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert shard_alerts(alerts([])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 9), (3, 10), (10, 11), (7, 7)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in (1, 2, 3, 10, 11)} == {1} and {got[k] for k in (4, 5, 9)} == {4}
    assert {got[100 + i] for i in range(31)} == {100} and {got[200 + i] for i in range(50)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows, similarity=0.8):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return sorted((i, min(ids[find(k)]), links[k]) for k, (i, _) in enumerate(rows))


def varied(base, *changes):
    w = base.split()
    for c in changes:
        w[c] = f"changed{c}"
    return " ".join(w)


def test_near_copies_equal_brute_force(spark, alerts):
    base, other = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(120))
    rows = [(1, base), (2, base.upper()), (3, varied(base, 3)), (4, varied(base, 100)), (5, varied(base, 3, 50, 100, 150)), (6, other), (7, varied(other, 5, 60)), (8, other + " tail"),
            (9, None), (10, ""), (11, "!!"), (12, "one two"), (13, "One  two."), (14, "one two three"), (15, base + " " + other)]
    rows += [(100 + i, varied(base, i)) for i in range(0, 190, 6)]
    out = near_copies(alerts(rows, more="node"), block=8)
    assert sorted((r.alert_id, r.class_id, r.n_links) for r in out.collect()) == brute_classes(rows)
    kept = keep_one(alerts([*rows, (6, other), (None, other), (None, "alone in the hills")]))
    assert kept.columns == ["alert_id", "description", "word"]
    ids = sorted(r.alert_id for r in kept.collect() if r.alert_id is not None)
    assert ids == sorted({c for _, c, _ in brute_classes(rows)})
    assert near_copies(alerts([])).count() == 0
    assert near_copies(alerts([(1, "a b c d e f")])).collect()[0].n_links == 0


def test_prefix_is_shortened_to_the_recall():
    k = prefix_length(32, 10, 0.8, 0.9999)
    assert 1 - (1 - 0.8**k) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (k + 1)) ** 32
