"""Near copies in crowds: equal to brute force, candidates in proportion to the texts, recall measured."""

import random

import pytest

from terravane.llm import near_copies as N


def shingles(text, size=5):
    w = text.split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def edited(rng, w, k):
    w = list(w)
    for i in rng.sample(range(len(w)), k):
        w[i] = f"x{rng.randrange(10**6)}"
    return w


def plain(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= similarity * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0]: (rows[find(i)][0], links[i]) for i in range(len(rows))}


@pytest.mark.parametrize("edits", [(2,), (4,), (0, 1, 2, 3, 5, 8)])
def test_a_crowd_equals_brute_force_with_few_candidates(spark, monkeypatch, edits):
    rng = random.Random(len(edits))
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice(edits)))) for i in range(400)]
    counted, kept = {}, N.stage
    monkeypatch.setattr(N, "stage", lambda df, name: counted.__setitem__(name, kept(df, name)) or counted[name])
    out = N.near_copies(spark.createDataFrame(rows, "alert_id long, description string").repartition(5)).collect()
    assert {r.alert_id: (r.class_id, r.n_links) for r in out} == plain(rows)
    if "pairs" in counted:
        assert counted["pairs"].count() <= 20 * len(rows)  # 79,800 pairs lie in the crowd


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = random.Random(2)
    rows, linked = [], 0
    for i in range(200):
        base = [f"p{i}q{k}" for k in range(110)]
        other = edited(rng, base, 2)
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) < 0.86:
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
            linked += 1
    out = N.near_copies(spark.createDataFrame(rows, "alert_id long, description string"), count_links=False).collect()
    assert linked >= 80 and sum(r.class_id != r.alert_id for r in out) >= 0.9 * linked
