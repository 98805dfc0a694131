"""Names from a table found in texts: 100,000 names, several automata, order of the table."""

import random

from terravane.operators import feeds as W
from terravane.operators.places import first_named


def test_names_equal_brute_force_in_one_or_several_automata(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
    names = [(i * 7 % 100_003, word()) for i in range(100_000)] + [(5, ""), (6, None), (200_000, "zeta")]
    texts = [(i, " ".join(word().upper() for _ in range(6))) for i in range(200)] + [(900, None), (901, ""), (902, "xx ZETAx"), (903, "xyz")]
    low = [(r, n.lower()) for r, n in names if n]
    want = {i: min((r for r, n in low if n in (t or "").lower()), default=None) for i, t in texts}
    t, n = spark.createDataFrame(texts, "i int, place string"), spark.createDataFrame(names, "rank int, key string")
    for most in (200_000, 30_000):
        got = {r.i: r.name_rank for r in first_named(t, n, most=most).collect()}
        assert got == want
    assert first_named(t, n.limit(0)).filter("name_rank IS NOT NULL").count() == 0


def test_places_resolve_by_a_table_of_rivers_as_by_the_list(spark):
    rows = [(i, k, la, lo, d, *box) for i, (k, la, lo, d, box) in enumerate(W.RIVERS)]
    table = spark.createDataFrame(rows, "rank int, key string, lat double, lon double, display_name string, west double, south double, east double, north double")
    queries = spark.createDataFrame([(" Periyar bank ",), ("the NILA and pamba",), ("Town",), (None,)], "place string")
    candidates = spark.createDataFrame([("Town", 1, "Town, Kerala", "10.0", "76.2")], "place string, rank int, display_name string, lat string, lon string")
    a, b = (sorted(map(str, W.resolve_place(queries, candidates, rivers=x).collect())) for x in (tuple(W.RIVERS), table))
    assert a == b and len(a) == 4
