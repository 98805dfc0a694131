"""Fingerprints, packing, pages, licences, personal data, quality and toxicity."""

import hashlib
import random

import numpy as np
import pytest

from terravane.llm import fingerprints as fp
from terravane.llm import licences, packing, page_layouts, pages, pii, quality, toxicity

FILE = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path(FILE)


ODD = [(1, "Rain's over. The dam's 3 gates, won't OPEN!! ÉCOLE straße"), (2, None), (3, ""), (4, "word " * 9000), (4, "word " * 9000), (5, "<|endoftext|> a.b,c... ΣΑΣ İi é  x"), (None, "x")]


def test_words_end_where_the_tokenizer_ends_them(vocabulary):
    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_file(vocabulary), packing.WordIds(vocabulary)
    odd = [chr(c) for c in (*range(0x21), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = [f"Dam{c}gate" for c in odd] + [f"rain {c} over{c}\x1d{c} hill {c}" for c in odd] + ["".join(odd)]
    for text, got in zip(texts, ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_are_those_of_the_tokenizer(alerts, vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    out = packing.token_pieces(alerts(ODD, more="piece"), vocabulary, capacity=64).collect()
    got = sorted((str(r.alert_id), r.piece, r.start, r.length, bytes(r.ids).hex()) for r in out)
    want = []
    for i, t in ODD:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(i), k, s, len(ids[s : s + 64]), np.array(ids[s : s + 64], "<u4").tobytes().hex()) for k, s in enumerate(range(0, len(ids), 64))]
    assert got == sorted(want)


@pytest.mark.parametrize("per_task", [20_000, 8])
def test_packing_places_every_piece_once(spark, per_task):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 7, 30, 55, 64])) for i in range(600)] + [(5, 30)] * 40
    table = spark.createDataFrame(rows, "alert_id long, length long").repartition(7)
    out = packing.pack(table, capacity=64, slack=0, bins_per_task=per_task).collect()
    assert sorted((r.alert_id, r.length) for r in out) == sorted(rows)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert sum(n for _, n in v) <= 64 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0
    if per_task > 100:
        assert len(by) <= 1.05 * sum(n for _, n in rows) / 64 + 2
    assert packing.pack(table.limit(0)).count() == 0


def test_fingerprints_against_plain_texts(alerts):
    rows = [(i, "".join(random.Random(i).choices("abc dé", k=50 + i))) for i in range(60)] + [(61, None), (62, ""), (63, "x"), (-5, "a" * 3000), (7, "again"), (None, "last")]
    for per_range in (4, 1000):
        out = fp.fingerprint_alerts(alerts(rows, more="part"), rows_per_range=per_range).collect()
        # Rows of id 7 follow each other in the order of a hash of their texts: leave them out here.
        ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
        got = {(r.alert_id, r.n_chars): r for r in out}
        for (i, t), (j, n) in zip(ordered, ordered[1:] + ordered[:1]):
            t, n = t or "", n or ""
            if 7 in (i, j):
                continue
            r = got[i, len(t)]
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.fingerprint == fp.Fingerprints()(t) and r.edited_fingerprint == fp.Fingerprints()(edited)
        assert len(out) == len(rows)
    one = fp.fingerprint_alerts(alerts([(1, "abcd")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.fingerprint_alerts(alerts([])).count() == 0


def test_prefix_arrays_answer_spans():
    text = "abracadabra" * 20
    codes = np.array([ord(c) for c in text], dtype=np.uint64)
    p = fp.Prefixes(codes, fp.Powers(fp.BASES[0], fp.PRIMES[0]))
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 40)
        i, j = rng.randrange(len(text) - n), rng.randrange(len(text) - n)
        assert (p.span(i, i + n) == p.span(j, j + n)) == (text[i : i + n] == text[j : j + n])
    make = fp.Fingerprints()
    assert fp.likeness(make(text), make(text)) == 1 and fp.likeness(make(""), make("")) == 1 and fp.likeness(make(""), make("a")) == 0
    a = "".join(rng.choices("abcdefgh ", k=2000))
    b = a[:1000] + "".join(rng.choices("ijklmnop ", k=1000))
    assert 0.35 < fp.likeness(make(a), make(b)) < 0.6 and fp.likeness(make(a), make("".join(rng.choices("ijklmnop ", k=2000)))) < 0.05


def test_main_text_of_unseen_pages():
    field = pages.train_field(page_layouts.labelled_pages([], copies=6))
    wrong = total = 0
    for page in page_layouts.labelled_pages(["Water rose over the bridge at noon and fell in the night again."], copies=3, seed=5):
        found = pages.blocks(page)
        truth = [page_layouts.MAIN in t for _, t, _ in found]
        plain = [(p, t.replace(page_layouts.MAIN, "").strip(), n) for p, t, n in found]
        guess = field.decode(plain)
        total += len(truth)
        wrong += sum(a != b for a, b in zip(truth, guess))
    assert wrong <= 0.02 * total


def test_pages_edge_cases(spark):
    html = '<body><nav><a href="/">menu</a></nav><article><h1>T&amp;C</h1><p>Water  rose\n over &#233;<br>all<p>Second <b>bold</b> one.<script>var t="</p>";</script></article><footer>f</footer>'
    rows = [(1, "a", html), (2, "b", None), (3, "c", ""), (4, "d", "<p>cut <a href='x"), (5, "e", "no tags at all in this text, it is just words."), (1, "a", html)]
    out = {(r.page_id, r.link): r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, link string, html string")).collect()}
    assert out[1, "a"] == "T&C\nWater rose over é all\nSecond bold one." and out[2, "b"] == "" and out[3, "c"] == ""
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, link string, html string")).count() == 0


def test_licences(alerts):
    rows = [(1, "Rain fell.\nLicensed under the Apache License, Version 2.0.\nMore rain."), (2, None), (3, ""), (4, "The driver has a licence and the right to stop."), (5, "All rights reserved.\nReleased under the MIT License."),
            (6, "This work is licensed under the GNU General Public License, version 3."), (7, "rain and wind " * 3000)]
    out = {r.alert_id: [n.family for n in r.notices] for r in licences.scan_licences(alerts(rows)).collect()}
    assert out == {1: ["apache"], 2: [], 3: [], 4: [], 5: ["proprietary", "mit"], 6: ["gpl"], 7: []}
    assert licences.scan_licences(alerts([])).count() == 0


def test_licences_without_stems_wrapped_and_held_out(alerts):
    wrapped = "This program is free software: you can\nredistribute it and/or modify it\nunder the terms of the GNU General\nPublic License as published by the\nFree Software Foundation, either\nversion 3 of the License, or (at\nyour option) any later version."
    short = {"Alle Rechte vorbehalten.": "proprietary", "Tous droits réservés.": "proprietary", "Todos los derechos reservados.": "proprietary", "GPL-3.0-or-later": "gpl", "GNU GPL v3": "gpl", "CC BY-SA 4.0": "cc-by-sa", "CC0 1.0 Universal": "cc0"}
    held_out = {"Code is made available under GPL v3.": "gpl", "Der Text ist unter CC BY-SA 4.0 verfügbar.": "cc-by-sa", "Ce logiciel est proposé sous licence MIT.": "mit", "Este texto se publica bajo licencia CC BY 4.0.": "cc-by", "Ohne Gewähr, alle Rechte vorbehalten!": "proprietary"}
    assert not set(held_out) & {t for ts in licences.wordings().values() for t in ts}
    clean = ["MIT", "Mit der Zeit stieg das Wasser.", "this " * 60, "Les droits des habitants sont connus.", "The village has a permit."]
    texts = [f"Water rose at noon.\n\n{wrapped}\n\nThe dam is open.", "the water rose over every bridge of the town " * 40 + "All rights reserved. " + "the rain fell on the hills " * 40, *short, *held_out, *clean]
    found = [r.notices for r in licences.scan_licences(alerts(list(enumerate(texts)))).orderBy("alert_id").collect()]
    assert [n.family for n in found[0]] == ["gpl"] and texts[0][found[0][0].start : found[0][0].stop] == wrapped
    assert [n.family for n in found[1]] == ["proprietary"]
    assert [[n.family for n in f] for f in found[2:]] == [[f] for f in [*short.values(), *held_out.values()]] + [[]] * len(clean)


def test_private_spans(alerts):
    text = "Call +1 (017) 555-7713 or mail a.b@mail7.example.com.\n" + "Rain over the hills. " * 40 + "Again: (017) 555-7713, host 97.51.17.173, not 300.1.1.1, card 4539 1488 0343 6467 é"
    rows = [(1, text), (2, None), (3, ""), (4, "no data here"), (5, "@ @@ +1 1.2.3 a@b 1" * 50)] + [(10 + i, f"Call +1 (21{i % 10}) 555-0{100 + i} now, or mail m{i}@x.example.com, id {i * 7919}") for i in range(60)]
    out = {r.alert_id: r for r in pii.private_spans(alerts(rows)).collect()}
    spans = [(s.kind, text[s.start : s.stop], s.base) for s in out[1].spans]
    assert [s for s in spans if s[2]] == [("phone", "+1 (017) 555-7713", True), ("email", "a.b@mail7.example.com", True), ("ip", "97.51.17.173", True), ("card", "4539 1488 0343 6467", True)]
    assert ("phone", "(017) 555-7713", False) in spans and not any("300.1" in s[1] for s in spans)
    assert out[2].spans == [] and out[3].spans == [] and out[4].spans == []
    assert pii.private_spans(alerts([])).count() == 0


def test_one_kept_number_reaches_all_its_repeats(alerts):
    text = "Call +1 (017) 555-7713 now.\n" + "Rain over the hills, (017) 555-7713 again. " * 50
    late = "Rain over the hills, (017) 555-7713 again. " * 50 + "Call +1 (017) 555-7713 now."
    for t in (text, late):
        nodes = pii.mentions(t)
        kept = next(i for i, m in enumerate(nodes) if m.label)
        skips = {(i, j) for i, j, kind in pii.neighbours(nodes) if kind == 1}
        assert len(nodes) == 51 and all((min(i, kept), max(i, kept)) in skips for i in range(51) if i != kept) and len(skips) < 2 * 51
    # Each repeat pulls to 'none' by itself.
    unary, table = np.zeros((pii.FEATURES, 5)), np.stack([np.zeros((5, 5)), 3.0 * np.eye(5)])
    unary[0, 0] = 0.5
    for t in (text, late):
        assert [s[2] for s in pii.find_spans(t, unary, table)] == ["phone"] * 51
    rows = [(1, text), (2, late)] + [(10 + i, f"Call +1 (21{i % 10}) 555-0{100 + i} now, or mail m{i}@x.example.com, id {i * 7919}") for i in range(60)]
    out = {r.alert_id: r.spans for r in pii.private_spans(alerts(rows)).collect()}
    assert [s.kind for s in out[1]] == ["phone"] * 51 and [s.kind for s in out[2]] == ["phone"] * 51


def test_messages_run_along_a_long_chain_until_they_settle():
    n = 60
    unary = np.zeros((n, 2))
    unary[0, 1] = 20.0
    table = np.array([[[5.0, 0.0], [0.0, 5.0]]])
    p = pii.marginals(unary, [(i, i + 1, 0) for i in range(n - 1)], table)
    m = np.exp(table[0])
    v = np.exp(unary[0])
    for _ in range(n - 1):
        v = m @ (v / v.sum())
    assert np.allclose(p[-1], v / v.sum(), atol=1e-4)


def test_masking(spark):
    from pyspark.sql import functions as F

    rows = [("é a@b.cc x +1 222 333 4444!", [("email", 2, 8), ("phone", 11, 26)]), ("ab", []), ("0123456789", [("card", 2, 6), ("phone", 4, 8)])]
    t = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:bigint,stop:bigint>>")
    assert [r.m for r in t.select(pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()] == ["é <email> x <phone>!", "ab", "01<card>89"]


def test_messages_agree_with_enumeration_on_a_chain():
    rng = np.random.default_rng(0)
    unary, table = rng.normal(size=(4, 5)), rng.normal(size=(2, 5, 5))
    table = (table + table.transpose(0, 2, 1)) / 2
    edges = [(0, 1, 0), (1, 2, 0), (2, 3, 1)]
    total = np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        s = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(table[k, y[i], y[j]] for i, j, k in edges))
        for i in range(4):
            total[i, y[i]] += s
    assert np.allclose(pii.marginals(unary, edges, table, rounds=30), total / total.sum(1, keepdims=True), atol=1e-4)


def held_out_auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    y = np.array(labels)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


VOCABULARY = "the water rose over bridge road hill and rain fell in night at dam gate river bank town people moved camp before noon again".split()


def test_quality_held_out(spark, alerts):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(VOCABULARY, k=60)) if i % 3 else " | ".join(rng.choices(VOCABULARY, k=60)).upper()) for i in range(600)] + [(9001, None), (9002, "")]
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(0, 300)] + [(5, None), (None, 1)], "alert_id long, quality int")
    out = {r.alert_id: r.score for r in quality.score_quality(alerts(rows), labels).collect()}
    assert held_out_auc([out[i] for i in range(300, 600)], [int(bool(i % 3)) for i in range(300, 600)]) > 0.99
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == 602
    assert {r.score for r in quality.score_quality(alerts(rows), labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(alerts([]), labels).count() == 0


def test_interactions_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    v, x = rng.normal(size=(6, 3)), rng.normal(size=6)
    want = sum(v[i] @ v[j] * x[i] * x[j] for i in range(6) for j in range(i + 1, 6))
    assert np.allclose(quality.interactions(v, x, np.array([0]))[0], want)


def test_kept_mentions_are_observed_however_many_repeats_follow(alerts):
    rows = [(i, f"Call +1 (21{i % 10}) 555-0{100 + i} now, or mail m{i}@x.example.com, id {i * 7919}") for i in range(60)]
    unary, table = pii.train(alerts(rows))
    for kept, again, kind in (("+1 (017) 555-7713", "(017) 555-7713", "phone"), ("a.b@mail7.example.com", "a.b (at) mail7", "email")):
        for n in (1, 100, 1000, 10_000):
            repeats = f"Rain over the hills, {again} again. " * n
            for text in (f"Call {kept} now.\n{repeats}", f"{repeats}Call {kept} now."):
                found = pii.find_spans(text, unary, table)
                assert len(found) == n + 1 and {s[2] for s in found} == {kind} and sum(s[3] for s in found) == 1, (kind, n)


def test_toxicity_restores_and_scores(spark, alerts):
    rng = random.Random(4)
    insult = lambda: rng.choice(["stupid", "idiot", "worthless", "moron"])
    plain = lambda k: rng.choices(VOCABULARY, k=k)
    rows = []
    for i in range(900):
        w = plain(40)
        if i % 4 == 0:
            w[rng.randrange(40)] = insult()
            w[rng.randrange(40)] = insult()
        rows.append((i, " ".join(w)))
    disguised = ["you stup1d one", "an 1d10t here", "w o r t h l e s s talk", "m.o.r.o.n at the dam", "stuuuupid talk", "$tupid talk", "id!ot of the town"]
    clean = ["gate 4 of the dam", "the 2 roads", "a b c d", "road closed at 10.30", "rain !!! fell", None, ""]
    rows += [(2000 + i, t) for i, t in enumerate(disguised)] + [(3000 + i, t) for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "alert_id long, toxic int")
    out = {r.alert_id: r for r in toxicity.score_toxicity(alerts(rows), labels).collect()}
    assert held_out_auc([out[i].score for i in range(600, 900)], [int(i % 4 == 0) for i in range(600, 900)]) > 0.98
    assert [out[2000 + i].predicted for i in range(len(disguised))] == [1] * len(disguised)
    assert [out[3000 + i].predicted for i in range(len(clean))] == [0] * len(clean)
    assert "stup1d>stupid" in out[2000].restored
    kept = toxicity.keep_clean(alerts(rows), labels)
    assert {r.alert_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}
    assert len({r.score for r in toxicity.score_toxicity(alerts(rows), labels.limit(0)).collect()}) == 1
    assert toxicity.score_toxicity(alerts([]), labels).count() == 0


def test_toxicity_of_doubled_edge_and_split_forms(spark, alerts):
    rng = random.Random(6)
    insults = ["stupid", "idiot", "worthless", "moron", "ass", "loser"]
    rows = [(i, " ".join([*rng.choices(VOCABULARY + ["happen", "looser", "gate"], k=38), *(rng.choices(insults, k=2) if i % 4 == 0 else ())])) for i in range(900)]
    disguised = ["iidiot", "mmoron", "stuupid", "a$$", "moro#", '"$tupid', "st.upid", "id_iot", "stu pid", "wor thl ess", "(stup!d!)", "wwoorrtthhlleessss", "ssttuuppiidd", "wo rt hl es s"]
    clean = ["looser gate", "happen", "rain!", "was it?", "the well-fed road", "moved (again)", "a st and a rope"]
    rows += [(2000 + i, f"the water and {t} rose") for i, t in enumerate(disguised)] + [(3000 + i, f"the water and {t} rose") for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "alert_id long, toxic int")
    out = {r.alert_id: r for r in toxicity.score_toxicity(alerts(rows), labels).collect()}
    assert [t for i, t in enumerate(disguised) if not out[2000 + i].predicted] == []
    assert [t for i, t in enumerate(clean) if out[3000 + i].predicted] == []
    assert "iidiot>idiot" in out[2000].restored and "stu pid>stupid" in out[2008].restored


def test_toxicity_grams_do_not_depend_on_the_layout(spark, alerts):
    rows = [(i, t) for i, t in enumerate(["abc", "", None, "a", "bc de", "abc"] * 40)]
    table = alerts(rows)
    one, many = ({r.gram: r.n for r in toxicity.char_grams(table.repartition(k)).collect()} for k in (1, 7))
    want = {}
    for _, text in rows:
        codes = [ord(c) - 96 if c != " " else 0 for c in f"   {text or ''}   "]
        for k in range(len(codes) - 3):
            gram = ((codes[k] * 28 + codes[k + 1]) * 28 + codes[k + 2]) * 28 + codes[k + 3]
            want[gram] = want.get(gram, 0) + 1
    # Neighbours in a batch share their three blanks, which only grams of four blanks can tell.
    assert {g: n for g, n in one.items() if g} == {g: n for g, n in many.items() if g} == {g: n for g, n in want.items() if g}
    assert one.get(0) == many.get(0)


def test_toxicity_walks_find_what_decoding_every_token_finds():
    import itertools

    import numpy as np

    model = np.full(28**4, -3.0, dtype=np.float32)
    chosen = {f: i for i, f in enumerate(["abba$", "abb", "bab$", "cab", "ab$"])}
    reader = toxicity.Reader(model, chosen)
    for n in range(1, 6):
        for signs in itertools.product("ab4*c", repeat=n):
            form = "".join(signs)
            hit = set(toxicity.spelled(reader.channel.read(form))) & set(chosen)
            assert not hit or reader._reachable(form), form
    assert list(reader._single("abbbba")) == ["abba"] and list(reader._single("abba")) == []


def test_toxicity_repeated_ids_and_very_long_texts(spark, alerts):
    rng = random.Random(9)
    words = lambda i, k: [*rng.choices(VOCABULARY, k=k), *(["moron", "idiot"] if i % 4 == 0 else [])]
    rows = [(i, " ".join(words(i, 30))) for i in range(400)]
    again = alerts(rows + [(4, rows[4][1])] * 500 + [(9000, " ".join(words(0, 60_000))), (9001, "x" * 200_000), (9002, "1" * 100_000)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "alert_id long, toxic int")
    out = toxicity.score_toxicity(again, labels).collect()
    assert len(out) == 400 + 500 + 3
    plain = {r.alert_id: r.predicted for r in out}
    assert [plain[9000], plain[9001], plain[9002]] == [1, 0, 0]
    assert all(plain[i] == int(i % 4 == 0) for i in range(300, 400))
