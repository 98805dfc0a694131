"""Registered queries on the smallest tables, and the pipeline, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_texts_and_joins import brute_classes, brute_hits, words
from tools.verify import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_all_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_decontamination_equals_oracle(spark):
    result = compare(entry.queries()["op1_decontamination"](spark, SF), oracle(SF), entry.oracle_sql()["op1_decontamination"])
    assert result.startswith("ok") and "TYPES" not in result, result


def test_sharding_contract(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op2_sharding")}
    slots = {}
    for d in documents:
        raw, r = (d["text"] or "").encode(), rows[d["doc_id"]]
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_jaccard_join_equals_brute_force(spark, documents):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in run(spark, "op5_jaccard_join"))
    assert got == brute_classes([(d["doc_id"], d["text"]) for d in documents])


def test_fingerprints_contract(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op4_fingerprints")}
    order = sorted(documents, key=lambda d: -d["doc_id"])
    seen = {}
    for d, n in zip(order, order[1:] + order[:1]):
        t, half = d["text"] or "", len(d["text"] or "") // 2
        edited = t[: len(t) - half] + (n["text"] or "")[:half]
        r = rows[d["doc_id"]]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(seen.values())) == len(seen)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            kept = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if kept:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_personal_data_contract(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op9_pii")}
    for d in documents:
        base, r = base_spans(d["text"] or ""), rows[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]


def test_packing_contract(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {}
    for d in documents:
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[d["doc_id"], k] = (s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))
    rows = run(spark, "op7_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    total = sum(n for _, n, _ in want.values())
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) + 1


def test_scores_and_licences(spark, documents):
    for name, parts, part in (("op3_quality", 3, 1), ("op10_toxicity", 4, 2)):
        rows = run(spark, name)
        assert len(rows) == len(documents)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1 for r in rows)
    rows = {r.doc_id: r for r in run(spark, "op8_licences")}
    for d in documents:
        if "Apache License, Version 2.0" in d["text"]:
            assert "apache" in rows[d["doc_id"]].families


def test_pages_contract(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    rows = run(spark, "op6_html_extraction")
    assert len(rows) == len(pages)
    for r in rows:
        html = pages[r.page_id]["html"] or ""
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id]["url"]
        if "<article>" in html:
            assert r.text and "\n\n" not in r.text and "<p>" not in r.text


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on the documents that the one before kept."""
    sf, kept = SF, {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        kept[name] = rows
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id for r in rows} <= set(before)
        if name == "toxicity":
            bad = {r.doc_id for r in run(spark, "op10_toxicity") if r.predicted}
            assert {r.doc_id for r in rows} == set(before) - bad
        if name == "jaccard_join":
            classes = brute_classes([(i, r.text) for i, r in before.items()])
            assert {r.doc_id for r in rows} == {c for _, c, _ in classes}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
            clean = set()
            for i, r in before.items():
                n, hit, _ = brute_hits(r.text, items)
                if not (hit and 20 * hit >= n):
                    clean.add(i)
            assert {r.doc_id for r in rows} == clean
        if name == "pii":
            assert {r.doc_id for r in rows} == set(before)
            for r in rows:
                old = before[r.doc_id].text
                assert not base_spans(r.text or "") and (r.text == old) == (not base_spans(old or ""))
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["pii"]}
    assert len(words(kept["pii"][0].text)) >= 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """NULL and empty texts, repeated rows, NULL ids, no labels, no items."""
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "Rain at a@b.cc now", "en", None, 18), (3, "Rain at a@b.cc now", "en", None, 18), (None, "alone here", None, None, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "None"]
