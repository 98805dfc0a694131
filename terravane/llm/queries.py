"""Queries opN over the given tables: each maps a table to the operator's record and its rows to the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_alerts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("alert_id"), F.col("text").alias("description"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_alerts(table(spark, sf_dir, "documents"))


def as_probes(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("probe_id"), F.col("text").alias("description"))


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- op1 ------------------------------------------------------------------------
# Words of documents and items; the windows of items; a window is joined on all its words.
OP1_SQL = r"""
WITH w AS (SELECT 'd' AS t, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
win AS (SELECT DISTINCT id, n, array_to_string(l[s:s + n - 1], ' ') AS win FROM (SELECT id, l, least(13, len(l)) AS n,
    unnest(range(1, greatest(len(l) - 12, 1) + 1)) AS s FROM w WHERE t = 'b' AND len(l) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spot AS (SELECT id, n, s, array_to_string(l[s:s + n - 1], ' ') AS win FROM (SELECT id, l, n, unnest(range(1, len(l) - n + 2)) AS s
    FROM w, lens WHERE t = 'd' AND len(l) >= n)),
hit AS (SELECT spot.id, win.id AS item, s, spot.n FROM spot JOIN win USING (n, win)),
cov AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hit) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
FROM w LEFT JOIN cov USING (id) LEFT JOIN items USING (id) WHERE t = 'd'
"""


@query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.contamination import contaminated, probe_hits

    hits = probe_hits(alerts(spark, sf_dir), as_probes(table(spark, sf_dir, "benchmark")))
    return hits.select(
        F.col("alert_id").alias("doc_id"), "n_words", "n_hit", F.size("probe_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("probe_ids", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


# ---- op2 ------------------------------------------------------------------------
@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.sharding import shard_alerts

    placed = shard_alerts(alerts(spark, sf_dir))
    return placed.withColumnRenamed("alert_id", "doc_id").withColumn("law", F.lit("key"))


# ---- op7 ------------------------------------------------------------------------
def packed(alerts: DataFrame) -> DataFrame:
    from terravane.llm.packing import pack, token_pieces
    from terravane.llm.texts import stage

    pieces = stage(token_pieces(alerts, vocabulary_file()).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(pieces).withColumnRenamed("alert_id", "doc_id")


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(alerts(spark, sf_dir))


# ---- op10 -----------------------------------------------------------------------
def as_labels(labels: DataFrame, part: int, parts: int, mark: str) -> DataFrame:
    """Labels to learn from: all but the held-out rows."""
    from terravane.llm.texts import held_out

    return labels.filter(~held_out(F.col("doc_id"), parts, part)).select(F.col("doc_id").alias("alert_id"), mark)


def toxicity(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    from terravane.llm.toxicity import score_toxicity

    return score_toxicity(alerts, as_labels(labels, 2, 4, "toxic"), restored=False)


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.texts import held_out

    scored = toxicity(alerts(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select(F.col("alert_id").alias("doc_id"), held_out(F.col("alert_id"), 4, 2).alias("held_out"), "score", "predicted")


# ---- op5 ------------------------------------------------------------------------
@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.near_copies import near_copies

    return near_copies(alerts(spark, sf_dir)).withColumnRenamed("alert_id", "doc_id")


# ---- op9 ------------------------------------------------------------------------
@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.pii import KINDS, private_spans, spelled

    found = private_spans(alerts(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in KINDS]
    return found.select(
        F.col("alert_id").alias("doc_id"), *counts, F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


# ---- op4 ------------------------------------------------------------------------
@query("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.fingerprints import fingerprint_alerts

    return fingerprint_alerts(alerts(spark, sf_dir)).withColumnRenamed("alert_id", "doc_id")


# ---- op3 ------------------------------------------------------------------------
@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.quality import score_quality
    from terravane.llm.texts import held_out

    scored = score_quality(alerts(spark, sf_dir), as_labels(table(spark, sf_dir, "labels"), 1, 3, "quality"))
    return scored.select(F.col("alert_id").alias("doc_id"), held_out(F.col("alert_id"), 3, 1).alias("held_out"), "score", "predicted")


# ---- op6 ------------------------------------------------------------------------
@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.pages import extract_pages

    found = extract_pages(table(spark, sf_dir, "pages"), link="url")
    return found.select("page_id", F.col("link").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))


# ---- op8 ------------------------------------------------------------------------
@query("op8_licences")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.licences import scan_licences

    found = scan_licences(alerts(spark, sf_dir))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    return found.select(
        F.col("alert_id").alias("doc_id"), F.size("notices").cast("long").alias("n_notices"), F.array_join(families, ",").alias("families"),
        F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["family"], n["start"].cast("string"), n["stop"].cast("string"))), ",").alias("spans"),
        F.round(F.array_max(F.transform("notices", lambda n: n["probability"])), 6).alias("probability"))


# ---- op11 -----------------------------------------------------------------------
# Vectors as whole numbers, one row per component; ten rounds written out; ties by the smaller number.
def _classes_sql(classes: int = 8, rounds: int = 10) -> str:
    near = """SELECT id, c, d FROM (SELECT id, c, d, row_number() OVER (PARTITION BY id ORDER BY d, c) AS place FROM (
      SELECT v.id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN {m} m USING (k) GROUP BY ALL)) WHERE place = 1"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(m=f'm{i}')})")
        steps.append(f"""m{i + 1} AS MATERIALIZED (SELECT m.c, m.k, coalesce(n.x, m.x) AS x FROM m{i} m LEFT JOIN (
      SELECT c, k, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{i} JOIN v USING (id) GROUP BY c, k) n USING (c, k))""")
    steps.append(f"a AS MATERIALIZED ({near.format(m=f'm{rounds}')})")
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS HUGEINT)) AS l
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64),
    v AS MATERIALIZED (SELECT id, unnest(range(1, 65)) AS k, unnest(l) AS x FROM e),
    first AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), l) - 1 AS c, id FROM e),
    m0 AS MATERIALIZED (SELECT c, k, x FROM first JOIN v USING (id) WHERE c < {classes}), {", ".join(steps)},
    s AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k)) AS h FROM m{rounds} GROUP BY c)
    SELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a JOIN e USING (id) JOIN s ON s.c = a.c"""


@query("op11_clusters", _classes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.terrain_classes import terrain_classes

    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("site"), F.col("embedding").alias("features"))
    found = terrain_classes(cells, key=["site"])
    spelled = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select(F.col("site").alias("vec_id"), F.col("class").alias("cluster"), "distance", F.col("class_inertia").alias("cluster_inertia"),
                        "inertia", F.sha2(spelled.cast("binary"), 256).alias("centroid_sha256"))


# ---- op12 -----------------------------------------------------------------------
def repeating(documents: DataFrame) -> DataFrame:
    """Alerts ``link, description``: of the documents that the contract names, the words from one on repeat with its period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def again(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    # The lambda names the words once; without it they would be split again for every word.
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise("")), 0)
    return documents.select(F.col("doc_id").alias("link"), F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("description"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.periodic_runs import periodic_runs

    found = periodic_runs(repeating(table(spark, sf_dir, "documents")))
    # Longest first, then by start and period.
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 0)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        F.col("link").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-F.col("best.l") * 1000 / F.col("best.p")).alias("exponent_milli"),
        digest(F.array_join(line, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


# ---- op13 -----------------------------------------------------------------------
@query("op13_bit_minhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.llm.bit_copies import near_repeats

    found = near_repeats(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("link"), F.col("text").alias("description")))
    return found.select(F.col("link").alias("doc_id"), "n_shingles", F.col("class_link").alias("component_id"), "kept")
