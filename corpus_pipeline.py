"""From raw documents to packed training sequences.

Toxic documents go, one document of each class of near copies stays, contaminated ones go, personal data is masked, and
what is left is packed.  Each stage works on all that the one before kept, and all but the last return the columns of
documents.  An empty table passes through; NULL texts are kept as clean texts without words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import queries as Q
from terravane.session import checkpoint_root, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Trained models, similarity classes and a tokenizer: not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the toxicity model, which learns from the labels of the documents at hand."""
    from terravane.llm.toxicity import keep_clean

    tune(spark)
    labels = Q.as_labels(Q.table(spark, sf_dir, "labels"), 2, 4, "toxic")
    return keep_clean(docs, labels.withColumnRenamed("alert_id", "doc_id"), alert_id="doc_id", description="text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id."""
    from terravane.llm.near_copies import keep_one

    tune(spark)
    return keep_one(docs, alert_id="doc_id", description="text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a window of a benchmark item."""
    from terravane.llm.contamination import keep_uncontaminated

    tune(spark)
    items = Q.table(spark, sf_dir, "benchmark")
    return keep_uncontaminated(docs, Q.as_probes(items), alert_id="doc_id", text="text")


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind; n_chars is that of the new text."""
    from terravane.llm.pii import masked, private_spans

    tune(spark)
    found = private_spans(docs, alert_id="doc_id", description="text").withColumn("text", masked(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 4096 tokens."""
    tune(spark)
    return Q.packed(Q.as_alerts(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_private),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = Q.table(spark, sf_dir, "documents").select(*COLUMNS)
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
