"""The corpus pipeline: stages applied one after another to ``documents``.

Each stage gets the rows that its predecessor kept and returns documents again, with
all their columns; the last returns their token ids. ``run`` writes each stage's
rows to the shared folder as Parquet and reads them back for the next.

``run`` removes what a stage staged on its way once the stage's own rows are written.

Defined results: a decision is about a row or about its text, never about its doc_id:
the first and the fourth stage carry each row through, the third goes by the text, so
each row gets its own, also where doc_ids are null or repeated. The second stage keeps
one row of each group of near copies; of rows equal in doc_id and text, whose other
columns may differ, any one stands for all. A null text has no words and goes in the
first stage; later stages pass it on. Extra columns pass through all stages but the
last, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from pairlake.llm import decontamination, jaccard_join, outliers, secrets, sentencepiece_backend
from pairlake.llm.common import discard, staged, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return outliers.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, or of those the least text digest."""
    return jaccard_join.first_of_groups(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and what was verified of them."""
    return sentencepiece_backend.encoded(docs, whole=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", token_ids),
]

#: Outlier estimates, secret tests and token ids cannot be written in SQL; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), written(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i}")
            discard(spark, since=before, but=docs)
            gc.collect()  # so that Spark's cleaner sees what the stage's plans held: shuffles, checkpoints, broadcasts
            spark.sparkContext._jvm.System.gc()
    return docs
