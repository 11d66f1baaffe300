"""The corpus pipeline: quality rules, near-duplicates, secrets, packing.

``run`` applies the stages to ``documents``. Each writes its rows to the shared folder, and the next one
reads them back, so a lost executor costs no more than the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelake.llm import minhash, packing, quality, secrets
from hirelake.llm.batches import table
from hirelake.llm.queries import WORD_VOCABULARY
from hirelake.llm.shipping import ship
from hirelake.llm.tokens import vocabulary_path
from hirelake.session import staged

# Whole rows go to the tasks' Python here, so batches are small.
ARROW_ROWS = "2000"


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs."""
    _bounded(spark)
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), and all others."""
    _bounded(spark)
    judged = minhash.near_duplicates(docs, width=5)
    gone = judged.where(~judged["kept"]).select(judged["doc_id"].alias("id")).distinct()
    return minhash.picked(docs, staged(gone, "duplicates"), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    _bounded(spark)
    return secrets.without_secrets(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens, cut and packed into sequences: one row per piece, with its ids."""
    _bounded(spark)
    return packing.packed(packing.cut(docs, vocabulary_path(WORD_VOCABULARY)))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# SQL has no tokenizer: tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None
