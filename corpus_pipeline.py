"""Corpus pipeline: toxicity filter, near-duplicate removal, redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread
as the next stage's docs. All but the last return the columns of ``documents``. Stages that run Python
lower the session's number of rows an Arrow batch to BATCH_ROWS.

Null or empty text, or no words: scored as an empty text, no near duplicate of anything, redacted to
itself, and left out by the mix, which takes words only. Null doc_id: kept; texts without an id are told
apart by a hash. Texts of any length are read whole. Ties and repeated rows: of equal rows with words
one stays. Empty table: no rows. Extra columns, whatever their names, pass to the last stage, which
drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civlens.llm import jaccard_join, mixing, packing, pii, toxicity
from civlens.llm.common import small_batches, written
from civlens.llm.tokens import default_path

#: Rows of an Arrow batch; texts of the usual length make about 2 MB.
BATCH_ROWS = 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this table, does not reject."""
    small_batches(spark, BATCH_ROWS)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 or more connect."""
    small_batches(spark, BATCH_ROWS)
    return jaccard_join.one_of_each(docs, 5, 80, 100)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    small_batches(spark, BATCH_ROWS)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in its order, once a copy."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 token ids."""
    small_batches(spark, BATCH_ROWS)
    return packing.pack(docs, default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training, similarity components and token ids have no SQL form; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
