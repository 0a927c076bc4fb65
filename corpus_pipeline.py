"""The corpus pipeline: quality, line dedup, near-dedup, decontamination and mixing over documents.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept,
and returns rows with the columns of documents. Between stages rows are written
as Parquet to the folder that all executors share and read again. No SQL
expresses the classifier or the shingle hashes, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestitch.llm import decontaminate, lines, mixing, quality, simhash
from lodestitch.llm.tables import kept_table, small_batches, table

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    small_batches(spark)
    return quality.keep_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines that stand, or nearly stand, earlier in the corpus go."""
    return lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: near copies of a document that stays go, verified by their word shingles."""
    return simhash.dedup_near_copies(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a benchmark window go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents are sampled by calibrated probabilities; each row keeps its probability."""
    return mixing.sample_documents(docs, probability="probability")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, in their order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
