"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept.  All but the last return the columns of documents; toxicity and quality are learnt
from the labelled rows of the documents table in sf_dir, decontamination takes its
benchmark from there.  Every row is kept or dropped by its own text, also where doc_ids are
null or repeated; a row without a doc_id is never one of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common, decontaminate, jaccard, packing, quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.filtered(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.filtered(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id."""
    return jaccard.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.filtered(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learnt scores, similarity classes and packing cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents").select(*[F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")])
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.kept(docs, f"pipeline-{name}")
    return docs
