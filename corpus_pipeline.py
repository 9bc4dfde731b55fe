"""The training-data pipeline over the documents table: STAGES of operators, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
documents; all but the last keep the columns of documents. Stages accept nulls in any column, repeated rows, empty tables
and further columns, as their operators do: a null or blank text is rejected by the quality model where it learnt so,
has no near-duplicates, holds no benchmark item and takes no words of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm.decontamination import drop_leaks
from rosterlens.llm.mixing import mix_documents
from rosterlens.llm.near_dedup import Settings, near_duplicates
from rosterlens.llm.quality import document_grade, keep_good, train_quality
from rosterlens.llm.sharding import with_shards, with_slots
from rosterlens.session import written_table


# Five words and four fifths; a pair at the threshold shares no band with probability below 2e-7.
NEAR_DUPLICATES = Settings(size=5, percent=80, bands=40, rows=5)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, rejects go."""
    return keep_good(docs, train_quality(docs, _table(spark, sf_dir, "labels"), document_grade()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; rows that repeat an id are one document."""
    gone = near_duplicates(docs, settings=NEAR_DUPLICATES).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == gone._gone, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with size, text_crc32, law, shard, slot and grown_shard."""
    return with_slots(with_shards(docs))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # the quality model and near-duplicate groups have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
