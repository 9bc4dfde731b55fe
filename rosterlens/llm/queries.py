"""Named queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm.centroids import cluster_vectors, clusters_sql
from rosterlens.llm.decontamination import find_leaks, leaks_sql
from rosterlens.llm.hnsw import nearest_neighbours
from rosterlens.llm.html_extract import extract_text
from rosterlens.llm.licenses import find_licenses, licenses_sql
from rosterlens.llm.mixing import mix_plan, mix_sql
from rosterlens.llm.near_dedup import near_duplicates
from rosterlens.llm.quality import document_grade, score_quality, train_quality
from rosterlens.llm.secrets import scan_secrets
from rosterlens.llm.sharding import shard_documents
from rosterlens.llm.spelling import group_spellings
from rosterlens.llm.url_filter import judge_urls, judge_urls_sql
from rosterlens.llm.vector_dedup import near_vectors


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_plan(table(spark, folder, "documents"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_quality(docs, train_quality(docs, table(spark, folder, "labels"), document_grade()))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("score")


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return find_licenses(table(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(table(spark, folder, "embeddings"))


def op12_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return group_spellings(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_sharding": op2_sharding,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_license_scan": op9_license_scan,
    "op10_url_filter": op10_url_filter,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op4_source_mixing": mix_sql(),
    "op7_benchmark_decontamination": leaks_sql(),
    "op9_license_scan": licenses_sql(),
    "op10_url_filter": judge_urls_sql(),
    "op11_centroid_clustering": clusters_sql(),
}
