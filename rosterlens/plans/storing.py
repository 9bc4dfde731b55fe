"""Writing layers: clustered parquet, atomic version switch, loads that rewrite only the partitions they change."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.session import written_table


def write_clustered(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (),
                    mode: str = "overwrite", files: int | None = None) -> None:
    """Range-cluster on the sort columns so file statistics prune scans on them.

    Range partitioning samples the data, so a hot value is spread by the further sort columns.
    """
    keys = [*partition_by, *sort_by]
    if keys:
        df = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
        df = df.sortWithinPartitions(*keys)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


VERSION_SCHEMA = "version int, folder string, tag string"


def publish(df: DataFrame, root: str, tag: str | None = None) -> int:
    """Write a new version folder, then record it; readers see the old version until the record exists.

    The tag names what the version contains (a batch id, say), so a repeated load can tell
    that it was already published. One writer per root.
    """
    spark = df.sparkSession
    version = current_version(spark, root) + 1
    folder = f"{root}/data/v{version}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(folder)
    record = spark.createDataFrame([(version, folder, tag)], VERSION_SCHEMA)
    record.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(VERSION_SCHEMA).parquet(f"{root}/versions")


def current_version(spark: SparkSession, root: str) -> int:
    versions = _versions(spark, root)
    return 0 if versions is None else versions.agg(F.max("version")).first()[0] or 0


def current_tag(spark: SparkSession, root: str) -> str | None:
    versions = _versions(spark, root)
    return None if versions is None else versions.orderBy(F.desc("version")).select("tag").first()[0]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    newest = _versions(spark, root).orderBy(F.desc("version")).select("folder").first()
    return spark.read.parquet(newest[0])


def append_new_columns(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Union that keeps columns only one side has (null on the other)."""
    return target.unionByName(batch, allowMissingColumns=True)


PART = "key_part"


def key_part(key: str, parts: int) -> Column:
    """Number of the partition that holds a key; keys spread evenly, whatever their values."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace exactly the partitions that `df` has rows of; the files of all others stay as they are.

    `df` must be written (see written_table), since it may have been computed from the partitions that are replaced.
    """
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_by_key(df: DataFrame, path: str, key: str, parts: int) -> None:
    """First state of a table that later loads change by key. `parts` stays the same for the life of the table;
    a part has to fit one task."""
    write_partitions(df.withColumn(PART, key_part(key, parts)), path, [PART])


def touched_parts(keys: DataFrame, key: str, parts: int) -> list[int]:
    """The partitions in which the keys lie: at most `parts` numbers."""
    return sorted(r[0] for r in keys.select(key_part(key, parts)).distinct().collect())
