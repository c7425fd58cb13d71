"""Pattern tables on disk: Parquet by partition, so that a reader prunes to its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def write_patterns(patterns: DataFrame, taxa: DataFrame, path: str, partitions: DataFrame | None = None) -> None:
    """patterns (part_id, pattern_id, weight, codes), taxa (taxon_id, name) and, if given, the partitions'
    dimension (name, model, weights, frequencies). Refuses to overwrite; the metadata row, written last,
    says that the store is complete."""
    patterns.write.mode("errorifexists").partitionBy("part_id").parquet(f"{path}/patterns")
    taxa.coalesce(1).write.mode("errorifexists").parquet(f"{path}/taxa")
    if partitions is not None:
        partitions.coalesce(1).write.mode("errorifexists").parquet(f"{path}/partitions")
    size = patterns.sparkSession.read.parquet(f"{path}/patterns").agg(F.count("*").alias("n_patterns"), F.count_distinct("part_id").alias("n_partitions"), F.sum("weight").alias("weight"))
    size.select(F.lit(VERSION).alias("version"), "*").coalesce(1).write.mode("errorifexists").parquet(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str) -> Row:
    meta = spark.read.parquet(f"{path}/metadata").first()
    if meta is None or meta["version"] != VERSION:
        raise ValueError("the table was written by another version")
    return meta


def read_patterns(spark: SparkSession, path: str, part_ids: list[int] | None = None) -> DataFrame:
    """The patterns, pruned to some partitions if asked; one row is read to check the version."""
    read_metadata(spark, path)
    rows = spark.read.parquet(f"{path}/patterns")
    return rows if part_ids is None else rows.where(F.col("part_id").isin(part_ids))


def read_partition_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/partitions")


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/taxa")


def snapshot(rows: DataFrame, folder: str, number: int) -> str:
    """One numbered state of an iterative run; complete once its _SUCCESS file is there."""
    path = f"{folder}/state={number:06d}"
    rows.write.mode("error" if exists(rows.sparkSession, f"{path}/_SUCCESS") else "overwrite").parquet(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last complete state of a folder. One that was broken off has no _SUCCESS file and does not count."""
    if not exists(spark, folder):
        return None
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(str(s.getPath()) for s in files.listStatus(at) if s.getPath().getName().startswith("state=") and files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(done[-1]) if done else None
