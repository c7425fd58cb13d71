"""Intermediate tables in the folder that every executor can read, and what is decided by their sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL = 1_000_000  #: rows of a table that may be broadcast or sorted in one task


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder below spark.checkpoint.dir; below /tmp only where that is unset (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{folder.rstrip('/')}/arborspark-{spark.sparkContext.applicationId}"


def new_table(spark: SparkSession, name: str) -> str:
    """The path of a table that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps neither recompute it
    nor depend on one executor's disk."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Delete this session's intermediate tables; results that still read them can't be computed again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, rows: int = SMALL) -> bool:
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, marked to be broadcast if it has few rows; else a join shuffles both sides."""
    return F.broadcast(df) if is_small(df, rows) else df


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with row numbers from 0 in the order of a unique column. A large table is cut into ranges
    that are numbered in parallel, and the numbers of rows in the ranges before are added."""
    if is_small(df):
        return df.withColumn(name, F.row_number().over(Window.orderBy(order)) - 1)
    ranges = materialise(df.repartitionByRange(order).withColumn("range_id", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("range_id").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.orderBy("range_id")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("range_id").orderBy(order)) - 1
    return ranges.withColumn(name, inside).join(F.broadcast(before), "range_id").withColumn(name, (F.col(name) + F.col("before")).cast("int")).drop("range_id", "before")
