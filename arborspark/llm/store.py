"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.sources.tables import broadcast_if_small, materialise

__all__ = ["documents", "has_plain_ids", "in_batches_of", "materialise", "without"]

ARROW_BYTES = 4 << 20  #: of rows that go to a Python worker at once; a larger row goes alone


def in_batches_of(spark: SparkSession, limit: int = ARROW_BYTES) -> None:
    """From here on the session hands rows to Python workers in Arrow batches of about `limit` bytes. By Spark's own limit of
    64 MB, each task has that in the executor, in buffers that double as they grow, and again in its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def has_plain_ids(docs: DataFrame, doc_id: str) -> bool:
    """Is no id null or that of several rows?"""
    return docs.groupBy(doc_id).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(doc_id).isNull()).isEmpty()


def without(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in the one column of gone. Where these are few, no row of docs is shuffled."""
    gone = broadcast_if_small(materialise(gone.toDF("gone"), "gone"))
    return docs.join(gone, docs[doc_id] == gone["gone"], "left_anti")
