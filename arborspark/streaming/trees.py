"""Trees that arrive as files: each micro-batch is evaluated and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.numerics import Model
from arborspark.plans.evaluate import evaluate_trees


def tree_stream(spark: SparkSession, folder: str) -> DataFrame:
    """tree_id, newick of text files put into a folder, a tree a line."""
    lines = spark.readStream.text(folder).where(F.trim("value") != "")
    return lines.select(F.abs(F.xxhash64("value")).alias("tree_id"), F.trim("value").alias("newick"))


def evaluate_stream(trees: DataFrame, patterns: DataFrame, models: dict[int, Model], names: list[str], out: str, checkpoint: str):
    """Start a query that evaluates new trees and appends them to Parquet at `out`; a batch that is
    run again after a failure replaces its own rows."""

    def batch(rows: DataFrame, number: int) -> None:
        done = evaluate_trees(rows, patterns, models, names, passes=4)
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return trees.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
