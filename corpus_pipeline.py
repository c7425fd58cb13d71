"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborspark.llm.decontaminate import keep_clean
from arborspark.llm.exact_dedup import keep_exact
from arborspark.llm.near_dedup import keep_near
from arborspark.llm.packing import pack
from arborspark.llm.quality import keep_good, learn
from arborspark.llm.store import documents, in_batches_of, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject.

    Rows are judged one by one: null and shared ids make no difference, repeated rows stay or go
    together, null and empty texts count as one empty line. Labels without a document, null labels and
    the held-out fifth teach nothing; without labels of both kinds every text gets the same score. An
    empty table gives an empty one; all columns stay.
    """
    in_batches_of(spark)
    return keep_good(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the most characters, then the least doc_id.

    White space does not count; null texts are empty, and all empty texts are one group. Of rows that
    also share a doc_id, or have none, exactly one stays as well. Long texts are compared whole. An
    empty table gives an empty one; all columns stay.
    """
    in_batches_of(spark)
    return keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id.

    Where ids are null or shared, rows are numbered and the least number stays. Rows without a word all
    stay; repeated rows are near-duplicates of each other. Sets of long texts are whole. An empty table
    gives an empty one; all columns stay.
    """
    in_batches_of(spark)
    return keep_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with a quarter of its words changed.

    Rows are judged one by one, whatever their ids; null and empty texts stay, items without a word
    match nothing; long texts are read whole. An empty table on either side takes nothing away; all
    columns stay.
    """
    in_batches_of(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, placed in sequences of at most 4096 tokens.

    Every row is a document, with its id as it is; a null or empty text gives the end id alone; long
    texts fill sequences of their own. An empty table gives no pieces.
    """
    in_batches_of(spark)
    return pack(docs, keep_units=False)  # workers of other stages get that memory


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Training, MinHash and tokenizing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = materialise(out, name)
    return out
