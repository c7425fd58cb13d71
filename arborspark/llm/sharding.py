"""Operator 12: shards by fixed virtual slots, in DataFrame functions alone.

A record's id is hashed into one of thousands of slots, for good. Bytes are summed by slot, and a
table with a row a slot says which shard it belongs to. Rebalancing edits that table into its next
version: slots whose shard still has room stay, the rest move. Only this table knows shards, so
records are never hashed anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborspark.llm.store import documents, materialise
from arborspark.sources.tables import shared_folder

SLOTS = 4096
SLACK = 0.01  #: by how much of the mean a shard may exceed it before its slots move


def slot_rows(docs: DataFrame, shards: int, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, size, text_crc32, virtual_slot, lane: a stored table, the only one that is made of texts.

    A slot that outgrows a quarter of a shard (ids that many rows share, or have none) is cut into
    lanes, row by row; all others have lane 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )
    rows = materialise(rows, "slot_rows")
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    share = F.sum("bytes").over(Window.partitionBy()) / (4 * shards)  # over a row a slot
    sums = materialise(sums.select("virtual_slot", F.ceil(F.col("bytes") / share).alias("lanes")), "lanes")
    return rows.join(F.broadcast(sums), "virtual_slot").withColumn("lane", F.pmod(F.col("row") + F.shiftright("row", 33), F.col("lanes")).cast("int")).drop("lanes")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """virtual_slot, lane, bytes, rows: one row for each slot in use."""
    return rows.groupBy("virtual_slot", "lane").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(units: Column, loads: Column) -> Column:
    """Units (bytes, virtual_slot, lane), largest first, each given to the shard that has least so far."""
    pick = lambda s: (F.array_position(s["loads"], F.array_min(s["loads"])) - 1).cast("int")

    def place(s: Column, u: Column) -> Column:
        shard = pick(s)
        return F.struct(
            F.transform(s["loads"], lambda x, i: F.when(i == shard, x + u["bytes"]).otherwise(x)).alias("loads"),
            F.concat(s["placed"], F.array(F.struct(u["virtual_slot"].alias("virtual_slot"), u["lane"].alias("lane"), shard.alias("shard")))).alias("placed"),
        )

    none = F.array().cast("array<struct<virtual_slot:int,lane:int,shard:int>>")
    return F.aggregate(units, F.struct(loads.alias("loads"), none.alias("placed")), place, lambda s: s["placed"])


def _largest_first(kept: str = "true") -> Column:
    """The units of a table with a row a slot as one array; as many as slots in use, and a few lanes."""
    unit = F.when(F.expr(kept), F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "lane", "bytes"))
    return F.sort_array(F.collect_list(unit))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """virtual_slot, lane, shard, version 1: slots dealt out by bytes, the largest first."""
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    return sizes.agg(F.explode(_dealt(_largest_first(), loads)).alias("u")).select("u.*", F.lit(1).alias("version"))


def rebalanced(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for other sizes or another number of shards, with as few bytes moved as keep
    every shard near the mean: within a shard the largest slots stay while there is room, what is over,
    new slots and slots of shards that are gone are dealt out again. Slots no longer in use keep their shard."""
    version = old.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"))
    both = sizes.select("virtual_slot", "lane", "bytes").join(old.select("virtual_slot", "lane", "shard"), ["virtual_slot", "lane"], "full")
    both = both.withColumn("used", F.col("bytes").isNotNull()).withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    mean = F.sum("bytes").over(Window.partitionBy()) / shards
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot", "lane"))
    both = materialise(both.withColumn("stays", F.coalesce((F.col("shard") < shards) & ((filled <= mean * (1 + SLACK)) | ~F.col("used")), F.lit(False))), "moves")
    held = both.where("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    loads = held.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("m"))
    loads = loads.select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("loads"))
    moved = both.agg(_largest_first("not stays and used").alias("units")).crossJoin(F.broadcast(loads))  # one row each
    moved = moved.select(F.explode(_dealt(F.col("units"), F.col("loads"))).alias("u")).select("u.*")
    out = both.where("stays").select("virtual_slot", "lane", "shard").unionByName(moved)
    return out.crossJoin(F.broadcast(version)).select("virtual_slot", "lane", "shard", (F.col("v") + 1).alias("version"))


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the maps of a folder; one that is there already is never overwritten."""
    slot_map = materialise(slot_map, "slot_map")
    number = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{folder.rstrip('/')}/version={number or 0}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a folder's maps, the latest if none is named."""
    maps = spark.read.option("basePath", folder).schema("virtual_slot int, lane int, shard int, version int").parquet(folder)
    number = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == number)


def placed(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with shard and slot: the place in its shard, gapless from 0. Slots follow each other in a shard,
    and rows are numbered within their slot, so that no task holds a shard."""
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot", "lane")) - F.col("rows")  # over a row a slot
    begin = materialise(sizes.join(slot_map.select("virtual_slot", "lane", "shard"), ["virtual_slot", "lane"]).select("virtual_slot", "lane", "shard", before.alias("before")), "begin")
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "lane").orderBy("row")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(begin), ["virtual_slot", "lane"]).withColumn("slot", F.col("before") + F.col("inside"))


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version: every row in a shard,
    sizes (UTF-8 bytes and 1) near equal.

    folder: where maps are kept by version. If it holds one, that is edited for the sizes at hand, so
    that few rows move; else a first map is stored there. A null text has size 1 and the checksum of no
    bytes; null and shared ids fall into one slot, which is cut into lanes when it outgrows a quarter
    of a shard, so repeated rows are spread; a long text is one record and stays whole. Other columns
    are not read; an empty table gives an empty result. grown_shard is null: this law moves rows by size.
    """
    spark = docs.sparkSession
    rows = slot_rows(docs, shards, slots, doc_id, text)
    sizes = materialise(slot_sizes(rows), "slot_sizes")
    folder = folder or f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
    slot_map = rebalanced(load_map(spark, folder), sizes, shards) if has_maps(spark, folder) else first_map(sizes, shards)
    save_map(slot_map, folder)
    out = placed(rows, load_map(spark, folder), sizes)
    version = F.lit(load_map(spark, folder).agg(F.max("version")).first()[0] or 0)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", version.alias("map_version"))


def has_maps(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
