"""Partition files: `MODEL, name = a-b[\\step][, c-d ...]`, a line for each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The names a partition may give for its model.
AA_MODELS = (
    "AUTO BLOSUM62 CPREV DAYHOFF DCMUT FLU GTR HIVB HIVW JTT JTTDCMUT LG LG4M LG4X MTART MTMAM MTREV "
    "MTZOA PMB RTREV STMTREV VT WAG"
).split()
MODEL = r"^\s*([A-Za-z0-9]+)\s*,\s*([^=\s]+)\s*=\s*(.+?)\s*$"


def parse_partitions(lines: DataFrame) -> DataFrame:
    """lines (value) to ranges: part_id, name, model, data_type, freq_mode, lo, hi, step. Lines
    that don't parse, or models that are not supported, come out with a null data_type."""
    rows = lines.where(F.trim("value") != "")
    name, model = F.regexp_extract("value", MODEL, 2), F.upper(F.regexp_extract("value", MODEL, 1))
    rows = rows.select("value", name.alias("name"), model.alias("model"), F.regexp_extract("value", MODEL, 3).alias("ranges"))
    base = F.regexp_replace("model", "^(.*[^FX])[FX]$", "$1")
    is_plain, is_suffixed = F.col("model").isin(*AA_MODELS), base.isin(*AA_MODELS)
    fixed_only = base.isin("AUTO", "LG4M", "LG4X") & ~is_plain
    kind = F.when(F.col("model").isin("MULTI", "CODON"), F.col("model")).when(F.col("model").isin("DNA", "DNAX"), "DNA").when(F.col("model").isin("BIN", "BINX"), "BIN").when((is_plain | is_suffixed) & ~fixed_only, "AA")
    mode = F.when(F.col("model").isin("DNA", "BIN"), "empirical").when(F.col("model").endswith("X") & ~is_plain, "optimised").when(F.col("model").endswith("F") & ~is_plain, "empirical").otherwise("model")
    ids = rows.withColumn("part_id", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    each = ids.select("part_id", "name", "model", kind.alias("data_type"), mode.alias("freq_mode"), F.explode(F.split("ranges", ",")).alias("r"))
    number = lambda pattern: F.regexp_extract(F.trim("r"), pattern, 1)
    lo = number(r"^(\d+)").cast("int")
    hi, step = number(r"-\s*(\d+)"), number(r"\\(\d+)$")
    return each.select("part_id", "name", "model", "data_type", "freq_mode", lo.alias("lo"), F.when(hi != "", hi.cast("int")).otherwise(lo).alias("hi"), F.when(step != "", step.cast("int")).otherwise(1).alias("step"))


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    return parse_partitions(spark.read.text(path))


def partitions(spark: SparkSession, lines: list[str]) -> DataFrame:
    return parse_partitions(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))


def check_ranges(ranges: DataFrame) -> None:
    """Raise for lines that could not be read: an unknown model, no place, or an empty range."""
    bad = ranges.where("data_type is null or lo is null or hi is null or lo < 1 or hi < lo or step < 1").limit(3).collect()
    if bad:
        raise ValueError(f"partitions that can't be read: {[(r['part_id'], r['name'], r['model'], r['lo'], r['hi']) for r in bad]}")


def site_map(sites: DataFrame, ranges: DataFrame) -> DataFrame:
    """site to part_id: a range join with a stride; ranges are as many as the partition file's, so they are broadcast."""
    inside = F.col("site").between(F.col("lo"), F.col("hi")) & ((F.col("site") - F.col("lo")) % F.col("step") == 0)
    return sites.join(F.broadcast(ranges), inside).select("site", "part_id")


def misassigned(sites: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sites that have no partition or several: site, n."""
    found = site_map(sites, ranges).groupBy("site").agg(F.count("*").alias("n"))
    return sites.join(found, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")
