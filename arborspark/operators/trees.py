"""Trees as tables: bipartitions, Robinson-Foulds distance, top-k, model choice, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def caterpillar_splits(order: DataFrame) -> DataFrame:
    """Inner splits of the caterpillar whose tips stand in the order of `place` (from 0):
    tree_id, split (taxa of the side without taxon 0, ascending). order: tree_id, taxon_id, place."""
    tips = Window.partitionBy("tree_id")
    sized = order.withColumn("n", F.count("*").over(tips))
    prefix = sized.alias("a").join(sized.alias("b"), (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("b.place") <= F.col("a.place")))
    sets = prefix.where("a.place >= 1 and a.place <= a.n - 3").groupBy("a.tree_id", "a.place", "a.n").agg(F.sort_array(F.collect_list("b.taxon_id")).alias("head"))
    rest = F.filter(F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda t: t), lambda t: ~F.array_contains("head", t))
    return sets.select("tree_id", F.when(F.array_contains("head", 0), rest).otherwise(F.col("head")).alias("split"))


def rf_distance(splits: DataFrame, left: int, right: int) -> DataFrame:
    """Relative Robinson-Foulds distance of two trees: shared, differing, relative."""
    key = F.concat_ws(",", "split")
    a, b = (splits.where(F.col("tree_id") == t).select(key.alias("split")).distinct() for t in (left, right))
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "split", "full")
    both = (F.col("l").isNotNull() & F.col("r").isNotNull()).cast("long")
    out = sides.agg(F.sum(both).alias("shared"), F.sum(1 - both).alias("differing"), F.count("*").alias("all"))
    return out.select("shared", "differing", F.round(F.col("differing") / (2 * F.col("shared") + F.col("differing")), 9).alias("relative"))


def split_frequencies(splits: DataFrame) -> DataFrame:
    """How many trees have each split."""
    return splits.groupBy(F.concat_ws(",", "split").alias("split")).agg(F.count_distinct("tree_id").alias("trees"))


def best_trees(scored: DataFrame, k: int, topology: str = "topology", score: str = "lnl") -> DataFrame:
    """The k best topologies: each once, with its best score; ties by topology."""
    once = scored.groupBy(topology).agg(F.max(score).alias(score))
    return once.orderBy(F.desc(score), topology).limit(k)


def ranked(scored: DataFrame, k: int, topology: str = "topology", score: str = "lnl") -> DataFrame:
    """The k best topologies with their ranks from 1; the n-th best is where rank = n."""
    best = best_trees(scored, k, topology, score)
    return best.select(F.row_number().over(Window.orderBy(F.desc(score), topology)).alias("rank"), topology, score)


def criterion(name: str, lnl: Column, k: Column, n: Column) -> Column:
    """The score, smaller is better, of a fit with k parameters to n sites."""
    aic = 2 * (k - lnl)
    return {"ml": -lnl, "aic": aic, "bic": k * F.log(n) - 2 * lnl, "aicc": F.when(n - k - 1 > 0, aic + 2 * k * (k + 1) / (n - k - 1))}[name]


def choose_models(scored: DataFrame, name: str) -> DataFrame:
    """Best model of each partition. scored: part_id, model, freq_mode, lnl, k, n."""
    score = F.round(criterion(name, F.col("lnl"), F.col("k"), F.col("n")), 6)
    rows = scored.withColumn("score", score).where("score is not null")
    best = rows.groupBy("part_id").agg(F.min(F.struct("score", "freq_mode", "model")).alias("b"))
    return best.select("part_id", "b.model", "b.freq_mode", "b.score")


def tree_length(edges: Column) -> Column:
    """Sum of -ln z over edges whose lengths are stored as z = exp(-t)."""
    return F.aggregate(edges, F.lit(0.0), lambda t, e: t - F.log(e["z"]))


def place(parts: DataFrame, ranks: int) -> DataFrame:
    """Slices of partitions on ranks: equal weights a rank and data type, few partitions cut.
    Partitions are laid end to end by ascending width and the line is cut every ceil(total / ranks)
    patterns. parts: part_id, data_type, width; result: part_id, rank, offset, width."""
    line = Window.partitionBy("data_type").orderBy("width", "part_id")
    rows = parts.withColumn("end", F.sum("width").over(line)).withColumn("begin", F.col("end") - F.col("width"))
    cap = F.ceil(F.sum("width").over(Window.partitionBy("data_type")) / ranks)
    rows = rows.withColumn("cap", cap).where("width > 0")
    cut = rows.withColumn("rank", F.explode(F.sequence(F.expr("begin div cap"), F.expr("(end - 1) div cap"))))
    lo, hi = F.greatest("begin", F.col("rank") * F.col("cap")), F.least("end", (F.col("rank") + 1) * F.col("cap"))
    return cut.select("part_id", "rank", (lo - F.col("begin")).alias("offset"), (hi - lo).alias("width"))


def load_report(placed: DataFrame) -> DataFrame:
    """rank, partitions, patterns."""
    return placed.groupBy("rank").agg(F.count("*").alias("partitions"), F.sum("width").alias("patterns"))
