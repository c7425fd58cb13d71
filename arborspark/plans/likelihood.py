"""Likelihoods of an alignment as Spark jobs over blocks of patterns, summed by partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.numerics import Model
from arborspark.plans.kernel import Block, patterns_at_once, root_edge, tree_of
from arborspark.sources.newick import Tree
from arborspark.sources.tables import broadcast_if_small, is_small, materialise


def blocks_of(b: pd.DataFrame, tree: Tree, models: dict[int, Model], every_edge: bool = True) -> Iterator[tuple[int, pd.DataFrame, Block]]:
    """The patterns of a batch as blocks: of one partition and, where patterns have a `rate`, of one rate;
    cut so that the vectors of a block take the same memory, however many taxa, rates and states there are.
    every_edge off: only one edge is looked at, and vectors are dropped on the way."""
    keys = ["part_id", "rate"] if "rate" in b else ["part_id"]
    for key, rows in b.groupby(keys):
        model = models[int(key[0])] if len(keys) == 1 else single_rate(models[int(key[0])])
        rated = tree if len(keys) == 1 else [(u, v, z ** key[1]) for u, v, z in tree]
        step = patterns_at_once(len(rows["codes"].iloc[0]), model, every_edge)
        for i in range(0, len(rows), step):
            g = rows.iloc[i : i + step]
            yield int(key[0]), g, Block(np.stack(g["codes"].to_numpy()).astype(np.int64), g["weight"].to_numpy(), model, rated, every_edge)


def single_rate(model: Model) -> Model:
    """The model of patterns that have a rate each. A mixture has a rate for each matrix, so it can't be had."""
    if not isinstance(model, Model):
        raise ValueError("patterns with rates of their own need a model with one matrix")
    return model.with_(categories=1)


def log_likelihood(patterns: DataFrame, tree: Tree, models: dict[int, Model]) -> DataFrame:
    """part_id, lnl, weight: patterns (part_id, weight, codes, and rate where each has a rate of its own)
    stay where they are; each batch of a partition is pruned on its own and the sums meet. Nothing but
    sums is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(part, x.lnl(*root_edge(tree)), int(g["weight"].sum())) for part, g, x in blocks_of(b, tree, models, every_edge=False)]
            yield pd.DataFrame(rows, columns=["part_id", "lnl", "weight"])

    columns = [c for c in ("part_id", "weight", "codes", "rate") if c in patterns.columns]
    sums = patterns.select(*columns).mapInPandas(run, "part_id int, lnl double, weight long")
    return sums.groupBy("part_id").agg(F.sum("lnl").alias("lnl"), F.sum("weight").alias("weight"))


def derivatives(patterns: DataFrame, tree: Tree, models: dict[int, Model], edges: list[tuple[int, int]]) -> DataFrame:
    """part_id, u, v, lnl, d1, d2: for each edge the log-likelihood and its derivatives by the branch's
    length, a partial sum for each batch of patterns. Every batch needs its vectors only once for all edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for part, g, x in blocks_of(b, tree, models):
                w = g["weight"].to_numpy()
                for u, v in edges:
                    rows.append((part, u, v, *(float(w @ y) for y in x.pattern_likelihoods(u, v, derivatives=True))))
            yield pd.DataFrame(rows, columns=["part_id", "u", "v", "lnl", "d1", "d2"])

    columns = [c for c in ("part_id", "weight", "codes", "rate") if c in patterns.columns]
    return patterns.select(*columns).mapInPandas(run, "part_id int, u int, v int, lnl double, d1 double, d2 double")


def pattern_likelihoods(patterns: DataFrame, tree: Tree, models: dict[int, Model], rates: list[float]) -> DataFrame:
    """The log-likelihood of each pattern under single rates: part_id, pattern_id, rate, lnl."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in rates:
                for part, g, x in blocks_of(b.assign(rate=r), tree, models, every_edge=False):
                    yield pd.DataFrame({"part_id": part, "pattern_id": g["pattern_id"], "rate": r, "lnl": x.pattern_likelihoods(*root_edge(tree))})

    return patterns.select("part_id", "pattern_id", "weight", "codes").mapInPandas(run, "part_id int, pattern_id int, rate double, lnl double")


def site_rates(patterns: DataFrame, tree: Tree, models: dict[int, Model], grid: list[float]) -> DataFrame:
    """The best single rate of each pattern from a grid, of equally good ones (to nine digits) the
    greatest: part_id, pattern_id, rate, lnl."""
    tried = pattern_likelihoods(patterns, tree, models, grid).withColumn("lnl", F.round("lnl", 9))
    best = tried.groupBy("part_id", "pattern_id").agg(F.max(F.struct("lnl", "rate")).alias("b"))
    return best.select("part_id", "pattern_id", "b.rate", "b.lnl")


def climb_rates(patterns: DataFrame, tree: Tree, models: dict[int, Model], lower: float = 0.5, upper: float = 1.0, least: float = 1e-4, most: float = 32.0) -> DataFrame:
    """The rate that each pattern climbs to from its own (column `rate`, else 1): down by steps of `lower`, up by steps
    of `upper`, each way as long as the log-likelihood (to nine digits) grows and the limits are kept; the better
    end, or the start. A block tries one rate after the other with the patterns that still climb, so nothing
    is shuffled. Result: part_id, pattern_id, rate, lnl."""

    def lnl_at(block: Block, some: np.ndarray, rate: float, start: float) -> np.ndarray:
        tree_at = [(u, v, z ** (rate / start)) for u, v, z in tree_of(block.near)]
        return np.round(Block(block.codes[some], block.weights[some], block.model, tree_at, keep=False).pattern_likelihoods(*root_edge(tree)), 9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, g, block in blocks_of(b, tree, models, every_edge=False):
                start = float(g["rate"].iloc[0])
                every = np.arange(len(g))
                rates, lnl = np.full(len(g), start), lnl_at(block, every, start, start)
                first = lnl.copy()
                for step in (-lower, upper):
                    at, here, live = start, first.copy(), every
                    while len(live) and least < (at := round(at + step, 9)) <= most:
                        new = lnl_at(block, live, at, start)
                        up = new > here[live]
                        live = live[up]
                        here[live] = new[up]
                        better = here[live] > lnl[live]
                        rates[live[better]], lnl[live[better]] = at, here[live[better]]
                yield pd.DataFrame({"part_id": part, "pattern_id": g["pattern_id"].to_numpy(), "rate": rates, "lnl": lnl})

    rate = F.col("rate") if "rate" in patterns.columns else F.lit(1.0)
    return patterns.select("part_id", "pattern_id", "weight", "codes", rate.alias("rate")).mapInPandas(run, "part_id int, pattern_id int, rate double, lnl double")


def optimise_psr(patterns: DataFrame, tree: Tree, models: dict[int, Model], categories: int = 25, finer: tuple[int, ...] = (1, 2), most: float = 32.0) -> tuple[DataFrame, float]:
    """Patterns with a rate each (column `rate`) and their log-likelihood: rates climbed to by steps of 0.5 down and
    1 up, then by these divided by each further number of `finer`, and put into categories. If that is
    worse than what the patterns had, they are given back as they were."""
    old = patterns if "rate" in patterns.columns else patterns.withColumn("rate", F.lit(1.0))
    before = log_likelihood(old, tree, models).agg(F.sum("lnl")).first()[0]
    key, plain, now = ["part_id", "pattern_id"], old.drop("rate"), old
    for n in finer:
        rates = materialise(climb_rates(now, tree, models, 0.5 / n, 1.0 / n, most=most), "rates")
        now = plain.join(rates.select(*key, "rate"), key)
    done = categorise(rates.join(plain.select(*key, "weight"), key), categories)
    new = materialise(plain.join(done.select(*key, F.col("category_rate").alias("rate")), key), "rated")
    after = log_likelihood(new, tree, models).agg(F.sum("lnl")).first()[0]
    return (new, after) if after >= before else (old, before)


def islands(rates: DataFrame, tolerance: float) -> DataFrame:
    """Distinct rates of each partition (part_id, rate) with the number of their island: rates that follow each
    other by less than the tolerance are on one. Many rates are cut into ranges: a range numbers its islands,
    and one whose first rate is near the last before it goes on with that one's island."""
    apart = lambda before: (F.col("rate") - before >= tolerance) | before.isNull()
    if is_small(rates):
        line = Window.partitionBy("part_id").orderBy("rate")
        return rates.withColumn("starts", apart(F.lag("rate").over(line)).cast("long")).withColumn("island", F.sum("starts").over(line)).drop("starts")
    cut = materialise(rates.repartitionByRange("part_id", "rate").withColumn("range_id", F.spark_partition_id()), "rate_ranges")
    line, key = Window.partitionBy("range_id", "part_id").orderBy("rate"), ["range_id", "part_id"]
    inner = materialise(cut.withColumn("before", F.lag("rate").over(line)).withColumn("starts", (apart(F.col("before")) & F.col("before").isNotNull()).cast("long")), "rate_gaps")
    borders = inner.groupBy(*key).agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"), F.sum("starts").alias("inside"))
    order = Window.partitionBy("part_id").orderBy("range_id")  # a row a range and partition
    opens = (F.col("lo") - F.lag("hi").over(order) >= tolerance) | F.lag("hi").over(order).isNull()
    borders = borders.withColumn("opens", opens.cast("long")).withColumn("begin", F.sum(F.col("opens") + F.col("inside")).over(order) - F.col("inside"))
    borders = broadcast_if_small(materialise(borders.select(*key, "begin"), "borders"))
    return inner.withColumn("own", F.sum("starts").over(line)).join(borders, key).select("part_id", "rate", (F.col("begin") + F.col("own")).alias("island"))


def categorise(rates: DataFrame, categories: int = 25, joint: bool = False, tolerance: float = 1e-3) -> DataFrame:
    """At most `categories` rates of each partition: rates nearer to the next than the tolerance are one cluster,
    which has the rate of its first pattern; the clusters with the least summed log-likelihood stay, each
    pattern takes the nearest, and weights make the mean rate 1, of each partition or, if branches
    are `joint`, of all. rates: part_id, pattern_id, weight, rate, lnl; adds category, category_rate."""
    each = materialise(rates.groupBy("part_id", "rate").agg(F.sum("lnl").alias("lnl"), F.min("pattern_id").alias("first")), "distinct_rates")
    sums = each.join(islands(each.select("part_id", "rate"), tolerance), ["part_id", "rate"]).groupBy("part_id", "island")
    sums = sums.agg(F.sum("lnl").alias("lnl"), F.min_by("rate", "first").alias("cluster"))
    best = Window.partitionBy("part_id").orderBy("lnl", "cluster")
    sums = sums.withColumn("place", F.row_number().over(best)).where(F.col("place") <= categories)
    kept = sums.groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct("lnl", "cluster"))).alias("kept"))
    kept = broadcast_if_small(materialise(kept, "kept"))  # a row a partition
    joined = rates.join(kept, "part_id")
    near = F.array_min(F.transform("kept", lambda c: F.struct(F.abs(c["cluster"] - F.col("rate")).alias("away"), c["cluster"].alias("cluster"))))
    picked = joined.select("part_id", "pattern_id", "weight", "rate", "lnl", near["cluster"].alias("cluster"))
    sums = picked.groupBy("part_id").agg(F.sum(F.col("cluster") * F.col("weight")).alias("rate"), F.sum("weight").alias("w"))
    over = Window.partitionBy(F.lit(0)) if joint else Window.partitionBy("part_id")
    mean = sums.select("part_id", (F.sum("rate").over(over) / F.sum("w").over(over)).alias("mean"))
    out = picked.join(broadcast_if_small(materialise(mean, "mean")), "part_id").withColumn("category_rate", F.col("cluster") / F.col("mean"))
    number = kept.select("part_id", F.posexplode(F.array_sort(F.transform("kept", lambda c: c["cluster"]))).alias("category", "cluster"))
    return out.join(broadcast_if_small(number), ["part_id", "cluster"]).select("part_id", "pattern_id", "weight", "rate", "lnl", "category", "category_rate")
