"""Results as tables: trees by partition, model parameters, search logs, good trees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborspark.functions.numerics import Model
from arborspark.operators.trees import ranked
from arborspark.plans.blockwise import smoothed_by_partition
from arborspark.sources.newick import Tree, write
from arborspark.sources.pattern_store import latest_snapshot


def partition_trees(patterns: DataFrame, tree: Tree, models: dict[int, Model], names: list[str], rounds: int = 24) -> DataFrame:
    """The topology with branch lengths of its own for each partition, all moved in the same sweeps: part_id,
    newick, lnl, length."""
    [(lnl, own)] = smoothed_by_partition(patterns, models, [{p: tree for p in sorted(models)}], rounds)
    rows = [(p, write(t, names), lnl[p], -sum(math.log(z) for _, _, z in t)) for p, t in own.items() if math.isfinite(lnl[p])]
    return patterns.sparkSession.createDataFrame(rows, "part_id int, newick string, lnl double, length double")


def mean_branches(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """u, v, length: branch lengths of several partitions (part_id, u, v, z), averaged by the partitions'
    shares of all weight (part_id, contribution)."""
    return edges.join(weights.select("part_id", "contribution"), "part_id").groupBy("u", "v").agg(F.sum(-F.log("z") * F.col("contribution")).alias("length"))


def mean_tree(own: dict[int, Tree], shares: dict[int, float]) -> Tree:
    """One tree with the mean lengths of the partitions' trees, by their shares of all weight."""
    total = sum(shares[p] for p in own)
    sums: dict[frozenset, float] = {}
    for p, tree in own.items():
        for u, v, z in tree:
            sums[frozenset((u, v))] = sums.get(frozenset((u, v)), 0.0) - math.log(z) * shares[p] / total
    return [(u, v, math.exp(-sums[frozenset((u, v))])) for u, v, _ in next(iter(own.values()))]


def parameter_report(spark: SparkSession, tree_id: int, tree: Tree, models: dict[int, Model]) -> DataFrame:
    """tree_id, part_id, parameter, value: shape, length of the tree, frequencies, exchange rates."""
    rows = []
    for p, m in sorted(models.items()):
        rows += [(tree_id, p, "length", -sum(math.log(z) for _, _, z in tree)), (tree_id, p, "alpha", m.alpha)]
        rows += [(tree_id, p, f"freq_{i}", float(f)) for i, f in enumerate(m.freqs)]
        rows += [(tree_id, p, f"rate_{i}_{j}", r) for i, j, r in exchange_rows(m)]
    return spark.createDataFrame(rows, "tree_id long, part_id int, parameter string, value double")


def exchange_rows(model: Model) -> list[tuple[int, int, float]]:
    """(from, to, rate) above the diagonal, row by row: the matrix of any number of states."""
    return [(int(i), int(j), float(r)) for i, j, r in zip(*np.triu_indices(model.states, 1), model.exchange)]


def search_log(spark: SparkSession, steps: list[tuple[float, str]]) -> DataFrame:
    """step, lnl, newick of a search that stored nothing."""
    return spark.createDataFrame([(i, lnl, text) for i, (lnl, text) in enumerate(steps)], "step int, lnl double, newick string")


def stored_search_log(spark: SparkSession, folder: str) -> DataFrame:
    """The steps of a search that stores them in `folder`, also while it runs: step, phase, radius, cutoff, lnl, gain
    (over the step before), scored (moves), seconds (since the search began), newick."""
    steps = latest_snapshot(spark, folder)
    if steps is None:
        raise ValueError(f"{folder} holds no complete snapshot")
    gain = F.col("lnl") - F.lag("lnl").over(Window.orderBy("step"))  # a row a step: few
    return steps.select("step", "phase", "radius", "cutoff", "lnl", gain.alias("gain"), "scored", "seconds", "newick").orderBy("step")


def write_good_trees(scored: DataFrame, k: int, path: str) -> None:
    """The k best topologies (topology, lnl) with their ranks, as one file in the order of rank."""
    ranked(scored, k).coalesce(1).sortWithinPartitions("rank").write.mode("errorifexists").parquet(path)


def write_result(newick: DataFrame, path: str) -> None:
    """Trees (tree_id, newick) as text in the order of tree_id, a tree a line; never over an old result."""
    newick.orderBy("tree_id").select("newick").write.mode("errorifexists").text(path)
