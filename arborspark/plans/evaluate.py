"""Trees and quartets with optimised branches.

Two ways to spread the work: over rows (trees, quartets), each done in one task against a broadcast
alignment whose size is checked; or over blocks of patterns, for alignments of any size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions.numerics import Model, as_text, models_of
from arborspark.plans.blockwise import fit, smoothed
from arborspark.plans.kernel import Block, root_edge, smooth, tree_of
from arborspark.plans.parameters import SHAPE, optimise
from arborspark.plans.parameters import cycles as fit_cycles
from arborspark.sources.newick import Tree, parse, write
from arborspark.sources.pattern_store import latest_snapshot, snapshot
from arborspark.sources.tables import materialise, new_table

BROADCAST_BYTES = 64 << 20  #: pattern tables up to this size are sent to every task
TREES_AT_ONCE, QUARTETS_AT_ONCE = 256, 2000
SHAPES = ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2))  #: the three topologies of four taxa


def gathered(patterns: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]] | None:
    """(part_id, codes, weights) of a pattern table no larger than BROADCAST_BYTES, None for a larger one."""
    size = patterns.agg(F.sum(8 * F.size("codes") + 16)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    rows = patterns.select("part_id", "weight", "codes").toPandas()
    return [(int(p), np.stack(g["codes"].to_numpy()).astype(np.int64), g["weight"].to_numpy()) for p, g in rows.groupby("part_id")]


def optimise_alpha(local: list, models: dict[int, Model], tree: Tree) -> dict[int, Model]:
    """The models with the best gamma shape that all partitions share."""

    def score(tried: dict[int, list[Model]]) -> dict[int, list[float]]:
        return {p: [Block(c, w, m, tree, keep=False).lnl(*root_edge(tree)) for m in tried[p]] for p, c, w in local if p in tried}

    own = {p: models[p] for p, _, _ in local}
    return optimise(score, own, SHAPE, list(own), {p: 0 for p in own})


def evaluate_trees(trees: DataFrame, patterns: DataFrame, models: dict[int, Model], names: list[str], passes: int = 8, shape: bool = False, lengths: bool = False) -> DataFrame:
    """Every tree with its branches (and, if asked, the gamma shape) optimised: tree_id, newick, lnl,
    alpha, length. Trees do not depend on each other. A small alignment goes to every task and trees are
    rows, spread over the cluster; a larger one stays in its blocks and all trees are moved at once."""
    tips, spark = {n: i for i, n in enumerate(names)}, trees.sparkSession
    if (local := gathered(patterns)) is None:
        return evaluate_in_blocks(trees, patterns, models, names, 4 * passes, shape, lengths)
    data = spark.sparkContext.broadcast(local)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tree_id, text in zip(b["tree_id"], b["newick"]):
                tree, alpha = parse(text, tips, lengths), float("nan")
                blocks = [Block(c, w, models[p], tree) for p, c, w in data.value]
                smooth(blocks, passes)
                if shape:
                    tree = tree_of(blocks[0].near)
                    own = optimise_alpha(data.value, models, tree)
                    alpha = next(iter(own.values())).alpha
                    blocks = [Block(c, w, own[p], tree) for p, c, w in data.value]
                    smooth(blocks, passes)
                tree = tree_of(blocks[0].near)
                lnl = sum(x.lnl(*root_edge(tree)) for x in blocks)
                rows.append((tree_id, write(tree, names), lnl, alpha, -sum(math.log(z) for _, _, z in tree)))
            yield pd.DataFrame(rows, columns=["tree_id", "newick", "lnl", "alpha", "length"])

    return trees.select("tree_id", "newick").mapInPandas(run, "tree_id long, newick string, lnl double, alpha double, length double")


def evaluate_in_blocks(trees: DataFrame, patterns: DataFrame, models: dict[int, Model], names: list[str], rounds: int, shape: bool, lengths: bool) -> DataFrame:
    """evaluate_trees over blocks of patterns. The driver holds a lot of TREES_AT_ONCE trees at a time; what a lot
    gives is added to one stored table."""
    spark, tips = trees.sparkSession, {n: i for i, n in enumerate(names)}
    path, schema = new_table(spark, "evaluated"), "tree_id long, newick string, lnl double, alpha double, length double"
    for lot in batched(trees.select("tree_id", "newick").toLocalIterator(), TREES_AT_ONCE):
        found, done = smoothed(patterns, models, [parse(r["newick"], tips, lengths) for r in lot], rounds), []
        for r, (lnl, tree) in zip(lot, found):
            alpha = float("nan")
            if shape:
                own, tree, lnl = fit(patterns, tree, models, exchange=False, branches=True, links={p: 0 for p in models})
                alpha = next(iter(own.values())).alpha
            done.append((r["tree_id"], write(tree, names), lnl, alpha, -sum(math.log(z) for _, _, z in tree)))
        spark.createDataFrame(done, schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def topologies(merged: list[tuple[int, np.ndarray, np.ndarray]], models: dict[int, Model], passes: int) -> Iterator[float]:
    """The log-likelihood of each topology of four taxa, whose merged patterns are given by partition."""
    for i, j, x, y in SHAPES:
        tree = [(4, i, 0.9), (4, j, 0.9), (5, x, 0.9), (5, y, 0.9), (4, 5, 0.9)]
        blocks = [Block(c, w, models[p], tree) for p, c, w in merged]
        smooth(blocks, passes, 1e-4)
        yield sum(z.lnl(4, 5) for z in blocks)


def score_quartets(quartets: DataFrame, patterns: DataFrame, models: dict[int, Model], passes: int = 4) -> DataFrame:
    """The three topologies of each quartet with optimised branches: t1..t4, topology, lnl. Patterns that
    agree on the four taxa are merged before they are scored: in the task of the quartet where the
    alignment is small, else in its blocks and then by a shuffle, for some quartets at a time."""
    if (local := gathered(patterns)) is None:
        return score_quartets_in_blocks(quartets, patterns, models, passes)
    data = quartets.sparkSession.sparkContext.broadcast(local)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for taxa in b[["t1", "t2", "t3", "t4"]].itertuples(index=False):
                merged = []
                for p, codes, w in data.value:
                    four, inverse = np.unique(codes[:, list(taxa)], axis=0, return_inverse=True)
                    merged.append((p, four, np.bincount(inverse.ravel(), w)))
                rows += [(*taxa, k, lnl) for k, lnl in enumerate(topologies(merged, models, passes))]
            yield pd.DataFrame(rows, columns=["t1", "t2", "t3", "t4", "topology", "lnl"])

    return quartets.mapInPandas(run, "t1 int, t2 int, t3 int, t4 int, topology int, lnl double")


def score_quartets_in_blocks(quartets: DataFrame, patterns: DataFrame, models: dict[int, Model], passes: int) -> DataFrame:
    names, out = ["t1", "t2", "t3", "t4"], []
    for lot in batched(quartets.select(*names).toLocalIterator(), QUARTETS_AT_ONCE):

        def merge(batches: Iterator[pd.DataFrame], lot=tuple(tuple(r) for r in lot)) -> Iterator[pd.DataFrame]:
            for b in batches:
                for part, g in b.groupby("part_id"):
                    codes, weights = np.stack(g["codes"].to_numpy()).astype(np.int64), g["weight"].to_numpy()
                    for taxa in lot:
                        four, inverse = np.unique(codes[:, list(taxa)], axis=0, return_inverse=True)
                        yield pd.DataFrame({**dict(zip(names, taxa)), "part_id": part, **{f"c{k}": four[:, k] for k in range(4)}, "w": np.bincount(inverse.ravel(), weights).astype(np.int64)})

        def score(g: pd.DataFrame) -> pd.DataFrame:
            merged = [(int(p), x[["c0", "c1", "c2", "c3"]].to_numpy(), x["w"].to_numpy()) for p, x in g.groupby("part_id")]
            taxa = tuple(g[names].iloc[0])
            return pd.DataFrame([(*taxa, k, lnl) for k, lnl in enumerate(topologies(merged, models, passes))], columns=[*names, "topology", "lnl"])

        kinds = ", ".join(f"{n} int" for n in names)
        four = patterns.select("part_id", "weight", "codes").mapInPandas(merge, f"{kinds}, part_id int, c0 long, c1 long, c2 long, c3 long, w long")
        four = four.groupBy(*names, "part_id", "c0", "c1", "c2", "c3").agg(F.sum("w").alias("w"))
        out.append(materialise(four.groupBy(*names).applyInPandas(score, f"{kinds}, topology int, lnl double"), "quartets"))
    return reduce(DataFrame.unionByName, out) if out else quartets.sparkSession.createDataFrame([], "t1 int, t2 int, t3 int, t4 int, topology int, lnl double")


def score_quartets_in_lots(quartets: DataFrame, patterns: DataFrame, models: dict[int, Model], folder: str, lots: int, passes: int = 4) -> DataFrame:
    """score_quartets, lot by lot by a hash of the taxa; each lot is stored under the folder and one that
    is complete there is not scored again, so a run that was stopped goes on."""
    spark, names = quartets.sparkSession, ["t1", "t2", "t3", "t4"]
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for lot in range(lots):
        path = f"{folder}/lot={lot}"
        done = files.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            some = quartets.where(F.pmod(F.xxhash64(*names), F.lit(lots)) == lot)
            score_quartets(some, patterns, models, passes).write.mode("overwrite").parquet(path)
    return spark.read.parquet(folder).drop("lot")


FITTED = "tree_id long, newick string, lnl double, length double, models string"


def fit_local(local: list, models: dict[int, Model], tree: Tree, passes: int, epsilon: float, cycles: int = 10) -> tuple[dict[int, Model], Tree, float]:
    """Models and branches of one tree over an alignment in this task, in turn until a cycle gains little."""
    models, best = {p: models[p] for p, _, _ in local}, -math.inf
    for _ in range(cycles):
        before = best

        def score(tried: dict[int, list[Model]], tree: Tree = tree) -> dict[int, list[float]]:
            return {p: [Block(c, w, m, tree, keep=False).lnl(*root_edge(tree)) for m in tried[p]] for p, c, w in local if p in tried}

        models, _ = fit_cycles(score, models, epsilon=math.inf, most=1)
        blocks = [Block(c, w, models[p], tree) for p, c, w in local]
        smooth(blocks, passes)
        tree = tree_of(blocks[0].near)
        best = sum(b.lnl(*root_edge(tree)) for b in blocks)
        if best - before < epsilon:
            break
    return models, tree, best


def fit_anywhere(patterns: DataFrame, local: list | None, models: dict[int, Model], tree: Tree, epsilon: float, alpha: bool = True) -> tuple[dict[int, Model], Tree, float]:
    """Models and branches of one tree: in one task where the alignment is small, else by sweeps over its blocks."""
    if local is None:
        return fit(patterns, tree, models, alpha, branches=True, epsilon=epsilon)
    spark = patterns.sparkSession
    data = spark.sparkContext.broadcast(local)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            own, new, lnl = fit_local(data.value, models, tree, 8, epsilon)
            yield pd.DataFrame([(as_text(own), [list(e) for e in new], lnl)], columns=["models", "tree", "lnl"])

    r = spark.range(0, 1, 1, 1).mapInPandas(run, "models string, tree array<array<double>>, lnl double").first()
    return {**models, **models_of(r["models"])}, [(int(u), int(v), z) for u, v, z in r["tree"]], r["lnl"]


def evaluate_with_models(trees: DataFrame, patterns: DataFrame, models: dict[int, Model], names: list[str], fast: bool = True, lengths: bool = False, epsilon: float = 0.1, passes: int = 8, folder: str | None = None) -> DataFrame:
    """Every tree with its branches optimised, under models that are carried over: tree_id, newick, lnl, length, models.

    The tree of the least tree_id has models and branches fitted. All others begin from its models and do not
    depend on each other; fast: their branches alone are optimised, else their models as well. A small
    alignment goes to every task and trees are rows; a larger one stays in its blocks. folder: the first
    tree's models are kept there, and a run that was stopped reads them instead of fitting again; a folder
    of other starting models or another first tree is refused."""
    spark, tips, columns = trees.sparkSession, {n: i for i, n in enumerate(names)}, [c.split()[0] for c in FITTED.split(", ")]
    begin = trees.select("tree_id", "newick").orderBy("tree_id").first()
    if begin is None:
        return spark.createDataFrame([], FITTED)
    asked = json.dumps([begin["newick"], as_text(models), names, epsilon], sort_keys=True)
    before = latest_snapshot(spark, folder) if folder else None
    if before is not None:
        row = before.first()
        if row["asked"] != asked:
            raise ValueError(f"what {folder} holds was begun from another tree or other models")
    else:
        own, tree, lnl = fit_anywhere(patterns, gathered(patterns), models, parse(begin["newick"], tips, lengths), epsilon)
        row = {"newick": write(tree, names), "lnl": lnl, "models": as_text(own)}
        if folder:
            snapshot(spark.createDataFrame([(asked, *row.values())], "asked string, newick string, lnl double, models string").coalesce(1), folder, 0)
    carried = models_of(row["models"])
    size = -sum(math.log(z) for _, _, z in parse(row["newick"], tips, lengths=True))
    first = spark.createDataFrame([(begin["tree_id"], row["newick"], row["lnl"], size, row["models"])], FITTED)
    rest = trees.where(F.col("tree_id") != begin["tree_id"]).select("tree_id", "newick")
    if fast:
        done = evaluate_trees(rest, patterns, carried, names, passes, lengths=lengths).withColumn("models", F.lit(row["models"]))
        return first.unionByName(done.select(*columns))
    if (local := gathered(patterns)) is not None:
        data = spark.sparkContext.broadcast(local)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for tree_id, text in zip(b["tree_id"], b["newick"]):
                    own, tree, lnl = fit_local(data.value, carried, parse(text, tips, lengths), passes, epsilon)
                    rows.append((tree_id, write(tree, names), lnl, -sum(math.log(z) for _, _, z in tree), as_text(own)))
                yield pd.DataFrame(rows, columns=columns)

        return first.unionByName(rest.mapInPandas(run, FITTED))
    path = new_table(spark, "fitted")
    first.coalesce(1).write.parquet(path)
    for r in rest.toLocalIterator():
        own, tree, lnl = fit(patterns, parse(r["newick"], tips, lengths), carried, branches=True, epsilon=epsilon)
        rows = [(r["tree_id"], write(tree, names), lnl, -sum(math.log(z) for _, _, z in tree), as_text(own))]
        spark.createDataFrame(rows, FITTED).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(FITTED).parquet(path)
