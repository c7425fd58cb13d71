"""Prune-and-regraft moves scored from the vectors of the tree as it stands.

A pass up and down the tree gives both vectors of every edge. When a subtree is cut off, the vectors
that look away from the cut stay as they are; those that look back are made on the way outward, one for
each edge. So a move costs one vector and a product of three, however many taxa there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions.numerics import Z_MAX, Z_MIN, Model
from arborspark.plans.kernel import VECTOR_BYTES, Block, Vector, along, facing, joined, newton, summed, vectors_held
from arborspark.plans.likelihood import blocks_of
from arborspark.sources.newick import Tree, neighbours, regraft, tip_sets, topology

LOCAL_BYTES = 4 * VECTOR_BYTES  #: vectors of a whole alignment that one task may hold
MOVE = "node int, cut int, a int, b int, depth int, lnl double, z_a double, z_b double, z_node double"
NAMES = ["node", "cut", "a", "b", "depth", "lnl", "z_a", "z_b", "z_node"]


@dataclass
class Graft:
    """A subtree put into the edge a-b: for each block the vectors at a, b and the subtree's end, and the lengths
    of the three branches that meet there. `tied`: all blocks have the same lengths."""

    blocks: list[Block]
    ends: list[list[Vector]]
    z: list[list[float]]
    tied: bool = True

    def groups(self) -> list[list[int]]:
        """Numbers of the blocks whose lengths are moved together."""
        every = range(len(self.blocks))
        return [list(every)] if self.tied else [[k] for k in every]

    def table(self, k: int, i: int) -> Vector:
        """What the branch to end i has in common with the two others joined, in a block."""
        model, ends = self.blocks[k].model, self.ends[k]
        return facing(model, joined(model, [(ends[o], self.z[k][o]) for o in range(3) if o != i]), ends[i])

    def lnl(self) -> float:
        return sum(float(b.weights @ along(b.model, self.table(k, 2), self.z[k][2])) for k, b in enumerate(self.blocks))

    def best_length(self, some: list[int], tables: list[Vector], z: float, steps: int = 8) -> tuple[float, float]:
        own = [self.blocks[k] for k in some]
        return newton(z, lambda x: summed([(b.weights, along(b.model, t, x, True)) for b, t in zip(own, tables)]), steps)

    def triangle(self, some: list[int]) -> None:
        """Start from the three distances between the ends, each at its best: they give the three branches."""
        t, z = {}, self.z[some[0]]
        for i, j in ((0, 1), (0, 2), (1, 2)):
            best, _ = self.best_length(some, [facing(self.blocks[k].model, self.ends[k][i], self.ends[k][j]) for k in some], z[i] * z[j])
            t[i, j] = -math.log(best)
        half = (t[0, 1] + t[0, 2] - t[1, 2]) / 2, (t[0, 1] + t[1, 2] - t[0, 2]) / 2, (t[0, 2] + t[1, 2] - t[0, 1]) / 2
        tried = [min(max(math.exp(-max(h, 0.0)), Z_MIN), Z_MAX) for h in half]
        own = Graft([self.blocks[k] for k in some], [self.ends[k] for k in some], [tried] * len(some))
        if own.lnl() > Graft(own.blocks, own.ends, [self.z[k] for k in some]).lnl():
            for k in some:
                self.z[k] = list(tried)

    def settle(self, rounds: int, tolerance: float = 1e-6) -> float:
        """The three branches moved in turn until a round gains little; the log-likelihood."""
        out = 0.0
        for some in self.groups():
            self.triangle(some)
            best = -math.inf
            for _ in range(rounds):
                before = best
                for i in range(3):
                    z, best = self.best_length(some, [self.table(k, i) for k in some], self.z[some[0]][i])
                    for k in some:
                        self.z[k][i] = z
                if best - before < tolerance:
                    break
            out += best
        return out


def prunings(tree: Tree, n_tips: int) -> list[tuple[int, int]]:
    """(node, cut): every subtree that can be cut off, at its neighbour `cut`; three for each inner node."""
    near = neighbours(tree)
    return [(node, cut) for cut in sorted(n for n in near if n >= n_tips) for node in sorted(near[cut])]


def grafts(blocks: list[Block], node: int, cut: int, radius: int, visit: Callable[[int, int, int, Graft], bool], tied: bool = True) -> None:
    """All edges within `radius` of the cut, outward; visit(a, b, depth, graft) says whether to go on beyond. Blocks
    have one topology, and one set of lengths if they are tied."""
    near, n_tips = blocks[0].near, blocks[0].codes.shape[1]
    p, q = (x for x in near[cut] if x != node)
    subtree = [b.toward(node, cut) for b in blocks]
    for start, other in ((p, q), (q, p)):
        stack = [(start, cut, [b.toward(other, cut) for b in blocks], [b.near[cut][p] * b.near[cut][q] for b in blocks], 1)]
        while stack:
            at, back, behind, back_z, depth = stack.pop()
            below = [c for c in near[at] if c != back] if at >= n_tips else []
            for c, sibling in zip(below, below[::-1]):
                here = [joined(b.model, [(x, z), (b.toward(sibling, at), b.near[at][sibling])]) for b, x, z in zip(blocks, behind, back_z)]
                lengths = [[math.sqrt(b.near[at][c]), math.sqrt(b.near[at][c]), b.near[cut][node]] for b in blocks]
                graft = Graft(blocks, [[x, b.toward(c, at), s] for b, x, s in zip(blocks, here, subtree)], lengths, tied)
                if visit(at, c, depth, graft) and depth < radius and c >= n_tips:
                    stack.append((c, at, here, [b.near[at][c] for b in blocks], depth + 1))


def allowed(wanted: frozenset[frozenset], tree: Tree, n_tips: int) -> Callable[[int, int, int, int], bool]:
    """Does a move keep every split of a constraint?"""
    return lambda node, cut, a, b: not wanted or wanted <= tip_sets(regraft(tree, node, cut, a, b), n_tips)


def vector_bytes(patterns: DataFrame, models: dict[int, Model]) -> int:
    """Bytes of all vectors of a tree over all patterns."""
    sizes = patterns.groupBy("part_id").agg(F.count("*").alias("n"), F.max(F.size("codes")).alias("taxa")).collect()
    return sum(r["n"] * vectors_held(r["taxa"]) * len(models[r["part_id"]].rates) * models[r["part_id"]].states * 8 for r in sizes if r["part_id"] in models)


def score_moves(patterns: DataFrame, tree: Tree, models: dict[int, Model], n_tips: int, radius: int, rounds: int = 0, cutoff: float = math.inf, local: list | None = None, constraint: frozenset[frozenset] = frozenset(), own: dict[int, Tree] | None = None) -> DataFrame:
    """Every move within the radius with its log-likelihood and the lengths of the three new branches.

    rounds 0: at the lengths that the halved edge and the subtree's branch have; else the three branches are
    optimised, from the distances between their ends. cutoff: beyond an edge that loses more than this, a
    subtree is not moved on. local: a gathered alignment whose vectors fit one task; subtrees are then dealt
    out over tasks. Else moves are scored over blocks of patterns: a task works on some patterns and on some
    subtrees, and shares of the log-likelihood are summed by move; there all edges within the radius are
    scored, at the lengths they have. own: the tree with lengths for each partition, which are then moved apart;
    the lengths given back are those of the first one. Moves are made in the tasks; the driver sends trees alone."""
    spark, cuts = patterns.sparkSession, prunings(tree, n_tips)
    fits = allowed(constraint, tree, n_tips)
    if local is not None:
        data = spark.sparkContext.broadcast(local)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks = [Block(c, w, models[p], own[p] if own else tree) for p, c, w in data.value if p in models]
            start = sum(b.lnl(*tree[0][:2]) for b in blocks)
            for m in batches:
                for i in m["id"]:
                    rows, (node, cut) = [], cuts[i]

                    def visit(a: int, b: int, depth: int, graft: Graft, rows=rows, node=node, cut=cut) -> bool:
                        if not fits(node, cut, a, b):
                            return True
                        lnl = graft.settle(rounds) if rounds else graft.lnl()
                        rows.append((node, cut, a, b, depth, lnl, *graft.z[0]))
                        return start - lnl <= cutoff

                    grafts(blocks, node, cut, radius, visit, own is None)
                    yield pd.DataFrame(rows, columns=NAMES)

        tasks = min(len(cuts), 4 * spark.sparkContext.defaultParallelism)
        return spark.range(0, len(cuts), 1, tasks).mapInPandas(run, MOVE)
    columns = [c for c in ("part_id", "weight", "codes", "rate") if c in patterns.columns]
    blocks = max(1, vector_bytes(patterns, models) // VECTOR_BYTES)
    lots = max(1, 2 * spark.sparkContext.defaultParallelism // blocks)
    rows = patterns.select(*columns)
    if lots > 1:  # few blocks: each is worked on by several tasks, with other subtrees
        rows = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        rows = rows.repartition(blocks * lots, "lot", "block").drop("block")

    def trees_of(b: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, Block]]:
        for p, g in b.groupby("part_id"):
            yield from blocks_of(g, own[int(p)] if own else tree, models)

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lot, part in b.groupby("lot") if "lot" in b else [(0, b)]:
                for _, _, block in trees_of(part.drop(columns="lot", errors="ignore")):
                    for node, cut in cuts[int(lot) :: lots]:
                        out: list[tuple] = []

                        def visit(a: int, b: int, depth: int, graft: Graft, out=out, node=node, cut=cut) -> bool:
                            if fits(node, cut, a, b):
                                out.append((node, cut, a, b, depth, graft.lnl(), *graft.z[0]))
                            return True

                        grafts([block], node, cut, radius, visit)
                        yield pd.DataFrame(out, columns=NAMES)

    return rows.mapInPandas(share, MOVE).groupBy(*NAMES[:5]).agg(F.sum("lnl").alias("lnl"), *(F.first(c).alias(c) for c in NAMES[6:]))


def with_topologies(moves: DataFrame, tree: Tree, n_tips: int) -> DataFrame:
    """Moves of a tree with the topology that each gives; several moves may give the same."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moves.schema) + ", topology string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m in batches:
            yield m.assign(topology=[topology(regraft(tree, *map(int, x)), n_tips) for x in zip(m["node"], m["cut"], m["a"], m["b"])])

    return moves.mapInPandas(run, schema)
