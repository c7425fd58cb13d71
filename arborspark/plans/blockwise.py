"""Optimisation over alignments of any size: patterns stay in their blocks, the driver holds parameters.

A sweep is one Spark job: every block of patterns gives, for each case (a tree with the edges that are to
be moved, under models), its share of the log-likelihood and of the derivatives by the edges' lengths.
The shares are summed by case; the driver sees sums only and chooses the next parameters.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions.numerics import Z_MAX, Z_MIN
from arborspark.plans import parameters
from arborspark.plans.kernel import root_edge
from arborspark.plans.likelihood import blocks_of
from arborspark.plans.parameters import AnyModel
from arborspark.sources.newick import Tree

AT_ONCE = 16 << 20  #: bytes of cases that one sweep sends to every task
T_MIN, T_MAX = -math.log(Z_MAX), -math.log(Z_MIN)
Edge = tuple[int, int]


@dataclass
class Case:
    """A tree and the edges to be moved, with the best lengths found and the step tried from there. `parts`:
    the partitions that count (all, if None); `models`: its own, if it has any."""

    tree: Tree
    edges: list[Edge]
    parts: frozenset[int] | None = None
    models: dict[int, AnyModel] | None = None
    by_part: dict[int, float] = field(default_factory=dict)  #: log-likelihoods at the best lengths
    best: dict[Edge, float] = field(default_factory=dict)  #: lengths t
    lnl: float = -math.inf
    step: dict[Edge, float] = field(default_factory=dict)
    share: float = 1.0  #: of the step that is tried
    done: bool = False

    def __post_init__(self) -> None:
        lengths = {frozenset((u, v)): -math.log(z) for u, v, z in self.tree}
        self.best = {e: lengths[frozenset(e)] for e in self.edges}

    def tried(self) -> dict[Edge, float]:
        return {e: min(max(t + self.share * self.step.get(e, 0.0), T_MIN), T_MAX) for e, t in self.best.items()}

    def at(self, lengths: dict[Edge, float]) -> Tree:
        new = {frozenset(e): math.exp(-t) for e, t in lengths.items()}
        return [(u, v, new.get(frozenset((u, v)), z)) for u, v, z in self.tree]

    def take(self, by_part: dict[int, float], slopes: dict[Edge, tuple[float, float]], tolerance: float) -> None:
        """The sums of a sweep at the tried lengths: go on from there, or halve the step."""
        lnl = sum(by_part.values())
        if lnl < self.lnl:
            self.share /= 2
            self.done = self.share < 1e-3
            return
        gain, self.best, self.lnl, self.by_part = lnl - self.lnl, self.tried(), lnl, by_part
        self.step = {}
        for e, (d1, d2) in slopes.items():
            t = self.best[e]
            new = t - d1 / d2 if d2 < 0 else (2 * t if d1 > 0 else t / 2)
            self.step[e] = min(max(new, t / 10), 10 * t + 0.01) - t
        self.share = min(1.0, 2 * self.share)
        self.done = gain < tolerance


def in_lots(cases: list, limit: int = AT_ONCE) -> Iterator[list]:
    lot, size = [], 0
    for c in cases:
        n = len(pickle.dumps(c))
        if lot and size + n > limit:
            yield lot
            lot, size = [], 0
        lot.append(c)
        size += n
    if lot:
        yield lot


def sweep(patterns: DataFrame, models: dict[int, AnyModel], cases: dict[int, Case]) -> dict[int, tuple[dict[int, float], dict[Edge, tuple[float, float]]]]:
    """For each case, at the lengths it tries, the log-likelihood by partition and the derivatives by its
    edges' lengths. Cases of single partitions look at these alone, so a sweep moves all partitions."""
    out = {}
    for lot in in_lots([(i, c.at(c.tried()), c.edges, c.parts, c.models) for i, c in cases.items()]):

        def run(batches: Iterator[pd.DataFrame], lot=lot) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for number, tree, edges, parts, own in lot:
                    some = b if parts is None else b[b["part_id"].isin(parts)]
                    for part, g, block in blocks_of(some, tree, own or models):
                        w = g["weight"].to_numpy()
                        for u, v in edges:
                            rows.append((number, part, u, v, *(float(w @ y) for y in block.pattern_likelihoods(u, v, derivatives=True))))
                yield pd.DataFrame(rows, columns=["number", "part_id", "u", "v", "lnl", "d1", "d2"])

        columns = [c for c in ("part_id", "weight", "codes", "rate") if c in patterns.columns]
        sums = patterns.select(*columns).mapInPandas(run, "number int, part_id int, u int, v int, lnl double, d1 double, d2 double").groupBy("number", "part_id", "u", "v").agg(*(F.sum(c).alias(c) for c in ("lnl", "d1", "d2")))
        for r in sums.collect():
            by_part, slopes = out.setdefault(r["number"], ({}, defaultdict(lambda: (0.0, 0.0))))
            by_part[r["part_id"]] = r["lnl"]
            e = r["u"], r["v"]
            slopes[e] = slopes[e][0] + r["d1"], slopes[e][1] + r["d2"]
    return out


def smooth_cases(patterns: DataFrame, models: dict[int, AnyModel], cases: list[Case], rounds: int = 24, tolerance: float = 1e-3) -> list[Case]:
    """Move the lengths of all cases' edges at once, by Newton steps that are halved where they lose."""
    for _ in range(rounds):
        left = {i: c for i, c in enumerate(cases) if not c.done}
        if not left:
            break
        for i, (by_part, slopes) in sweep(patterns, models, left).items():
            cases[i].take(by_part, slopes, tolerance)
    return cases


def smoothed(patterns: DataFrame, models: dict[int, AnyModel], trees: list[Tree], rounds: int = 24) -> list[tuple[float, Tree]]:
    """Every tree with all its branches optimised: (lnl, tree)."""
    cases = smooth_cases(patterns, models, [Case(t, [(u, v) for u, v, _ in t]) for t in trees], rounds)
    return [(c.lnl, c.at(c.best)) for c in cases]


def smoothed_by_partition(patterns: DataFrame, models: dict[int, AnyModel], trees: list[dict[int, Tree]], rounds: int = 24) -> list[tuple[dict[int, float], dict[int, Tree]]]:
    """Every tree with branch lengths of its own for each partition (part_id to tree), all optimised in the same
    sweeps: log-likelihoods and trees by partition."""
    cases = [Case(t, [(u, v) for u, v, _ in t], frozenset([p])) for own in trees for p, t in own.items()]
    done = iter(smooth_cases(patterns, models, cases, rounds))
    out = []
    for own in trees:
        mine = {p: next(done) for p in own}
        out.append(({p: c.lnl for p, c in mine.items()}, {p: c.at(c.best) for p, c in mine.items()}))
    return out


def score_candidates(patterns: DataFrame, tree: Tree | dict[int, Tree], candidates: dict[int, list[AnyModel]]) -> dict[int, list[float]]:
    """The log-likelihood of each partition under each of its candidate models, in one pass over the patterns.
    tree: one, or one with lengths of its own for each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for part, g in b.groupby("part_id"):
                own = tree[int(part)] if isinstance(tree, dict) else tree
                for i, model in enumerate(candidates.get(int(part), ())):
                    rows += [(p, i, block.lnl(*root_edge(own))) for p, _, block in blocks_of(g, own, {int(part): model}, every_edge=False)]
            yield pd.DataFrame(rows, columns=["part_id", "number", "lnl"])

    columns = [c for c in ("part_id", "weight", "codes", "rate") if c in patterns.columns]
    sums = patterns.select(*columns).mapInPandas(run, "part_id int, number int, lnl double").groupBy("part_id", "number").agg(F.sum("lnl").alias("lnl"))
    out = {p: [-math.inf] * len(models) for p, models in candidates.items()}
    for r in sums.collect():
        out[r["part_id"]][r["number"]] = r["lnl"]
    return out


def fit(patterns: DataFrame, tree: Tree | dict[int, Tree], models: dict[int, AnyModel], alpha: bool = True, exchange: bool = True, freqs: bool = False, branches: bool = False, epsilon: float = 0.1, cycles: int = 10, links: dict[int, int] | None = None) -> tuple[dict[int, AnyModel], Tree | dict[int, Tree], float]:
    """Cycles over all parameters, and over the branches if asked, until one gains less than epsilon.
    tree: one, or one with lengths of its own for each partition. links: partitions that share exchange
    rates and shapes, or their mixtures' rates and weights."""
    score = lambda c: score_candidates(patterns, tree, c)
    best = parameters.total(score, models)
    for _ in range(cycles):
        before = best
        models, best = parameters.cycles(score, models, alpha, exchange, freqs, math.inf, 1, links)
        if branches and isinstance(tree, dict):
            [(lnl, new)] = smoothed_by_partition(patterns, models, [tree])
            after = sum(lnl.values())
        elif branches:
            [(after, new)] = smoothed(patterns, models, [tree])
        if branches and after > best:
            tree, best = new, after
        if best - before < epsilon:
            break
    return models, tree, best
