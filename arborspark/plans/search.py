"""Tree search: prune-and-regraft moves as rows, scored in parallel, the best accepted."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.numerics import Mixture, Model, as_text, models_of
from arborspark.plans import blockwise
from arborspark.plans.blockwise import Case, smooth_cases
from arborspark.plans.evaluate import evaluate_trees, fit_anywhere, gathered
from arborspark.plans.insertion import LOCAL_BYTES, score_moves, vector_bytes
from arborspark.plans.likelihood import optimise_psr
from arborspark.plans.reports import mean_tree
from arborspark.sources.newick import Tree, neighbours, parse, regraft, tip_sets, write
from arborspark.sources.pattern_store import exists, latest_snapshot, snapshot
from arborspark.sources.tables import materialise


def moves(tree: Tree, n_tips: int, radius: int) -> Iterator[tuple[int, int, int, int]]:
    """(node, cut, a, b): the subtree behind node, cut off at its neighbour `cut`, is put into edge
    a-b, at most `radius` edges from where it stood."""
    near = neighbours(tree)
    for cut in (n for n in near if n >= n_tips):
        for node in near[cut]:
            sides = [x for x in near[cut] if x != node]
            for start, other in ((sides[0], sides[1]), (sides[1], sides[0])):
                queue = [(start, cut, 1)]
                while queue:
                    at, back, depth = queue.pop()
                    for c in near[at]:
                        if c != back:
                            yield node, cut, at, c
                            if depth < radius:
                                queue.append((c, at, depth + 1))


@dataclass
class Cycle:
    """What a cycle of moves gave: the best trees (lnl, tree), how many moves were scored, and by how much
    those that lose do so on the average."""

    best: list[tuple[float, Tree]]
    scored: int
    drop: float
    own: list[dict[int, Tree]] = field(default_factory=list)  #: the best trees with lengths for each partition


def with_lengths(tree: Tree, lengths: dict[tuple[int, int], float]) -> Tree:
    new = {frozenset(e): z for e, z in lengths.items()}
    return [(u, v, new.get(frozenset((u, v)), z)) for u, v, z in tree]


def spr_cycle(
    patterns: DataFrame, newick: str, models: dict[int, Model], names: list[str], radius: int, keep: int, constraint: frozenset[frozenset] = frozenset(), local: list | None = None,
    rounds: int = 4, cutoff: float = math.inf, start: float = -math.inf, own: dict[int, Tree] | None = None,
) -> Cycle:
    """The `keep` best neighbours of a tree, of different topologies. Moves are scored from the vectors of the
    tree (see score_moves) and kept as a table; the driver reads the best of them only. rounds: how often the
    three branches around a graft are optimised, 0 for a fast pass; over blocks of patterns this is done for the
    best moves alone. start: the tree's own log-likelihood, which drops are measured by. own: the tree with
    lengths for each partition."""
    tree, n = parse(newick, {x: i for i, x in enumerate(names)}, lengths=True), len(names)
    rows = materialise(score_moves(patterns, tree, models, n, radius, rounds, cutoff, local, constraint, own), "moves")
    lost = F.when(F.col("lnl") < start, start - F.col("lnl"))
    scored, drop = rows.agg(F.count("*"), F.avg(lost)).first()
    found: dict[frozenset, tuple[float, Tree, list, dict]] = {}
    for r in rows.orderBy(F.desc("lnl"), "node", "cut", "a", "b").limit(12 * keep).collect():  # one topology is reached by few moves
        node, cut, a, b = r["node"], r["cut"], r["a"], r["b"]
        new = with_lengths(regraft(tree, node, cut, a, b), {(cut, a): r["z_a"], (cut, b): r["z_b"], (cut, node): r["z_node"]})
        splits = frozenset(tip_sets(new, n))
        if len(found) < keep and splits not in found:
            found[splits] = r["lnl"], new, [(cut, x) for x in (node, a, b)], {p: regraft(t, node, cut, a, b) for p, t in (own or {}).items()}
    if own:
        return Cycle([(lnl, t) for lnl, t, _, _ in found.values()], scored, drop or 0.0, [t for *_, t in found.values()])
    if local is None and rounds and found:
        cases = smooth_cases(patterns, models, [Case(t, edges) for _, t, edges, _ in found.values()], rounds)
        return Cycle(sorted(((c.lnl, c.at(c.best)) for c in cases), key=lambda x: -x[0]), scored, drop or 0.0)
    return Cycle([(lnl, t) for lnl, t, _, _ in found.values()], scored, drop or 0.0)


def polished(trees: list[str], patterns: DataFrame, models: dict[int, Model], names: list[str]) -> list[tuple[float, str]]:
    """(lnl, newick) of trees with all branches optimised, best first; one row a tree."""
    rows = patterns.sparkSession.createDataFrame(list(enumerate(trees)), "tree_id long, newick string").repartition(max(1, len(trees)))
    found = evaluate_trees(rows, patterns, models, names, passes=4, lengths=True).collect()
    return sorted(((r["lnl"], r["newick"]) for r in found), key=lambda x: (-x[0], x[1]))


def relative_distance(a: str, b: str, names: list[str]) -> float:
    """Splits that two binary trees do not share, of all 2 (n - 3)."""
    tips = {n: i for i, n in enumerate(names)}
    x, y = (tip_sets(parse(t, tips), len(names)) for t in (a, b))
    return len(x ^ y) / max(1, 2 * (len(names) - 3))


def fitting(patterns: DataFrame, models: dict[int, Model]) -> list | None:
    """The alignment, if it is small and all vectors of a tree over it fit one task."""
    return gathered(patterns) if "rate" not in patterns.columns and vector_bytes(patterns, models) <= LOCAL_BYTES else None


def choose_radius(patterns: DataFrame, newick: str, models: dict[int, Model], names: list[str], most: int = 26) -> int:
    """The radius up to which farther moves still pay: 5, 10, 15, ... until the best move of a cycle is no better."""
    local, best, radius = fitting(patterns, models), float("-inf"), 5
    while radius <= most:
        top = spr_cycle(patterns, newick, models, names, radius, 1, local=local, rounds=0).best
        if not top or top[0][0] <= best + 1e-6:
            break
        best, radius = top[0][0], radius + 5
    return max(5, radius - 5)


FAST, THOROUGH, DONE = "fast", "thorough", "done"
STATE = "step int, phase string, radius int, cutoff double, lnl double, newick string, scored long, models string, lengths string, seconds double, options string"


@dataclass
class State:
    """Where a search stands after a step; `models` and the table of site rates belong to its tree."""

    phase: str
    radius: int
    cutoff: float
    lnl: float
    newick: str
    scored: int
    models: dict[int, Model | Mixture]
    own: dict[int, str] = field(default_factory=dict)  #: the tree with lengths of its own for each partition, if these have any
    seconds: float = 0.0  #: since the search began, without the time between an end and a restart


class Log:
    """The steps of a search, each kept as a snapshot if there is a folder: all steps so far, the models, the
    options and, where patterns have rates, a table of these. A snapshot counts once it is complete, and one
    that was written under other options is refused."""

    def __init__(self, spark: SparkSession, folder: str | None, options: dict):
        self.spark, self.folder, self.options, self.steps = spark, folder, json.dumps(options, sort_keys=True), []
        self.began = time.monotonic()

    def restore(self) -> str | None:
        """Read the latest complete snapshot; the path of its site rates, if it has any."""
        before = latest_snapshot(self.spark, self.folder) if self.folder else None
        if before is None:
            return None
        rows = before.orderBy("step").collect()
        if rows[-1]["options"] != self.options:
            raise ValueError(f"the search in {self.folder} was begun with other options: {rows[-1]['options']}")
        self.steps = [State(*(r[c] for c in ("phase", "radius", "cutoff", "lnl", "newick", "scored")), models_of(r["models"]), {int(p): t for p, t in json.loads(r["lengths"]).items()}, r["seconds"]) for r in rows]
        self.began -= self.steps[-1].seconds
        rates = f"{self.folder}/rates-{len(self.steps) - 1:06d}"
        return rates if exists(self.spark, f"{rates}/_SUCCESS") else None

    def take(self, state: State, rated: DataFrame | None = None) -> None:
        state.seconds = time.monotonic() - self.began
        self.steps.append(state)
        if self.folder:
            if rated is not None:  # written first: the snapshot makes it count
                rated.select("part_id", "pattern_id", "rate").write.mode("overwrite").parquet(f"{self.folder}/rates-{len(self.steps) - 1:06d}")
            rows = [(i, s.phase, s.radius, s.cutoff, s.lnl, s.newick, s.scored, as_text(s.models), json.dumps(s.own), s.seconds, self.options) for i, s in enumerate(self.steps)]
            snapshot(self.spark.createDataFrame(rows, STATE).coalesce(1), self.folder, len(self.steps) - 1)


def run_search(
    patterns: DataFrame, newick: str, models: dict[int, Model], names: list[str], radius: int = 5, most: int = 21, epsilon: float = 0.1, keep: int = 20,
    constraint: frozenset[frozenset] = frozenset(), fit_model: bool = False, stop_distance: float = 0.0, folder: str | None = None, steps: int | None = None, by_partition: bool = False,
) -> list[State]:
    """Hill climbing in phases. The fast phase scores moves at the lengths they have, does not follow a subtree
    beyond edges that lose more than such moves lost on the average in the cycle before, and optimises the best
    `keep`, three of them on all branches. Without gain the thorough phase takes over: the branches around
    every graft are optimised, and the radius grows by 5 up to `most`. fit_model: models (and site rates, where
    patterns have them) are fitted before the first cycle, between the phases and after the last; patterns
    with rates need a pattern_id. stop_distance: a phase ends when a cycle changes the tree by no more than
    this relative distance. folder: every step is stored, with models and rates, and a search
    begins where the last one ended; one of other options or another alignment is refused. steps: stop after so many.
    by_partition: each partition has branch lengths of its own; a state's tree then has their weighted means."""
    spark, rated = patterns.sparkSession, "rate" in patterns.columns
    size = patterns.agg(F.count("*"), F.sum("weight")).first()
    options = {"radius": radius, "most": most, "epsilon": epsilon, "keep": keep, "fit_model": fit_model, "stop_distance": stop_distance, "names": names, "patterns": list(size), "constraint": sorted(sorted(x) for x in constraint), "from": newick, "models": as_text(models), "by_partition": by_partition}
    log = Log(spark, folder, options)
    if rates := log.restore():
        patterns = patterns.drop("rate").join(spark.read.parquet(rates), ["part_id", "pattern_id"])
    local, tips = fitting(patterns, models), {n: i for i, n in enumerate(names)}
    shares = {r["part_id"]: r["w"] for r in patterns.groupBy("part_id").agg(F.sum("weight").alias("w")).collect()} if by_partition else {}
    read = lambda own: {p: parse(t, tips, lengths=True) for p, t in own.items()}

    def apart(trees: list[dict[int, Tree]], models: dict[int, Model | Mixture]) -> list[tuple[float, str, dict[int, str]]]:
        """(lnl, mean tree, trees by partition) of trees whose branches are optimised by partition, best first."""
        done = blockwise.smoothed_by_partition(patterns, models, trees)
        rows = [(sum(lnl.values()), write(mean_tree(own, shares), names), {p: write(t, names) for p, t in own.items()}) for lnl, own in done]
        return sorted(rows, key=lambda x: (-x[0], x[1]))

    def fitted(s: State) -> None:
        """The state's models, rates, branches and log-likelihood, better than they were or as they were."""
        nonlocal patterns
        tree = parse(s.newick, tips, lengths=True)
        if rated:
            patterns, _ = optimise_psr(patterns, tree, s.models)
        if by_partition:
            own, tree, lnl = blockwise.fit(patterns, read(s.own), s.models, alpha=not rated, branches=True, epsilon=epsilon)
        else:
            own, tree, lnl = fit_anywhere(patterns, local, s.models, tree, epsilon, alpha=not rated)
        if lnl > s.lnl and by_partition:
            s.models, s.newick, s.lnl, s.own = own, write(mean_tree(tree, shares), names), lnl, {p: write(t, names) for p, t in tree.items()}
        elif lnl > s.lnl:
            s.models, s.newick, s.lnl = own, write(tree, names), lnl

    def kept() -> DataFrame | None:
        return patterns if rated else None

    if not log.steps:
        if by_partition:
            [(lnl, text, own)] = apart([{p: parse(newick, tips, lengths=True) for p in shares}], models)
        else:
            [(lnl, text)], own = polished([newick], patterns, models, names), {}
        first = State(FAST, radius, abs(lnl) / 1000, lnl, text, 0, dict(models), own)
        if fit_model:
            fitted(first)
        log.take(first, kept())
    while log.steps[-1].phase != DONE and (steps is None or len(log.steps) < steps):
        s = replace(log.steps[-1])
        fast = s.phase == FAST
        cycle = spr_cycle(patterns, s.newick, s.models, names, s.radius, keep, constraint, local, 0 if fast else 4, s.cutoff if fast else math.inf, s.lnl, read(s.own))
        some = keep if fast else 3
        if by_partition:
            better = apart(cycle.own[:some], s.models) if cycle.own else []
        else:
            better = polished([write(t, names) for _, t in cycle.best[:some]], patterns, s.models, names) if cycle.best else []
        s.scored, s.cutoff = cycle.scored, cycle.drop or s.cutoff
        if better and better[0][0] > s.lnl + epsilon:
            near = relative_distance(better[0][1], s.newick, names) <= stop_distance
            s.lnl, s.newick = better[0][:2]
            s.own = better[0][2] if by_partition else {}
        else:
            near = True
        if near:
            if fast:
                s.phase = THOROUGH
            elif s.radius + 5 <= most:
                s.radius += 5
            else:
                s.phase = DONE
            if fit_model and s.phase != log.steps[-1].phase:
                fitted(s)
        log.take(s, kept())
    return log.steps


def search(patterns: DataFrame, newick: str, models: dict[int, Model], names: list[str], **options) -> list[tuple[float, str]]:
    """run_search; (lnl, newick) by step. `models` are replaced by those of the last step."""
    steps = run_search(patterns, newick, models, names, **options)
    models.update(steps[-1].models)
    return [(s.lnl, s.newick) for s in steps]
