"""Model parameters: small partitions are fitted each in one task, large ones by sweeps over their blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions.numerics import Model
from arborspark.plans import blockwise, parameters
from arborspark.plans.blockwise import Case, smooth_cases, smoothed
from arborspark.plans.evaluate import gathered
from arborspark.plans.kernel import Block, root_edge
from arborspark.plans.likelihood import optimise_psr
from arborspark.plans.parameters import AnyModel
from arborspark.sources.newick import Tree

def fit(codes: np.ndarray, weights: np.ndarray, model: AnyModel, tree: Tree, alpha: bool, exchange: bool, freqs: bool, epsilon: float = 0.1, cycles: int = 10) -> tuple[AnyModel, float]:
    """The model of one partition on a fixed tree, in one task. A parameter is kept as it was where the search
    finds nothing better."""
    edge = root_edge(tree)
    score = lambda tried: {0: [Block(codes, weights, m, tree, keep=False).lnl(*edge) for m in tried[0]]} if tried else {}
    models, lnl = parameters.cycles(score, {0: model}, alpha, exchange, freqs, epsilon, cycles)
    return models[0], lnl


PARAMETERS = "part_id int, lnl double, alpha double, exchange array<double>, freqs array<double>"


def fit_models(patterns: DataFrame, tree: Tree, models: dict[int, Model], alpha: bool = True, exchange: bool = True, freqs: bool = False, epsilon: float = 0.1, links: dict[int, int] | None = None) -> DataFrame:
    """part_id, lnl, alpha, exchange, freqs of each partition on a fixed tree. Where all patterns are few,
    a partition is fitted in one task; else, and where partitions share parameters (links: part_id to
    group), all partitions are fitted at once by sweeps over the blocks."""
    if links or gathered(patterns) is None:
        fitted, _, _ = blockwise.fit(patterns, tree, models, alpha, exchange, freqs, epsilon=epsilon, links=links)
        lnl = blockwise.score_candidates(patterns, tree, {p: [m] for p, m in fitted.items()})
        return patterns.sparkSession.createDataFrame([(p, lnl[p][0], m.alpha, list(m.exchange), list(m.freqs)) for p, m in fitted.items()], PARAMETERS)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        part = int(g["part_id"].iloc[0])
        codes = np.stack(g["codes"].to_numpy()).astype(np.int64)
        model, lnl = fit(codes, g["weight"].to_numpy(), models[part], tree, alpha, exchange, freqs, epsilon)
        return pd.DataFrame([(part, lnl, model.alpha, list(model.exchange), list(model.freqs))], columns=["part_id", "lnl", "alpha", "exchange", "freqs"])

    return patterns.select("part_id", "weight", "codes").groupBy("part_id").applyInPandas(run, PARAMETERS)


def score_models(patterns: DataFrame, tree: Tree, candidates: dict[str, Model], empirical: dict[int, tuple[float, ...]]) -> DataFrame:
    """Every partition under every named model, with its own frequencies and the partition's:
    part_id, model, freq_mode, lnl, k, n. All candidates are scored in one pass over the blocks of
    patterns. choose_models picks."""
    rows = [(name, mode) for name in candidates for mode in ("fixed", "empirical")]
    each = {p: [candidates[name] if mode == "fixed" else candidates[name].with_(freqs=tuple(f)) for name, mode in rows] for p, f in empirical.items()}
    scores = blockwise.score_candidates(patterns, tree, each)
    sites = {r["part_id"]: r["n"] for r in patterns.groupBy("part_id").agg(F.sum("weight").alias("n")).collect()}
    parameters = lambda m, mode: len(tree) + (m.states - 1) * (mode == "empirical") + (m.categories > 1)
    out = [(p, name, mode, s[i], parameters(candidates[name], mode), int(sites[p])) for p, s in scores.items() if p in sites for i, (name, mode) in enumerate(rows)]
    return patterns.sparkSession.createDataFrame(out, "part_id int, model string, freq_mode string, lnl double, k int, n long")


@dataclass
class Choice:
    """Models, tree and log-likelihood after a choice, what was chosen (part_id to model and frequencies) and
    whether anything was."""

    models: dict[int, AnyModel]
    tree: Tree
    lnl: float
    chosen: dict[int, tuple[str, str]]
    taken: bool


CRITERIA = ("ml", "bic", "aic", "aicc")


def penalised(lnl: float, k: int, n: int, criterion: str) -> float:
    """What is to be greatest: the log-likelihood, or half an information criterion's negative."""
    if criterion not in CRITERIA:
        raise ValueError(f"no such criterion: {criterion!r}; there are {CRITERIA}")
    if criterion == "aicc":
        return lnl - k - k * (k + 1) / max(n - k - 1, 1e-9)
    return lnl - {"ml": 0.0, "bic": k * math.log(max(n, 1)) / 2, "aic": k}[criterion]


def auto_models(patterns: DataFrame, tree: Tree, models: dict[int, AnyModel], candidates: dict[str, Model], empirical: dict[int, tuple[float, ...]], criterion: str = "ml", rounds: int = 8) -> Choice:
    """The best of the named matrices, with its own or the partition's frequencies, for each partition of
    `empirical` (part_id to frequencies); other partitions keep their models.

    Branches are coupled with the choice: every candidate is given to all these partitions at once and all
    branches are smoothed under it, all candidates in the same sweeps. Each partition takes what served it best;
    then branches are smoothed under the models taken, and if the log-likelihood of the whole is below what
    it was, models and branches go back together."""
    sites = {r["part_id"]: int(r["n"]) for r in patterns.groupBy("part_id").agg(F.sum("weight").alias("n")).collect()}
    own = [p for p in empirical if p in sites]
    start = parameters.total(lambda c: blockwise.score_candidates(patterns, tree, c), {p: m for p, m in models.items() if p in sites})
    rows = [(name, mode) for name in sorted(candidates) for mode in ("fixed", "empirical")]

    def given(name: str, mode: str, p: int) -> Model:
        shape = {"alpha": models[p].alpha, "categories": models[p].categories} if isinstance(models[p], Model) else {}
        return candidates[name].with_(**shape, **({"freqs": tuple(empirical[p])} if mode == "empirical" else {}))

    edges = [(u, v) for u, v, _ in tree]
    cases = [Case(tree, edges, models={**models, **{p: given(*row, p) for p in own}}) for row in rows]
    smooth_cases(patterns, models, cases, rounds)
    chosen = {}
    for p in own:
        k = lambda row: len(edges) + (candidates[row[0]].states - 1) * (row[1] == "empirical") + (given(*row, p).categories > 1)  # noqa: E731, B023
        chosen[p] = max(range(len(rows)), key=lambda i: (penalised(cases[i].by_part[p], k(rows[i]), sites[p], criterion), -i))  # noqa: B023
    new = {**models, **{p: given(*rows[i], p) for p, i in chosen.items()}}
    [(lnl, better)] = smoothed(patterns, new, [tree])
    names = {p: rows[i] for p, i in chosen.items()}
    if criterion == "ml" and lnl < start:
        return Choice(models, tree, start, names, False)
    return Choice(new, better, lnl, names, True)


def optimise_all(patterns: DataFrame, tree: Tree, models: dict[int, AnyModel], candidates: dict[str, Model] | None = None, empirical: dict[int, tuple[float, ...]] | None = None, criterion: str = "ml", alpha: bool = True, exchange: bool | None = None, freqs: bool = False, epsilon: float = 0.1, cycles: int = 10, links: dict[int, int] | None = None) -> tuple[dict[int, AnyModel], Tree, float, DataFrame]:
    """Everything that a model has, in cycles until one gains less than epsilon: the choice among candidates for
    the partitions of `empirical`, parameters, branches, and, where patterns have a `rate`, the rates of
    sites. Gives models, tree, log-likelihood and the patterns with their rates."""
    rated, best = "rate" in patterns.columns, -math.inf
    for _ in range(cycles):
        before = best
        if candidates and empirical:
            choice = auto_models(patterns, tree, models, candidates, empirical, criterion)
            models, tree = choice.models, choice.tree
        if rated:
            patterns, _ = optimise_psr(patterns, tree, models)
        models, tree, best = blockwise.fit(patterns, tree, models, alpha and not rated, not candidates if exchange is None else exchange, freqs, branches=True, epsilon=math.inf, cycles=1, links=links)
        if best - before < epsilon:
            break
    return models, tree, best, patterns
