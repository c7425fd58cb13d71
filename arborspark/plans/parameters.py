"""What of a model can be moved, and its optimisation for all partitions at once, wherever patterns are.

A score is any function of candidates: {part_id: [models]} to {part_id: [log-likelihoods]}. One that runs
over blocks is a Spark job; every round of a search over all partitions asks for it once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from arborspark.functions.brent import LockStep
from arborspark.functions.numerics import ALPHA_MAX, ALPHA_MIN, Mixture, Model

AnyModel = Model | Mixture
Score = Callable[[dict[int, list[AnyModel]]], dict[int, list[float]]]
RATE_MIN, RATE_MAX = 1e-4, 1e4
FLOOR = 0.001  #: least frequency of a state
TOLERANCE = 1e-4  #: of a parameter's logarithm


@dataclass
class Parameter:
    """A number of a model: read by `place`, put in by `make`, between lo and hi. `linked`: shared by partitions
    that are tied together."""

    place: Callable[[AnyModel], float]
    make: Callable[[AnyModel, float], AnyModel]
    lo: float
    hi: float
    step: float
    linked: bool = True


def at(values: tuple[float, ...], i: int, v: float) -> tuple[float, ...]:
    return (*values[:i], v, *values[i + 1 :])


def frequencies_with(model: Model, state: int, log_odds: float, floor: float = FLOOR) -> Model:
    """The model with another share of one state; all shares stay at the floor or above."""
    e = [f * math.exp(log_odds if i == state else 0.0) for i, f in enumerate(model.freqs)]
    return model.with_(freqs=tuple(floor + (1 - len(e) * floor) * y / sum(e) for y in e))


def exchange_rate(i: int) -> Parameter:
    return Parameter(lambda m: math.log(m.exchange[i]), lambda m, v: m.with_(exchange=at(m.exchange, i, math.exp(v))), math.log(RATE_MIN), math.log(RATE_MAX), 0.5)


def frequency(i: int) -> Parameter:
    return Parameter(lambda m: 0.0, lambda m, v: frequencies_with(m, i, v) if v else m, -2.0, 2.0, 0.25, linked=False)


def component_rate(i: int) -> Parameter:
    """A component's rate. All rates are scaled to a mean of 1 under the weights, so the others move as well."""
    return Parameter(lambda m: math.log(m.relative[i]), lambda m, v: m.with_(relative=at(m.relative, i, math.exp(v))), math.log(1e-3), math.log(1e3), 0.3)


def component_weight(i: int) -> Parameter:
    """A component's weight before weights are scaled to a sum of 1: any value leads to a point of the simplex."""
    return Parameter(lambda m: math.log(m.shares[i] / sum(m.shares)), lambda m, v: m.with_(shares=at(tuple(s / sum(m.shares) for s in m.shares), i, math.exp(v))), math.log(1e-4), math.log(1e3), 0.3)


SHAPE = Parameter(lambda m: math.log(m.alpha), lambda m, v: m.with_(alpha=math.exp(v)), math.log(ALPHA_MIN), math.log(ALPHA_MAX), 0.5)


def parameters(models: dict[int, AnyModel], alpha: bool, exchange: bool, freqs: bool) -> Iterator[tuple[Parameter, list[int]]]:
    """Parameters and the partitions that have them. Mixtures with a shape have that alone; others the rates
    and weights of their components, whose matrices stay as they are."""
    plain = {p: m for p, m in models.items() if isinstance(m, Model)}
    free = {p: m for p, m in models.items() if isinstance(m, Mixture) and m.alpha is None}
    for states in sorted({m.states for m in plain.values()}):
        own = [p for p, m in plain.items() if m.states == states]
        if exchange:
            yield from ((exchange_rate(i), own) for i in range(states * (states - 1) // 2 - 1))
        if freqs:
            yield from ((frequency(i), own) for i in range(states))
    if alpha:
        yield SHAPE, [p for p, m in models.items() if (m.alpha is not None if isinstance(m, Mixture) else m.categories > 1)]
        for i in range(max((m.categories for m in free.values()), default=0)):
            own = [p for p, m in free.items() if m.categories > i]
            yield component_rate(i), own
            yield component_weight(i), own


def optimise(score: Score, models: dict[int, AnyModel], parameter: Parameter, parts: list[int], links: dict[int, int] | None = None, tolerance: float = TOLERANCE) -> dict[int, AnyModel]:
    """One parameter of all given partitions, each by Brent's method, in lock-step: a round is one score of
    candidates, and converged partitions are left out of it. Partitions linked to one number share the value;
    the first one's is where they start, if that is better than what they have."""
    group = {p: (links or {}).get(p, -1 - p) if parameter.linked else -1 - p for p in parts}
    numbers = sorted(set(group.values()))
    index = {g: i for i, g in enumerate(numbers)}
    first = {g: next(p for p in parts if group[p] == g) for g in numbers}
    apart = {g for g in numbers if len({parameter.place(models[p]) for p in parts if group[p] == g}) > 1}
    run = LockStep(np.array([parameter.place(models[first[g]]) for g in numbers]), parameter.lo, parameter.hi, parameter.step, tolerance)
    begin = {p: models[p] for p in parts}
    before = {g: -math.inf for g in numbers}
    while (places := run.asked()) is not None:
        live = [p for p in parts if not run.done[index[group[p]]]]
        tried = {p: [parameter.make(begin[p], float(x)) for x in places[:, index[group[p]]]] for p in live}
        if run.rounds == 0:
            tried = {p: [*t, begin[p]] for p, t in tried.items()}
        lnl = score(tried)
        values = np.zeros(places.shape)
        for p in live:
            values[:, index[group[p]]] += lnl[p][: len(places)]
        if run.rounds == 0:
            before = {g: sum(lnl[p][-1] for p in live if group[p] == g) for g in numbers}
        run.take(places, values)
    out = dict(models)
    for p in parts:
        g = group[p]
        if run.value[index[g]] > before[g] or g in apart and links:
            out[p] = parameter.make(begin[p], float(run.x[index[g]]))
    return out


def total(score: Score, models: dict[int, AnyModel]) -> float:
    return sum(s[0] for s in score({p: [m] for p, m in models.items()}).values())


def cycles(score: Score, models: dict[int, AnyModel], alpha: bool = True, exchange: bool = True, freqs: bool = False, epsilon: float = 0.1, most: int = 10, links: dict[int, int] | None = None) -> tuple[dict[int, AnyModel], float]:
    """One parameter after the other, again and again until a cycle gains less than epsilon."""
    best = total(score, models)
    for _ in range(most):
        before = best
        for parameter, parts in parameters(models, alpha, exchange, freqs):
            if parts:
                models = optimise(score, models, parameter, parts, links)
        best = total(score, models)
        if best - before < epsilon:
            break
    return models, best
