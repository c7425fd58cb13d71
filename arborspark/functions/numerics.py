"""Substitution models in NumPy: reversible rate matrices, discrete gamma rates, transition matrices."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np

Z_MIN, Z_MAX, Z_START = 1e-15, 1.0 - 1e-6, 0.9  #: branches are kept as z = exp(-t)
ALPHA_MIN, ALPHA_MAX = 0.02, 1000.0


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    b, d = x + 1 - a, 1.0 / (x + 1 - a)
    c, h = 1e300, d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1.0 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1.0 - front * h


def gamma_quantile(p: float, a: float) -> float:
    """x with lower_gamma(a, x) = p, by bisection on a growing bracket."""
    lo, hi = 0.0, max(1.0, a)
    while lower_gamma(a, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if lower_gamma(a, mid) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_rates(alpha: float, k: int = 4, median: bool = False) -> np.ndarray:
    """k equally likely rates of a gamma distribution with mean 1: the mean, or the median, of each quantile."""
    alpha = min(max(alpha, ALPHA_MIN), ALPHA_MAX)
    if median:
        r = np.array([gamma_quantile((2 * i + 1) / (2 * k), alpha) for i in range(k)])
    else:
        cuts = [gamma_quantile(i / k, alpha) for i in range(1, k)]
        share = np.array([0.0, *(lower_gamma(alpha + 1, c) for c in cuts), 1.0])
        r = np.diff(share)
    return r * k / r.sum()


@dataclass(frozen=True)
class Model:
    """A reversible model: exchange rates (upper triangle, row by row), frequencies, site rates."""

    freqs: tuple[float, ...]
    exchange: tuple[float, ...]
    alpha: float = 1.0
    categories: int = 4  #: 1: no variation between sites
    median: bool = False
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def states(self) -> int:
        return len(self.freqs)

    @property
    def rates(self) -> np.ndarray:
        if "rates" not in self.cache:
            self.cache["rates"] = gamma_rates(self.alpha, self.categories, self.median) if self.categories > 1 else np.ones(1)
        return self.cache["rates"]

    @property
    def root(self) -> np.ndarray:
        """Shares of states by rate category; they sum to 1 over all."""
        pi = np.array(self.freqs) / sum(self.freqs)
        return np.broadcast_to(pi / len(self.rates), (len(self.rates), self.states))

    def with_(self, **changes) -> "Model":
        return replace(self, cache={}, **changes)

    def eigen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues and the matrices with Q = left diag(values) right; Q has mean rate 1."""
        if "eigen" not in self.cache:
            pi, s = np.array(self.freqs) / sum(self.freqs), np.zeros((self.states,) * 2)
            s[np.triu_indices(self.states, 1)] = self.exchange
            q = (s + s.T) * pi
            np.fill_diagonal(q, 0)
            np.fill_diagonal(q, -q.sum(axis=1))
            q /= -(pi * np.diag(q)).sum()
            root = np.sqrt(pi)
            values, vectors = np.linalg.eigh(root[:, None] * q / root)
            self.cache["eigen"] = values, vectors / root[:, None], vectors.T * root
        return self.cache["eigen"]

    def spectrum(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By rate category: eigenvalues times rate, and the two matrices around them."""
        if "spectrum" not in self.cache:
            values, left, right = self.eigen()
            k = len(self.rates)
            self.cache["spectrum"] = self.rates[:, None] * values, np.broadcast_to(left, (k, *left.shape)), np.broadcast_to(right, (k, *right.shape))
        return self.cache["spectrum"]

    def transition(self, z: float, derivative: int = 0) -> np.ndarray:
        """P for each rate category at z = exp(-t), or its first or second derivative by t."""
        return transition(self.spectrum(), z, derivative)


def transition(spectrum: tuple[np.ndarray, np.ndarray, np.ndarray], z: float, derivative: int = 0) -> np.ndarray:
    values, left, right = spectrum
    return left * (values**derivative * np.exp(values * length(z)))[:, None, :] @ right


def length(z: float) -> float:
    """The branch length t of z = exp(-t), within its limits."""
    return -math.log(min(max(z, Z_MIN), Z_MAX))


@dataclass(frozen=True)
class Mixture:
    """Site categories with matrices of their own, as in mixtures of four amino-acid matrices: each
    component is a model without rate variation. Rates are scaled to a mean of 1 under the weights."""

    components: tuple[Model, ...]
    relative: tuple[float, ...]  #: rates before they are scaled
    shares: tuple[float, ...]  #: weights before they are scaled
    alpha: float | None = None  #: shape of the rates' distribution; None: rates and weights are free

    @classmethod
    def gamma(cls, components: tuple[Model, ...], alpha: float) -> "Mixture":
        """Equal weights and the rates of a discrete gamma distribution."""
        n = len(components)
        return cls(components, tuple(gamma_rates(alpha, n)), (1.0,) * n, alpha)

    @property
    def states(self) -> int:
        return self.components[0].states

    @property
    def categories(self) -> int:
        return len(self.components)

    @property
    def weights(self) -> np.ndarray:
        return np.array(self.shares) / sum(self.shares)

    @property
    def rates(self) -> np.ndarray:
        r = np.array(self.relative)
        return r / (self.weights @ r)

    @property
    def root(self) -> np.ndarray:
        return np.stack([w * c.root[0] for w, c in zip(self.weights, self.components)])

    def with_(self, **changes) -> "Mixture":
        """A changed mixture; another alpha changes the rates with it."""
        if changes.get("alpha") is not None:
            changes["relative"] = tuple(gamma_rates(changes["alpha"], len(self.components)))
        return replace(self, **changes)

    def spectrum(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, left, right = (np.stack(x) for x in zip(*(c.eigen() for c in self.components)))
        return self.rates[:, None] * values, left, right

    def transition(self, z: float, derivative: int = 0) -> np.ndarray:
        return transition(self.spectrum(), z, derivative)


def as_text(models: dict[int, "Model | Mixture"]) -> str:
    """Models as JSON; models_of reads them again, to the last bit."""

    def parts(m: Model | Mixture) -> dict:
        if isinstance(m, Mixture):
            return {"components": [parts(c) for c in m.components], "relative": list(map(float, m.relative)), "shares": list(map(float, m.shares)), "alpha": m.alpha}
        return {"freqs": list(map(float, m.freqs)), "exchange": list(map(float, m.exchange)), "alpha": float(m.alpha), "categories": m.categories, "median": m.median}

    return json.dumps({str(p): parts(m) for p, m in sorted(models.items())})


def models_of(text: str) -> dict[int, "Model | Mixture"]:
    def model(x: dict) -> Model | Mixture:
        if "components" in x:
            return Mixture(tuple(model(c) for c in x["components"]), tuple(x["relative"]), tuple(x["shares"]), x["alpha"])
        return Model(tuple(x["freqs"]), tuple(x["exchange"]), x["alpha"], x["categories"], x["median"])

    return {int(p): model(x) for p, x in json.loads(text).items()}


def equal_rates(states: int, **options) -> Model:
    return Model((1.0 / states,) * states, (1.0,) * (states * (states - 1) // 2), **options)


def read_exchange(text: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """A published amino-acid matrix in the usual text form, the lower triangle row by row and then 20
    frequencies: (exchange, scaled to a greatest rate of 10, and freqs). The tables themselves are not part of this package."""
    numbers = [float(x) for x in text.split()]
    if len(numbers) < 210:
        raise ValueError("190 exchange rates and 20 frequencies are needed")
    s = np.zeros((20, 20))
    s[np.tril_indices(20, -1)] = numbers[:190]
    exchange = (s + s.T)[np.triu_indices(20, 1)]
    return tuple(exchange * (10 / exchange.max())), tuple(numbers[190:210])


def read_models(folder: str, **options) -> dict[str, Model]:
    """The published matrices of a folder of text files by name, candidates for the choice of a model."""
    return {f.stem.upper(): Model(freqs, exchange, **options) for f in sorted(Path(folder).iterdir()) if f.is_file() for exchange, freqs in (read_exchange(f.read_text()),)}
