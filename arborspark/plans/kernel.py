"""Felsenstein pruning over a block of site patterns, for any numbers of states and rates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from arborspark.functions.numerics import Z_MAX, Z_MIN, Model, length
from arborspark.sources.newick import Tree, neighbours

SCALE, LOG_SCALE = 2.0**256, 256 * math.log(2.0)
VECTOR_BYTES = 64 << 20  #: vectors of a tree that a task holds at once
Vector = tuple[np.ndarray, np.ndarray]  #: likelihoods (pattern, rate or 1, state) and how often each pattern was scaled up


def tip_vectors(codes: np.ndarray, states: int) -> np.ndarray:
    """0/1 likelihoods of the states of bit masks: pattern, 1, state."""
    return (codes[:, None, None] >> np.arange(states) & 1).astype(float)


def through(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Vectors (pattern, rate or 1, state) along a branch with transition matrices (rate, from, to)."""
    return np.matmul(x.transpose(1, 0, 2), p.transpose(0, 2, 1)).transpose(1, 0, 2)


def vectors_held(n_tips: int, every_edge: bool = True) -> int:
    """Vectors of a tree that live at once: three of each inner node if all edges are looked at; for one
    edge no more than the logarithm of the tips on either side, as the larger side of a node comes first."""
    return 3 * max(1, n_tips - 2) if every_edge else 2 * (max(2, n_tips).bit_length() + 1)


def patterns_at_once(n_tips: int, model: Model, every_edge: bool = True) -> int:
    """How many patterns keep a task's vectors within VECTOR_BYTES, whatever the tree and the model."""
    size = vectors_held(n_tips, every_edge) * len(model.rates) * model.states * 8 + 16 * n_tips
    return max(1, VECTOR_BYTES // size)


def rescaled(x: np.ndarray, scaled) -> Vector:
    """Vectors of which none is too small for a float, and how often each was scaled up."""
    small = np.abs(x).max(axis=(1, 2)) < 1 / SCALE
    x[small] *= SCALE
    return x, scaled + small


def joined(model: Model, ends: list[tuple[Vector, float]]) -> Vector:
    """The vectors at a node from those at the other ends of its branches (vector, z)."""
    out, scaled = 1.0, 0
    for (x, k), z in ends:
        out, scaled = out * through(x, model.transition(z)), scaled + k
    return rescaled(out, scaled)


def facing(model: Model, one: Vector, other: Vector) -> Vector:
    """What both ends of a branch have in common in the eigenvectors' space (pattern, rate, state), and the
    scaling: with it, another length of this branch takes one weighted sum."""
    (x, i), (y, j) = one, other
    _, left, right = model.spectrum()
    x = np.broadcast_to(x, (len(x), len(left), model.states)) * model.root
    y = np.broadcast_to(y, x.shape)
    return through(x, left.transpose(0, 2, 1)) * through(y, right), i + j


def along(model: Model, products: Vector, z: float, derivatives: bool = False):
    """Log-likelihood of each pattern at length z of the branch of `products`, with the first and second
    derivatives by t if asked."""
    x, scaled = products
    values = model.spectrum()[0]
    grown = np.exp(values * length(z))
    parts = [np.einsum("pks,ks->p", x, grown * values**d) for d in range(3 if derivatives else 1)]
    lnl = np.log(np.abs(parts[0])) - scaled * LOG_SCALE
    return (lnl, parts[1] / parts[0], parts[2] / parts[0] - (parts[1] / parts[0]) ** 2) if derivatives else lnl


class Block:
    """Patterns of one partition (codes: pattern by taxon) on one tree under one model. With `keep` off, vectors
    are dropped as soon as they were used: enough for one edge."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, model: Model, tree: Tree, keep: bool = True):
        self.codes, self.weights, self.model, self.keep = codes, weights, model, keep
        self.near = neighbours(tree)
        self.sizes: dict[tuple[int, int], int] = {}
        self.vectors: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.kinds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.products: tuple[tuple[int, int], np.ndarray, np.ndarray] | None = None

    def toward(self, node: int, parent: int) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods below node seen from parent, and how often each pattern was scaled up.
        Vectors are kept by direction and made in postorder, without recursion."""
        stack = [(node, parent)]
        while stack:
            n, p = stack[-1]
            if (n, p) in self.vectors:
                stack.pop()
                continue
            if n < self.codes.shape[1]:
                self.vectors[n, p] = tip_vectors(self.codes[:, n], self.model.states), np.zeros(len(self.codes), int)
                continue
            below = [(c, n) for c in self.near[n] if c != p]
            if missing := [b for b in below if b not in self.vectors and b[0] >= self.codes.shape[1]]:
                stack += sorted(missing, key=lambda b: self.size(*b))  # the larger side is worked on first
                continue
            out, scaled = 1.0, 0
            for c, _ in below:
                z = self.model.transition(self.near[n][c])
                if c < self.codes.shape[1]:
                    out = out * self.tip_through(c, z)
                    continue
                x, k = self.vectors[c, n] if self.keep else self.vectors.pop((c, n))
                out, scaled = out * through(x, z), scaled + k
            self.vectors[n, p] = rescaled(out, scaled)
        return self.vectors[node, parent]

    def size(self, node: int, parent: int) -> int:
        """Tips below node seen from parent; those of all nodes below are worked out with it."""
        if (node, parent) not in self.sizes:
            order = [(node, parent)]
            for n, p in order:
                order += [(c, n) for c in self.near[n] if c != p]
            for n, p in reversed(order):
                self.sizes[n, p] = sum(self.sizes[c, n] for c in self.near[n] if c != p) if n >= self.codes.shape[1] else 1
        return self.sizes[node, parent]

    def tip_through(self, tip: int, p: np.ndarray) -> np.ndarray:
        """A tip's vectors along a branch: worked out once for each code that occurs there."""
        if tip not in self.kinds:
            self.kinds[tip] = np.unique(self.codes[:, tip], return_inverse=True)
        codes, at = self.kinds[tip]
        return through(np.broadcast_to(tip_vectors(codes, self.model.states), (len(codes), len(p), self.model.states)), p)[at.ravel()]

    def edge_products(self, u: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """See `facing`; kept for the last edge."""
        if self.products is None or self.products[0] != (u, v):
            self.products = (u, v), *facing(self.model, self.toward(u, v), self.toward(v, u))
        return self.products[1:]

    def pattern_likelihoods(self, u: int, v: int, z: float | None = None, derivatives: bool = False):
        """Log-likelihood of each pattern at the edge u-v, with first and second derivatives by t if asked."""
        return along(self.model, self.edge_products(u, v), self.near[u][v] if z is None else z, derivatives)

    def lnl(self, u: int, v: int) -> float:
        return float(self.weights @ self.pattern_likelihoods(u, v))

    def slopes(self, u: int, v: int, z: float) -> tuple[float, float]:
        _, a, b = self.pattern_likelihoods(u, v, z, derivatives=True)
        return float(self.weights @ a), float(self.weights @ b)

    def set_length(self, u: int, v: int, z: float) -> None:
        """Change an edge and drop the vectors that hold it: those that look at it from elsewhere."""
        self.near[u][v] = self.near[v][u] = z
        if self.products and self.products[0] != (u, v):
            self.products = None
        behind = {u: self._side(u, v), v: self._side(v, u)}
        self.vectors = {(n, p): x for (n, p), x in self.vectors.items() if (n, p) in ((u, v), (v, u)) or not self._sees(n, p, u, v, behind)}

    def _side(self, node: int, other: int) -> dict[int, int]:
        """Nodes on node's side of the edge, each with its next step toward the edge."""
        step, queue = {node: other}, [node]
        for n in queue:
            for c in self.near[n]:
                if c not in step and not (n == node and c == other):
                    step[c] = n
                    queue.append(c)
        return step

    @staticmethod
    def _sees(n: int, p: int, u: int, v: int, behind: dict[int, dict[int, int]]) -> bool:
        side = behind[u] if n in behind[u] else behind[v]
        return n < 0 or (side[n] != p)


def root_edge(tree: Tree) -> tuple[int, int]:
    return next((u, v) for u, v, _ in tree if 0 in (u, v))


def tree_of(near: dict[int, dict[int, float]]) -> Tree:
    return sorted((u, v, z) for u, ends in near.items() for v, z in ends.items() if u < v)


def newton(z0: float, at: Callable[[float], tuple[float, float, float]], steps: int = 32) -> tuple[float, float]:
    """(z, lnl) of the best length of one branch near z0, never worse than z0; at(z) gives the log-likelihood
    and its derivatives by t."""
    best, z = (z0, -math.inf), z0
    for _ in range(steps):
        lnl, d1, d2 = at(z)
        if lnl > best[1]:
            best = z, lnl
        t = -math.log(z)
        new = t - d1 / d2 if d2 < 0 else (t * 2 if d1 > 0 else t / 2)
        new = min(max(math.exp(-min(max(new, t / 10), t * 10 + 0.01)), Z_MIN), Z_MAX)
        if abs(new - z) < 1e-9:
            break
        z = new
    return best


def optimise_edge(blocks: list[Block], u: int, v: int, steps: int = 32) -> float:
    """Newton's method for one branch over all partitions; never leaves the tree worse. Returns |change of z|."""
    z0 = blocks[0].near[u][v]
    z, _ = newton(z0, lambda z: summed([(b.weights, b.pattern_likelihoods(u, v, z, derivatives=True)) for b in blocks]), steps)
    for b in blocks:
        b.set_length(u, v, z)
    return abs(z - z0)


def summed(parts: list[tuple[np.ndarray, tuple[np.ndarray, ...]]]) -> tuple[float, ...]:
    """Sums over patterns by their weights."""
    return tuple(sum(float(w @ x[i]) for w, x in parts) for i in range(len(parts[0][1])))


def smooth(blocks: list[Block], passes: int = 8, tolerance: float = 1e-5) -> None:
    """Optimise every branch in turn until a whole pass changes none by more than the tolerance."""
    for _ in range(passes):
        edges = [(u, v) for u, v, _ in tree_of(blocks[0].near)]
        if max(optimise_edge(blocks, u, v) for u, v in edges) <= tolerance:
            break
