"""The greatest values of many functions of one variable at once, each within its own limits.

All functions are asked for in lock-step: `asked()` names the places to be tried next, `take()` gets the
values. A bracket is looked for from the start outward; then parabolas through the best three places, or
golden sections where these do not help, close in (R. P. Brent, 1973). Functions that have converged wait.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WIDER = (1 + 5**0.5) / 2
SECTION = 2 - WIDER


class LockStep:
    """start, lo, hi, step: arrays, one entry a function. Results: `x` and `value`, the best place and what it
    gave; the start itself is tried first, so nothing gets worse."""

    def __init__(self, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray, tolerance: float = 1e-4, most: int = 60):
        start, lo, hi, step = np.broadcast_arrays(*(np.asarray(v, float) for v in (start, lo, hi, step)))
        self.lo, self.hi, self.tolerance, self.most = lo, hi, tolerance, most
        self.x = np.clip(start, lo, hi)
        self.value = np.full(self.x.shape, -np.inf)
        self.left, self.right = np.maximum(self.x - step, lo), np.minimum(self.x + step, hi)
        self.bracketed = np.zeros(self.x.shape, bool)
        self.done = lo >= hi
        self.second, self.third = self.x.copy(), self.x.copy()
        self.f_second, self.f_third = self.value.copy(), self.value.copy()
        self.last = self.before = self.planned = self.planned_before = np.zeros(self.x.shape)  #: the last moves and those before
        self.rounds = 0

    def asked(self) -> np.ndarray | None:
        """Places by function: three of each in the first round, one after; None when all have converged."""
        if self.rounds == 0:
            return np.stack([self.x, self.left, self.right])
        if self.done.all() or self.rounds >= self.most:
            return None
        return np.where(self.bracketed, self._closer(), self._farther())[None]

    def take(self, places: np.ndarray, values: np.ndarray) -> None:
        values = np.where(np.isfinite(values), values, -np.inf)
        if self.rounds == 0:
            self._first(values)
        else:
            self._next(places[0], values[0])
        self.rounds += 1

    def _first(self, values: np.ndarray) -> None:
        places = np.stack([self.x, self.left, self.right])
        order = np.argsort(-values, axis=0, kind="stable")  # the start wins a tie
        self.x, self.second, self.third = (np.take_along_axis(places, o[None], 0)[0] for o in order)
        self.value, self.f_second, self.f_third = (np.take_along_axis(values, o[None], 0)[0] for o in order)
        self.bracketed = order[0] == 0
        #: the direction that values grow in, where an end was best
        self.way = np.where(order[0] == 1, -1.0, 1.0)
        self.inner = places[0]

    def _farther(self) -> np.ndarray:
        """Beyond the best end, by a golden step; no farther than the limit."""
        return np.clip(self.x + self.way * np.maximum(WIDER * np.abs(self.x - self.inner), self.tolerance), self.lo, self.hi)

    def _closer(self) -> np.ndarray:
        x, w, v, fx, fw, fv = self.x, self.second, self.third, self.value, self.f_second, self.f_third
        with np.errstate(all="ignore"):
            r, q = (x - w) * (fv - fx), (x - v) * (fw - fx)
            top, bottom = (x - v) * q - (x - w) * r, 2 * (q - r)
            move = -top / bottom
        middle = (self.left + self.right) / 2
        useful = np.isfinite(move) & (np.abs(move) < np.abs(self.before) / 2) & (x + move > self.left) & (x + move < self.right)
        section = SECTION * np.where(x >= middle, self.left - x, self.right - x)
        self.planned_before = np.where(useful, self.last, np.where(x >= middle, self.left - x, self.right - x))
        move = np.where(useful, move, section)
        near_end = useful & ((x + move - self.left < 2 * self.tolerance) | (self.right - x - move < 2 * self.tolerance))
        move = np.where(near_end, np.copysign(self.tolerance, middle - x), move)
        self.planned = np.where(np.abs(move) >= self.tolerance, move, np.copysign(self.tolerance, move))
        return np.clip(x + self.planned, self.left, self.right)

    def _next(self, u: np.ndarray, fu: np.ndarray) -> None:
        live, inside = ~self.done, self.bracketed.copy()
        better = fu > self.value
        # outside: go on while it gets better; the limit, or a worse place, ends the bracket
        out = live & ~inside
        go = out & better
        at_limit = go & ((u <= self.lo) | (u >= self.hi))
        stop = out & ~better
        self.third, self.f_third = np.where(go, self.second, self.third), np.where(go, self.f_second, self.f_third)
        self.second, self.f_second = np.where(go, self.x, self.second), np.where(go, self.value, self.f_second)
        self.inner = np.where(go, self.x, self.inner)
        self.x, self.value = np.where(go, u, self.x), np.where(go, fu, self.value)
        closed = stop | at_limit
        far = np.where(stop, u, self.x)
        self.left = np.where(closed, np.minimum(self.inner, far), self.left)
        self.right = np.where(closed, np.maximum(self.inner, far), self.right)
        self.f_third = np.where(stop, fu, self.f_third)
        self.third = np.where(stop, u, self.third)
        self.bracketed = self.bracketed | closed
        wide = np.abs(self.right - self.left)
        self.last, self.before = np.where(closed, wide / 2, self.last), np.where(closed, wide, self.before)
        # inside: narrow the bracket around the better place
        mine = live & inside
        self.last, self.before = np.where(mine, self.planned, self.last), np.where(mine, self.planned_before, self.before)
        up = mine & (fu >= self.value)
        lower = u < self.x
        self.left = np.where(up & ~lower, self.x, np.where(mine & ~up & lower, u, self.left))
        self.right = np.where(up & lower, self.x, np.where(mine & ~up & ~lower, u, self.right))
        as_second = mine & ~up & ((fu >= self.f_second) | (self.second == self.x))
        as_third = mine & ~up & ~as_second & ((fu >= self.f_third) | (self.third == self.x) | (self.third == self.second))
        push = up | as_second
        self.third, self.f_third = np.where(push, self.second, np.where(as_third, u, self.third)), np.where(push, self.f_second, np.where(as_third, fu, self.f_third))
        self.second, self.f_second = np.where(up, self.x, np.where(as_second, u, self.second)), np.where(up, self.value, np.where(as_second, fu, self.f_second))
        self.x, self.value = np.where(up, u, self.x), np.where(up, fu, self.value)
        middle, half = (self.left + self.right) / 2, (self.right - self.left) / 2
        self.done = self.done | (self.bracketed & (np.abs(self.x - middle) <= 2 * self.tolerance - half))


def maximise(score: Callable[[np.ndarray, np.ndarray], np.ndarray], start, lo, hi, step, tolerance: float = 1e-4, most: int = 60) -> tuple[np.ndarray, np.ndarray, int]:
    """score(places, live): values of places (tries by functions); those of functions not `live` are not used. Gives
    the best places, their values and how often the score was asked for."""
    run = LockStep(np.atleast_1d(start), lo, hi, step, tolerance, most)
    while (places := run.asked()) is not None:
        run.take(places, score(places, ~run.done))
    return run.x, run.value, run.rounds
