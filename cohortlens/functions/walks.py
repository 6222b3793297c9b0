"""Walks of informative sites: the greatest descent of a walk and its exact chance."""

from __future__ import annotations

from functools import lru_cache
from math import lgamma, log

import numpy as np


@lru_cache(1 << 16)
def descent_chance(m: int, n: int, k: int) -> float:
    """The chance that a walk of ``m`` steps up and ``n`` down, in random order, somewhere
    falls by ``k`` or more below an earlier height. State: how many steps of the rarer kind
    are used, and how far the walk is below its highest; mass that reaches ``k`` is summed."""
    if k <= max(n - m, min(n, 1)):
        return 1.0
    if k > n:
        return 0.0
    rare = np.arange(min(m, n) + 1)
    mass, fallen = np.zeros((len(rare), k)), 0.0
    mass[0, 0] = 1.0
    for t in range(m + n):
        ups = rare if m <= n else t - rare
        up = mass * (np.maximum(m - ups, 0) / (m + n - t))[:, None]
        down = mass * (np.maximum(n - (t - ups), 0) / (m + n - t))[:, None]
        fallen += down[:, -1].sum()
        risen = np.pad(up[:, 1:], ((0, 0), (0, 1)))
        risen[:, 0] += up[:, 0]
        sunk = np.pad(down[:, :-1], ((0, 0), (1, 0)))
        few, many = (risen, sunk) if m <= n else (sunk, risen)
        mass = many
        mass[1:] += few[:-1]
    return float(min(1.0, fallen))


def least_chance(m: int, n: int, k: int) -> float:
    """Natural logarithm of a lower bound of ``descent_chance``: that the walk falls ``k``
    below its start, by reflection."""
    if k <= max(n - m, min(n, 1)):
        return 0.0
    return lgamma(m + 1) + lgamma(n + 1) - lgamma(m + k + 1) - lgamma(n - k + 1) if k <= n else -np.inf


def descents(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of steps (1, 0, -1): how many go up and down, the greatest descent and the
    greatest ascent."""
    height = np.cumsum(steps, axis=1, dtype=np.int32)
    high = np.maximum(np.maximum.accumulate(height, axis=1), 0)
    low = np.minimum(np.minimum.accumulate(height, axis=1), 0)
    return (steps > 0).sum(axis=1), (steps < 0).sum(axis=1), (high - height).max(axis=1, initial=0), (height - low).max(axis=1, initial=0)


def segment(steps: np.ndarray) -> tuple[int, int]:
    """First and last step of the leftmost greatest descent of one walk; of several heights
    it may start from, the last."""
    height = np.concatenate(([0], np.cumsum(steps)))
    end = int(np.argmax(np.maximum.accumulate(height) - height))
    start = int(np.flatnonzero(height[: end + 1] == height[: end + 1].max())[-1])
    return start, end - 1


def rank_of(p: float) -> float:
    """What chances are compared by: their common logarithm to nine decimals."""
    return round(log(p) / log(10), 9) if p > 0 else -np.inf


def best_of(tested: list[tuple[int, int, int, tuple]]) -> tuple[float, int]:
    """The smallest chance of ``(m, n, k, names)`` and where it is; of equal ones the first
    names. Cases whose lower bound is above the best so far are passed over."""
    cases: dict[tuple[int, int, int], int] = {}
    for i, (m, n, k, names) in enumerate(tested):
        if (m, n, k) not in cases or names < tested[cases[m, n, k]][3]:
            cases[m, n, k] = i
    best = None
    for bound, case in sorted((least_chance(*c), c) for c in cases):
        if best is not None and round(bound / log(10), 9) > best[0] + 1e-9:
            break
        p = descent_chance(*case)
        mine = (rank_of(p), tested[cases[case]][3], cases[case], p)
        best = mine if best is None or mine[:2] < best[:2] else best
    return best[3], best[2]
