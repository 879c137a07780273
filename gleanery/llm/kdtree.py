"""A kd-tree over stable projections, fitted on a bounded sample and applied to any number of rows; and the chi-square
tests that tell when a search in it has seen enough.

The difference of two vectors at distance d, projected on a Gaussian direction, is d times a normal number. So over m
directions their squared projected distance is d * d times a chi-square number with m degrees of freedom, and the chance
that one of them lies in a box around the other is a product over the directions."""

from __future__ import annotations

import math

import numpy as np


def normal(x: np.ndarray) -> np.ndarray:
    """P(normal number <= x)."""
    erf = np.frompyfunc(math.erf, 1, 1)  # made here: it cannot travel to the workers
    return 0.5 * (1 + erf(np.clip(x, -40.0, 40.0) / math.sqrt(2)).astype(np.float64))


def chi_square(x: float, m: int) -> float:
    """P(chi-square number with ``m`` degrees of freedom, an even number, <= x)."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_reach(chance: float, m: int) -> float:
    """The x with P(chi-square number <= x) = ``chance``."""
    low, high = 0.0, 10.0 * m + 200
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < chance else (low, mid)
    return high


class KdTree:
    """``depth`` levels of splits of ``points`` (projections), hence 2**depth leaves.

    A node splits the axis of the widest spread near its median, at the emptiest place of a window that is the narrower
    the deeper the tree: dense groups are cut as little as leaves of at most ``uneven`` times the mean allow."""

    def __init__(self, points: np.ndarray, depth: int, uneven: float = 2.5):
        dims = points.shape[1]
        self.depth, self.dims = depth, dims
        self.axis = np.zeros(max(1, 2**depth - 1), dtype=np.int64)
        self.cut = np.zeros(max(1, 2**depth - 1))
        half = (uneven ** (1 / depth) - 1) / 2 if depth else 0.0
        inside = {0: points}
        for node in range(2**depth - 1):
            p = inside.pop(node)
            if len(p):
                axis = int(np.argmax(p.std(axis=0)))
                x = np.sort(p[:, axis])
                at = np.arange(int(len(x) * (0.5 - half)), min(int(len(x) * (0.5 + half)) + 1, len(x)))
                w = max(1, len(x) // 50)
                gap = x[np.minimum(at + w, len(x) - 1)] - x[np.maximum(at - w, 0)]
                self.axis[node], self.cut[node] = axis, x[at[int(np.argmax(gap))]]
            else:
                self.axis[node] = node % dims
            right = p[:, self.axis[node]] >= self.cut[node]
            inside[2 * node + 1], inside[2 * node + 2] = p[~right], p[right]

    def leaves(self, p: np.ndarray) -> np.ndarray:
        """The leaf of each row of projections."""
        node = np.zeros(len(p), dtype=np.int64)
        every = np.arange(len(p))
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[every, self.axis[node]] >= self.cut[node])
        return node - (2**self.depth - 1)

    def box(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest projections of a leaf, infinite where it is open."""
        low, high = np.full(self.dims, -np.inf), np.full(self.dims, np.inf)
        node = leaf + 2**self.depth - 1
        while node:
            up = (node - 1) // 2
            axis, cut = self.axis[up], self.cut[up]
            if node == 2 * up + 2:
                low[axis] = max(low[axis], cut)
            else:
                high[axis] = min(high[axis], cut)
            node = up
        return low, high


def inside(p: np.ndarray, low: np.ndarray, high: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The chance that a vector at ``distance`` from each row of projections lies in the box."""
    chance = np.ones(len(p))
    d = np.maximum(distance, 1e-12)
    for axis in np.flatnonzero(np.isfinite(low) | np.isfinite(high)):
        below = normal((high[axis] - p[:, axis]) / d) if np.isfinite(high[axis]) else 1.0
        chance *= below - (normal((low[axis] - p[:, axis]) / d) if np.isfinite(low[axis]) else 0.0)
    return chance
