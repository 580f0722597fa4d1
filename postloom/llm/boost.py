"""Gradient-boosted trees for two classes, small enough to be learned from a bounded sample in numpy."""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Fewer than ``bins`` edges halfway between values: all of them if there are few values; else quantiles in which
    no value counts for more than one bin, so that rare values beside a frequent one are told apart."""
    values, counts = np.unique(x.astype(np.float64), return_counts=True)
    halfway = (values[1:] + values[:-1]) / 2
    if len(halfway) < bins:
        return halfway
    share = np.cumsum(np.minimum(counts, len(x) / bins))
    return halfway[np.unique(np.searchsorted(share[:-1] / share[-1], np.linspace(0, 1, bins + 1)[1:-1]).clip(max=len(halfway) - 1))]


class Booster:
    """Trees of fixed depth over binned features; logistic loss."""

    def __init__(self, edges: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float) -> None:
        self.edges, self.trees, self.base = edges, trees, base

    @staticmethod
    def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 40, depth: int = 5, rate: float = 0.25, bins: int = 32) -> Booster:
        n, d = x.shape
        w = np.ones(n) if weight is None else weight
        edges = [bin_edges(x[:, j], bins) for j in range(d)]
        b = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)], 1)
        mean = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        base = float(np.log(mean / (1 - mean)))
        score, trees, leaves = np.full(n, base), [], 2**depth
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(leaves - 1, np.int64), np.full(leaves - 1, bins, np.int64)
            for level in range(depth):
                m = 2**level
                best = np.zeros(m)
                total_g, total_h = np.bincount(node, g, m), np.bincount(node, h, m)
                own = total_g**2 / (total_h + 1)
                choice_f, choice_c = np.zeros(m, np.int64), np.full(m, bins, np.int64)
                for j in range(d):
                    key = node * bins + b[:, j]
                    left_g = np.bincount(key, g, m * bins).reshape(m, bins).cumsum(1)
                    left_h = np.bincount(key, h, m * bins).reshape(m, bins).cumsum(1)
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - own[:, None]
                    gain[(left_h < 1) | (right_h < 1)] = 0
                    c = gain.argmax(1)
                    top = gain[np.arange(m), c]
                    better = top > best + 1e-9
                    best[better], choice_f[better], choice_c[better] = top[better], j, c[better]
                at = slice(m - 1, 2 * m - 1)
                feature[at], cut[at] = choice_f, choice_c
                node = node * 2 + (b[np.arange(n), choice_f[node]] > choice_c[node])
            value = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            score += value[node]
            trees.append((feature, cut, value))
        return Booster(edges, trees, base)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        n = len(x)
        if not n:
            return np.zeros(0)
        d = len(self.edges)
        b = np.empty((n, d), np.uint8)
        for j, e in enumerate(self.edges):
            b[:, j] = np.searchsorted(e, x[:, j], side="right")
        flat, rows = b.ravel(), np.arange(n, dtype=np.int32) * d
        out = np.full(n, self.base, np.float32)
        for feature, cut, value in self.trees:
            at = np.zeros(n, np.int32)
            inner, feature, cut = len(feature), feature.astype(np.int32), cut.astype(np.uint8)
            level = 1
            while level <= inner:
                at = 2 * at + 1 + (flat[rows + feature[at]] > cut[at])
                level *= 2
            out += value[at - inner].astype(np.float32)
        return out
