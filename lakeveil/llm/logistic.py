"""Small dense fits in numpy, on samples or counts whose size the callers bound."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Adam:
    """Adam steps over a list of arrays that are changed in place."""

    def __init__(self, parts: list[np.ndarray], rate: float):
        self.parts, self.rate, self.t = parts, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.parts, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit_sparse(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, width: int, steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with class-balanced weights over triples (row, column, value); weights and bias."""
    n, w, b = len(target), np.zeros(width), np.zeros(1)
    share = max(target.mean(), 1e-9), max(1 - target.mean(), 1e-9)
    weight = np.where(target > 0, 0.5 / share[0], 0.5 / share[1]) / max(n, 1)
    adam = Adam([w, b], rate)
    for _ in range(steps):
        z = np.bincount(row, value * w[column], n) + b[0]
        slope = weight * (sigmoid(z) - target)
        adam.step([np.bincount(column, value * slope[row], width) + decay * w, np.array([slope.sum()])])
    return w, float(b[0])


def platt(z: np.ndarray, target: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """a and b of the calibrated probability sigmoid(a * z + b), with Platt's smoothed targets. ``target`` says 0 or 1 of each of ``z``, or how many of
    both stand there (two columns)."""
    if not len(z):
        return 1.0, 0.0
    if target.ndim == 2:
        times, up, down = target.sum(axis=1), target[:, 1].sum(), target[:, 0].sum()
        goal = (target[:, 1] * (up + 1) / (up + 2) + target[:, 0] / (down + 2)) / times
        mean = (times * z).sum() / times.sum()
        scale = np.sqrt((times * (z - mean) ** 2).sum() / times.sum()) or 1.0
        share = times / times.sum()
    else:
        up, down = target.sum(), len(target) - target.sum()
        goal = np.where(target > 0, (up + 1) / (up + 2), 1 / (down + 2))
        mean, scale, share = z.mean(), z.std() or 1.0, 1 / len(z)
    part = [np.array([1.0, 0.0])]
    adam, x = Adam(part, 0.05), (z - mean) / scale
    for _ in range(steps):
        slope = (sigmoid(part[0][0] * x + part[0][1]) - goal) * share
        adam.step([np.array([(slope * x).sum(), slope.sum()])])
    a = max(part[0][0], 1e-3) / scale
    return float(a), float(part[0][1] - a * mean)
