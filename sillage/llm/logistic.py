"""Logistic regression on few features, for calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights, the constant first, by Newton's method with bounded steps; without both classes only the constant counts.

    A row of ``weight`` n counts as n rows.
    """
    n = np.ones(len(y)) if weight is None else weight
    x = np.column_stack((np.ones(len(y)), x))
    w = np.zeros(x.shape[1])
    w[0] = np.log(((n * y).sum() + 1) / ((n * (1 - y)).sum() + 1))
    if not len(y) or y.min() == y.max():
        return w
    mean = np.average(x, axis=0, weights=n)
    scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=n)), 1e-9)
    scale[0] = 1
    x = x / scale
    penalty = ridge * n.sum() * np.diag([0.01] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w = w + step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(w[0] + x @ w[1:])
