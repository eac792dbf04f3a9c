"""Linear models fitted on bounded samples that are already on the driver."""

from __future__ import annotations

import numpy as np

#: One sample row: the indices of its features and their values.
SparseRow = tuple[np.ndarray, np.ndarray]


def fit_sparse(rows: list[SparseRow], y: np.ndarray, dimensions: int, loss: str = "logistic",
               weight: np.ndarray | None = None, l2: float = 1e-5, epochs: int = 12,
               rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by stochastic gradient steps with a rate per feature.

    ``y`` is 0 or 1; ``loss`` is ``hinge`` (a linear support vector machine)
    or ``logistic``. The order of the steps is fixed by ``seed``; the result
    is the mean over the last half of the epochs."""
    w, b = np.zeros(dimensions), 0.0
    g2, gb2 = np.full(dimensions, 1e-8), 1e-8
    mean_w, mean_b, taken = np.zeros(dimensions), 0.0, 0
    sign = 2.0 * np.asarray(y, float) - 1.0
    each = np.ones(len(rows)) if weight is None else np.asarray(weight, float)
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            m = sign[i] * (float(v @ w[at]) + b)
            if loss == "hinge":
                d = -sign[i] * each[i] if m < 1.0 else 0.0
            else:
                d = -sign[i] * each[i] / (1.0 + np.exp(min(m, 500.0)))
            g = d * v + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            gb2 += d * d
            b -= rate * d / np.sqrt(gb2)
        if 2 * epoch >= epochs - 1:
            mean_w += w
            mean_b += b
            taken += 1
    return mean_w / max(1, taken), mean_b / max(1, taken)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_lasso(x: np.ndarray, y: np.ndarray, l1: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights for the columns of ``x`` and a free
    intercept, by accelerated proximal gradient steps."""
    n, k = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    step = 4.0 * n / max(float(np.linalg.norm(a, 2)) ** 2, 1e-9)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        nxt = z - step * (a.T @ (sigmoid(a @ z) - y)) / n
        nxt[:k] = np.sign(nxt[:k]) * np.maximum(np.abs(nxt[:k]) - step * l1, 0.0)
        t2 = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        z = nxt + (t - 1.0) / t2 * (nxt - w)
        w, t = nxt, t2
    return w[:k], float(w[k])
