"""Linear support vector machines on sparse rows, by dual coordinate descent, and a sigmoid fit of their margins."""

from __future__ import annotations

import numpy as np


def fit_hinge(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, cost: np.ndarray, width: int, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Weights that minimize |w|^2 / 2 + sum of cost_i * max(0, 1 - y_i w.x_i); row i is columns[starts[i]:starts[i + 1]].

    In each epoch every row's dual variable is moved, in random order, to its optimum in [0, cost_i].
    """
    w = np.zeros(width)
    rows = [(columns[a:b], values[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    square = [float(v @ v) for _, v in rows]
    alpha = np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)).tolist():
            if not square[i]:
                continue
            c, v = rows[i]
            old = alpha[i]
            new = min(max(old - (y[i] * float(w[c] @ v) - 1.0) / square[i], 0.0), cost[i])
            if new != old:
                w[c] += (new - old) * y[i] * v
                alpha[i] = new
                moved = max(moved, abs(new - old) / cost[i])
        if moved < 1e-3:
            break
    return w


def fit_sigmoid(margin: np.ndarray, positive: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a * margin + b))) fits the labels best, by Newton steps with a little damping."""
    a, b = 1.0, 0.0
    scale = max(1e-9, float(np.std(margin))) if len(margin) else 1.0
    x = margin / scale
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum(), (q * x).sum()], [(q * x).sum(), q.sum()]]) + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -2, 2), b - np.clip(d[1], -2, 2)
        if np.abs(d).max() < 1e-6:
            break
    return a / scale, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
