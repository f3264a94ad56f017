"""Small linear models, fitted on the driver on a bounded sample; all are deterministic."""

from __future__ import annotations

import numpy as np


def gram(x: np.ndarray, step: int = 256) -> np.ndarray:
    """Inner products of the rows of ``x`` plus 1 (the bias), in single precision; ``x`` may be of half precision and
    is widened by ``step`` rows at a time."""
    out = np.empty((len(x), len(x)), np.float32)
    for i in range(0, len(x), step):
        a = x[i : i + step].astype(np.float32)
        for j in range(0, i + 1, step):
            part = a @ x[j : j + step].astype(np.float32).T + 1
            out[i : i + step, j : j + step] = part
            out[j : j + step, i : i + step] = part.T
    return out


def linear_svm(products: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """How much each row adds to the weights of an L2-regularised squared-hinge SVM, by dual coordinate descent; y is
    -1 or 1 and ``products`` is the rows' ``gram``. The rarer class weighs as much as the other."""
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * cost)
    alpha, margin, diag = np.zeros(len(y)), np.zeros(len(y)), products.diagonal() + slack
    turns = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        most = 0.0
        for i in turns.permutation(len(y)):
            g = y[i] * margin[i] - 1 + alpha[i] * slack[i]
            if alpha[i] > 0 or g < 0:
                most = max(most, abs(g) if alpha[i] > 0 else -g)
                now = max(alpha[i] - g / diag[i], 0.0)
                margin += (now - alpha[i]) * y[i] * products[i]
                alpha[i] = now
        if most < tolerance:
            break
    return alpha * y


def weigh(x: np.ndarray, parts: np.ndarray, step: int = 256) -> np.ndarray:
    """Weights (bias last) from the share of each row of ``x``."""
    out = np.zeros(x.shape[1] + 1)
    for i in range(0, len(x), step):
        out[:-1] += parts[i : i + step].astype(np.float32) @ x[i : i + step].astype(np.float32)
    out[-1] = parts.sum()
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logistic_regression(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights (bias last) that minimise the mean log loss plus l2/2 * |w|**2, classes weighing the same.

    The weights are sums of rows, so the steps need the rows' ``gram`` alone.
    """
    products = gram(x)
    share = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    parts, move = np.zeros(len(x)), np.zeros(len(x))
    rate = 1 / (0.25 * float((share * products.diagonal()).sum()) + l2)  # bounds the curvature from above
    for k in range(steps):  # Nesterov's accelerated gradient
        ahead = parts + k / (k + 3) * move
        step = ahead - rate * (share * (logistic(products @ ahead.astype(np.float32)) - y) + l2 * ahead)
        move, parts = step - parts, step
    return weigh(x, parts)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that logistic(a * margin + b) is the probability of y = 1, by Newton steps on smoothed targets."""
    up, down = (y > 0.5).sum(), (y <= 0.5).sum()
    goal = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-9, float(np.abs(margin).max(initial=0)))
    m, a, b = margin / scale, 1.0, 0.0
    for _ in range(50):
        p = logistic(a * m + b)
        d, s = p - goal, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(h, [(d * m).sum() + 1e-6 * a, d.sum() + 1e-6 * b])
        move *= min(1.0, 5 / max(1e-9, float(np.abs(move).max())))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a, 0) / scale), float(b)
