"""A small linear model shared by the classifiers: standardised features, full-batch Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


#: weight of the squared coefficients in the loss
RIDGE = 1e-3


class Linear:
    """``sigmoid(((x - mean) / scale) @ w + b)``; constant features have no influence."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: float) -> None:
        self.mean, self.scale, self.w, self.b = mean, scale, w, b

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8.0, 8.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scaled(x) @ self.w + self.b)


def frame(mean: np.ndarray, spread: np.ndarray) -> Linear:
    """A model without weights yet, for rows of this mean and deviation."""
    return Linear(mean, np.where(spread > 1e-9, spread, 1e9), np.zeros(len(mean)), 0.0)


def fit(x: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], bias: float = 0.0,
        rounds: int = 400, rate: float = 0.05, ridge: float = RIDGE) -> Linear:
    """Minimise a loss whose gradient with respect to the margins is ``gradient(margins)``."""
    start = frame(x.mean(0), x.std(0))
    z = start.scaled(x)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = gradient(z @ w[:-1] + w[-1])
        full = np.append(z.T @ g + ridge * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Linear(start.mean, start.scale, w[:-1], float(w[-1]))
