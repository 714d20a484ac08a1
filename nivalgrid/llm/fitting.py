"""Small fits on bounded training samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression by Newton steps; zeros without rows."""
    a = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, 1 + (x.shape[1] if x.ndim > 1 else 0)))
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(penalty) + 1e-9 * np.eye(len(w)), grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w


def score_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(w[0] + x @ w[1:])
