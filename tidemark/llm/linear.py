"""Small logistic fits on bounded samples."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e^-x), without overflow."""
    return np.exp(-np.logaddexp(0.0, -x))


def fit_logistic(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; ``rows`` carry their own constant column, if any."""
    w = np.zeros(rows.shape[1])
    hold = ridge * np.eye(len(w))
    for _ in range(rounds):
        p = logistic(rows @ w)
        slope = rows.T @ (weight * (p - target)) + ridge * w
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + hold
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max(initial=0)
        w -= step if size < 5 else step * (5 / size)
        if size < 1e-8:
            break
    return w


def best_threshold(score: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
    """The cut that makes F1 of class 1 largest on weighted rows, midway between two scores."""
    order = np.argsort(-score, kind="stable")
    s, hit, w = score[order], target[order] == 1, weight[order]
    right, taken = np.cumsum(w * hit), np.cumsum(w)
    f1 = 2 * right / (taken + (w * hit).sum())
    last = np.append(s[:-1] != s[1:], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 1.0)) / 2)
