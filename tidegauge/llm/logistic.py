"""Logistic regression on a few inputs."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> tuple[float, ...]:
    """Slopes by Newton steps, with a small penalty that keeps them finite."""
    slopes = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ slopes, -30, 30)))
        gradient = x.T @ (y - p) - penalty * slopes
        curvature = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(slopes))
        step = np.linalg.solve(curvature, gradient)
        # A long step can overshoot where probabilities are near 0 or 1.
        slopes += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, slopes))
