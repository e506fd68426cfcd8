"""A small logistic regression that turns a few features into a probability."""

from __future__ import annotations

import math

import numpy as np


def fit(features: np.ndarray, label: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[list[float], list[float], list[float]]:
    """Newton steps on standardised features; (mean, scale, coefficients with the intercept last). Fit on nothing: even odds."""
    if not len(label):
        return [], [], [0.0]
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[(features - mean) / scale, np.ones(len(label))]
    penalty = np.diag([ridge] * features.shape[1] + [1e-3])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (label - p) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return mean.tolist(), scale.tolist(), beta.tolist()


def probability(model: tuple[list[float], list[float], list[float]], features: list[float]) -> float:
    mean, scale, beta = model
    z = beta[-1] + sum(b * (x - m) / s for x, m, s, b in zip(features, mean, scale, beta, strict=False)) if mean else beta[-1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
