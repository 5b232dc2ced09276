"""What the numpy models share."""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray, shift: bool) -> tuple[float, float]:
    """(scale, shift) of logits of least weighted log loss, pulled to 1 and 0; the scale is one over the temperature."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = sigmoid(a * logits + b)
        g = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        ga, ha = (g * logits).sum() + 0.5 * (a - 1), (h * logits * logits).sum() + 0.5
        a -= np.clip(ga / ha, -0.5, 0.5)
        if shift:
            gb, hb = g.sum() + 0.5 * b, h.sum() + 0.5
            b -= np.clip(gb / hb, -0.5, 0.5)
        a = max(a, 0.05)
    return float(a), float(b)
