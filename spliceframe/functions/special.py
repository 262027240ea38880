"""Digamma and log-gamma on arrays (asymptotic series after a shift)."""

from __future__ import annotations

import numpy as np


SHIFT = 8


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = -1 / x
    for i in range(1, SHIFT):
        out -= 1 / (x + i)
    x = x + SHIFT
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def gammaln(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shifted = x.copy()
    for i in range(1, SHIFT):
        shifted *= x + i
    x = x + SHIFT
    r = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x - np.log(shifted)
