"""Driver-side maths on per-column sized inputs: chi-square law, small matrices."""

from __future__ import annotations

import math

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return max(0.0, 1.0 - front * h)


def chi2_sf(x: float, dof: int) -> float:
    """P(chi-square with `dof` degrees > x)."""
    return 1.0 - gamma_p(dof / 2.0, x / 2.0)


def chi2_quantile(q: float, dof: int) -> float:
    """Inverse distribution function by bisection."""
    low, high = 0.0, 1.0
    while gamma_p(dof / 2.0, high / 2.0) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if gamma_p(dof / 2.0, mid / 2.0) < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def inverse_or_none(matrix: np.ndarray) -> np.ndarray | None:
    """Inverse of a p x p matrix, or None when it is singular."""
    if not np.all(np.isfinite(matrix)) or np.linalg.cond(matrix) > 1e12:
        return None
    return np.linalg.inv(matrix)


def variance_inflation(matrix: np.ndarray, tolerance: float = 1e-10) -> list[float]:
    """1 / (1 - R²) of every column against the others, from a correlation matrix.

    The matrix' null space holds the exact dependences: columns with a part in it are
    infinite. The others keep their value in the pseudo-inverse, as the dependent columns
    span the same space with or without one of them.
    """
    values, vectors = np.linalg.eigh(np.asarray(matrix, float))
    null = values <= tolerance * max(1.0, values[-1])
    share = (vectors[:, null] ** 2).sum(axis=1)
    inverse = (vectors[:, ~null] ** 2 / values[~null]).sum(axis=1)
    return [float("inf") if s > 1e-8 else float(v) for s, v in zip(share, inverse)]
