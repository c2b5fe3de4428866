"""Elastic-net solvers on a p x p Gram matrix, on the driver."""

from __future__ import annotations

import numpy as np


def _shrink(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def _factor(a: np.ndarray, rho: float = 1e-3) -> tuple[np.ndarray, float]:
    """Cholesky factor of a, with as much of a ridge as that takes: 0, rho, 10 rho, ... ."""
    try:
        return np.linalg.cholesky(a), 0.0
    except np.linalg.LinAlgError:
        pass
    for _ in range(20):
        try:
            return np.linalg.cholesky(a + rho * np.eye(len(a))), rho
        except np.linalg.LinAlgError:
            rho *= 10
    raise np.linalg.LinAlgError("not positive definite even with a ridge")


def _solve(l: np.ndarray, b: np.ndarray) -> np.ndarray:  # noqa: E741
    return np.linalg.solve(l.T, np.linalg.solve(l, b))


def admm(xx: np.ndarray, xy: np.ndarray, lam: float = 0.0, alpha: float = 0.5, iterations: int = 10_000, tolerance: float = 1e-9) -> np.ndarray:
    """argmin of b'xx b / 2 - xy'b + lam (alpha |b|_1 + (1 - alpha) |b|_2^2 / 2); the last coefficient isn't penalised.

    Without an L1 part it is one Cholesky solve; else ADMM with
    soft-thresholding, stopped when primal and dual residuals are small.
    """
    p = len(xy)
    ridge = np.full(p, lam * (1 - alpha))
    ridge[-1] = 0
    a = xx + np.diag(ridge)
    l1 = lam * alpha
    if l1 == 0:
        return _solve(_factor(a)[0], xy)
    rho = max(1e-3, float(np.trace(a)) / p)
    l = _factor(a + rho * np.eye(p))[0]  # noqa: E741
    z, u = np.zeros(p), np.zeros(p)
    for _ in range(iterations):
        b = _solve(l, xy + rho * (z - u))
        new = _shrink(b + u, l1 / rho)
        new[-1] = b[-1] + u[-1]
        u += b - new
        primal, dual = np.linalg.norm(b - new), rho * np.linalg.norm(new - z)
        z = new
        if primal <= tolerance * (1 + np.linalg.norm(z)) and dual <= tolerance * (1 + np.linalg.norm(u) * rho):
            break
    return z


def generalized_gradient(xx: np.ndarray, xy: np.ndarray, lam: float = 0.0, alpha: float = 0.5, iterations: int = 50_000, tolerance: float = 1e-12) -> np.ndarray:
    """The same minimum by proximal gradient steps with backtracking; needs no positive definite matrix."""
    p, step, b = len(xy), 1.0, np.zeros(len(xy))
    pen = np.full(p, lam)
    pen[-1] = 0

    def smooth(v: np.ndarray) -> float:
        return float(v @ xx @ v / 2 - xy @ v + (pen * (1 - alpha) * v * v).sum() / 2)

    for _ in range(iterations):
        g, f = xx @ b - xy + pen * (1 - alpha) * b, smooth(b)
        while True:
            v = b - step * g
            new = np.sign(v) * np.maximum(np.abs(v) - step * alpha * pen, 0)
            d = new - b
            if smooth(new) <= f + g @ d + d @ d / (2 * step) + 1e-15 * abs(f) or step < 1e-18:
                break
            step /= 2
        b = new
        if np.abs(d).max() <= tolerance * (1 + np.abs(b).max()):
            break
    return b


SOLVERS = {"ADMM": admm, "GenGradient": generalized_gradient}
