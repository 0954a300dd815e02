"""A small dense interior-point solve for one portfolio: utility with turnover cost, box and budget."""

from __future__ import annotations

import numpy as np

from panelwright.defaults import JITTER_SCALES, WEIGHT_CLIP


def regularized(sigma: np.ndarray) -> np.ndarray | None:
    """The matrix with the least diagonal jitter that makes it decomposable; None if indefinite."""
    mean = float(np.mean(np.diag(sigma)))
    for scale in JITTER_SCALES:
        candidate = sigma + scale * mean * np.eye(len(sigma))
        try:
            np.linalg.cholesky(candidate)
            return candidate
        except np.linalg.LinAlgError:
            continue
    return None


def box_problem(n: int, low: float, high: float) -> str | None:
    """Why no weights can satisfy the box and the budget, or None."""
    if not np.isfinite(high) or not 0.0 < high <= 1.0:
        return "w_max must be in (0, 1]"
    if high * n < 1.0:
        return "w_max too small for the budget"
    if not np.isfinite(low) or low < 0.0:
        return "min_weight must be >= 0"
    if low > high:
        return "min_weight exceeds w_max"
    if low * n > 1.0:
        return "min_weight too large for the budget"
    return None


def solve(
    mu: np.ndarray, sigma: np.ndarray, previous: np.ndarray | None, delta: float, cost: float, low: float, high: float
) -> np.ndarray | None:
    """Maximize ``mu'w - delta/2 w'Sw - cost |w - previous|_1`` with ``sum w = 1`` and ``low <= w <= high``.

    Primal-dual predictor-corrector; the turnover term enters through one bound variable per asset.
    Returns None if the iteration does not converge.
    """
    n = len(mu)
    if high * n <= 1.0 + 1e-12:
        return np.full(n, 1.0 / n)
    if low * n >= 1.0 - 1e-12:
        return np.full(n, 1.0 / n)
    eye, zero = np.eye(n), np.zeros((n, n))
    if previous is None or cost == 0.0:
        p, q = delta * sigma, -mu
        g, h = np.vstack([-eye, eye]), np.concatenate([np.full(n, -low), np.full(n, high)])
        a = np.ones((1, n))
    else:
        p = np.block([[delta * sigma, zero], [zero, zero]])
        q = np.concatenate([-mu, np.full(n, cost)])
        g = np.block([[-eye, zero], [eye, zero], [eye, -eye], [-eye, -eye]])
        h = np.concatenate([np.full(n, -low), np.full(n, high), previous, -previous])
        a = np.concatenate([np.ones(n), np.zeros(n)])[None, :]
    size, rows = len(q), len(h)
    x = np.full(size, 1.0 / n)
    if size > n:
        x[n:] = np.abs(x[:n] - previous) + 0.5
    y = np.zeros(1)
    s = np.maximum(h - g @ x, 1e-3)
    z = np.full(rows, max(1e-3, float(np.max(np.abs(q)))))
    scale = max(1.0, float(np.max(np.abs(p))), float(np.max(np.abs(q))))
    for _ in range(200):
        rd = p @ x + q + g.T @ z + a.T @ y
        rp, re = g @ x + s - h, a @ x - 1.0
        gap = float(s @ z) / rows
        if max(np.max(np.abs(rd)), np.max(np.abs(rp)), np.max(np.abs(re))) < 1e-12 * scale and gap < 1e-14:
            break
        weight = z / s
        kkt = np.block([[p + g.T @ (weight[:, None] * g), a.T], [a, np.zeros((1, 1))]])

        def step(rc: np.ndarray) -> tuple:
            right = np.concatenate([-rd - g.T @ ((z * rp - rc) / s), -re])
            try:
                d = np.linalg.solve(kkt, right)
            except np.linalg.LinAlgError:
                d = np.linalg.lstsq(kkt, right, rcond=None)[0]
            dx, dy = d[:size], d[size:]
            ds = -rp - g @ dx
            return dx, dy, ds, (-rc - z * ds) / s

        def longest(v: np.ndarray, dv: np.ndarray) -> float:
            shrink = dv < 0
            return min(1.0, float(np.min(-v[shrink] / dv[shrink]))) if shrink.any() else 1.0

        _, _, ds, dz = step(s * z)
        reach = min(longest(s, ds), longest(z, dz))
        centre = (float((s + reach * ds) @ (z + reach * dz)) / rows / max(gap, 1e-300)) ** 3
        dx, dy, ds, dz = step(s * z + ds * dz - centre * gap)
        if not np.all(np.isfinite(dx)):
            return None
        along = 0.99 * min(longest(s, ds), longest(z, dz)) if gap > 1e-14 else 1.0
        x, y, s, z = x + along * dx, y + along * dy, np.maximum(s + along * ds, 1e-300), np.maximum(z + along * dz, 1e-300)
    else:
        if gap > 1e-9 or np.max(np.abs(re)) > 1e-9:
            return None
    return x[:n]


def tidy(weights: np.ndarray) -> np.ndarray:
    """Weights below the clip become zero and the rest sums to one."""
    kept = np.where(weights < WEIGHT_CLIP, 0.0, weights)
    return kept / kept.sum()
