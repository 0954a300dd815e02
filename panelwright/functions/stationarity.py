"""Augmented Dickey-Fuller test (constant only, AIC lag) from cross-product moments."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# MacKinnon (1994) response surface for one series with a constant.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def default_max_lag(n: int) -> int:
    return max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def lag_design(z: np.ndarray, lags: int) -> np.ndarray:
    """Rows ``[z_{t-1}, dz_{t-1}.. dz_{t-lags}, 1, dz_t]`` for every t with all lags present."""
    dz = np.diff(z)
    n = len(dz) - lags
    if n <= 0:
        return np.zeros((0, lags + 3))
    columns = [z[lags : lags + n]] + [dz[lags - k : lags - k + n] for k in range(1, lags + 1)]
    return np.column_stack([*columns, np.ones(n), dz[lags:]])


def _fit(gram: np.ndarray, used: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    a, b = gram[np.ix_(used, used)], gram[used, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    inverse = np.linalg.pinv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ b
    return beta, inverse, max(float(gram[-1, -1] - b @ beta), 0.0)


def nested_ssr(gram: np.ndarray, lags: int) -> np.ndarray | None:
    """Residual sums of the regressions on constant, level and the first 0..lags differences, from one factorization.

    With the columns in that order each further one lowers the sum by the square of its entry in the solved
    triangle. None where the columns are too close to dependent for that.
    """
    order = [lags + 1, 0, *range(1, lags + 1)]
    a, b = gram[np.ix_(order, order)], gram[order, -1]
    scale = np.sqrt(np.diag(a))
    if not (scale > 0).all():
        return None
    try:
        lower = np.linalg.cholesky(a / np.outer(scale, scale))
    except np.linalg.LinAlgError:
        return None
    if np.diag(lower).min() < 1e-6:
        return None
    drops = np.linalg.solve(lower, b / scale) ** 2
    return np.maximum(gram[-1, -1] - np.cumsum(drops)[1:], 0.0)


def p_value(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    terms = SMALL_P if tau <= TAU_STAR else LARGE_P
    return NormalDist().cdf(sum(c * tau**i for i, c in enumerate(terms)))


def adf_from_moments(gram: np.ndarray, n: int, head: np.ndarray, lags: int) -> float:
    """p-value given the moments of the full-lag sample and the first ``lags + 1`` values of the series.

    The lag is chosen on the common sample; the test itself uses the longer sample of the chosen lag,
    whose extra leading rows come from ``head``.
    """
    const = lags + 1
    best, sums = None, nested_ssr(gram, lags)
    for p in range(lags + 1):
        used = [0, *range(1, p + 1), const]
        ssr = _fit(gram, used)[2] if sums is None else float(sums[p])
        aic = n * math.log(max(ssr, 1e-300) / n) + 2 * len(used)
        if best is None or aic < best[0]:
            best = (aic, p)
    p = best[1]
    used = [0, *range(1, p + 1), const]
    extra = lag_design(head, p)
    columns = [0, *range(1, p + 1), p + 1, p + 2]
    full = gram[np.ix_([*used, lags + 2], [*used, lags + 2])] + extra[:, columns].T @ extra[:, columns]
    beta, inverse, ssr = _fit(full, list(range(len(used))))
    freedom = n + len(extra) - len(used)
    error = math.sqrt(ssr / freedom * inverse[0, 0]) if freedom > 0 else 0.0
    if error == 0.0:
        return 0.0 if beta[0] < 0 else 1.0
    return p_value(float(beta[0]) / error)
