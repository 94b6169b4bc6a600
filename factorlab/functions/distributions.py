"""Tail probabilities of the t and F distributions, on numpy arrays.

Small helpers for the batches that ``mapInPandas`` hands over; no statistics
package is required on the executors.
"""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_TINY = 1e-300


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_lgamma(a) + _lgamma(b) - _lgamma(a + b)).astype(float)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 / _nonzero(1.0 - (a + b) * x / (a + 1.0))
    result = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for term in (even, odd):
            d = 1.0 / _nonzero(1.0 + term * d)
            c = _nonzero(1.0 + term / c)
            step = c * d
            result = result * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return result


def _nonzero(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < _TINY, _TINY, v)


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), NaN where x is NaN."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    known = ~np.isnan(x) & (a > 0) & (b > 0)
    out[known & (x <= 0)] = 0.0
    out[known & (x >= 1)] = 1.0
    inner = known & (x > 0) & (x < 1)
    if inner.any():
        a, b, x = a[inner], b[inner], x[inner]
        flip = x > (a + 1.0) / (a + b + 2.0)
        p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - _log_beta(p, q)) / p
        part = front * _beta_fraction(p, q, z)
        out[inner] = np.where(flip, 1.0 - part, part)
    return out


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|), computed as a tail so that large t keeps its precision."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    return incomplete_beta(df / 2.0, np.full(t.shape, 0.5), df / (df + t * t))


def f_upper_tail(f, df1, df2) -> np.ndarray:
    """P(F > f)."""
    f, df1, df2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, df1, df2)))
    with np.errstate(divide="ignore", invalid="ignore"):
        x = df2 / (df2 + df1 * f)
    return incomplete_beta(df2 / 2.0, df1 / 2.0, x)


def f_critical(level, df1, df2) -> np.ndarray:
    """Value that F exceeds with probability ``level``, by bisection."""
    level, df1, df2 = np.broadcast_arrays(
        *(np.asarray(v, dtype=float) for v in (level, df1, df2))
    )
    low, high = np.zeros(level.shape), np.ones(level.shape)
    for _ in range(200):
        short = f_upper_tail(high, df1, df2) > level
        if not short.any():
            break
        high = np.where(short, high * 2.0, high)
    for _ in range(200):
        middle = 0.5 * (low + high)
        above = f_upper_tail(middle, df1, df2) > level
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.where((df1 > 0) & (df2 > 0), 0.5 * (low + high), np.nan)
