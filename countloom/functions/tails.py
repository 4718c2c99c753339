"""Tail probabilities in NumPy: Student's t, normal and hypergeometric."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def _log_gamma(x):
    """log Gamma of positive values: Stirling's series from 10 on, the recurrence below."""
    x = np.asarray(x, dtype=float)
    shift = np.where(x < 10.0, np.ceil(10.0 - x), 0.0)
    below = np.zeros_like(x)
    for k in range(10):
        below += np.where(k < shift, np.log(np.where(k < shift, x + k, 1.0)), 0.0)
    y = x + shift
    tail, power = np.zeros_like(x), 1.0 / y
    for c in _STIRLING:
        tail += c * power
        power = power / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2.0 * math.pi) + tail - below


def _erfc(x):
    """Complementary error function of non-negative values: a series of positive terms below 2, a continued fraction above."""
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    low = x < 2.0
    z = x[low]
    term = total = 2.0 / math.sqrt(math.pi) * z * np.exp(-z * z)
    for n in range(1, 80):
        term = term * 2.0 * z * z / (2 * n + 1)
        total = total + term
    out[low] = 1.0 - total
    z = x[~low & np.isfinite(x)]
    fraction = np.zeros_like(z)
    for n in range(120, 0, -1):
        fraction = (n / 2.0) / (z + fraction)
    out[~low & np.isfinite(x)] = np.exp(-z * z) / math.sqrt(math.pi) / (z + fraction)
    return out


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def t_two_sided_np(t, df):
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    out[ok & np.isinf(t)] = 0.0
    ok &= np.isfinite(t)
    if not ok.any():
        return out
    a, b = df[ok] / 2.0, np.full(int(ok.sum()), 0.5)
    square = t[ok] ** 2
    x, y = df[ok] / (df[ok] + square), square / (df[ok] + square)
    with np.errstate(divide="ignore"):
        log_front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log(y)
    front = np.exp(log_front)
    direct = x < (a + 1.0) / (a + b + 2.0)
    res = np.empty_like(x)
    if direct.any():
        res[direct] = front[direct] * _beta_fraction(a[direct], b[direct], x[direct]) / a[direct]
    rest = ~direct
    if rest.any():
        res[rest] = 1.0 - front[rest] * _beta_fraction(b[rest], a[rest], y[rest]) / b[rest]
    out[ok] = np.clip(res, 0.0, 1.0)
    return out


def t_quantile(prob: float, df: float) -> float:
    """Upper quantile of Student's t by bisection, for interval multipliers."""
    if prob < 0.5:
        return -t_quantile(1.0 - prob, df)
    target = 2.0 * (1.0 - prob)
    low, high = 0.0, 1.0
    while t_two_sided_np([high], [df])[0] > target and high < 1e300:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if t_two_sided_np([mid], [df])[0] > target:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def normal_quantile(prob: float) -> float:
    return NormalDist().inv_cdf(prob)


def normal_two_sided_np(z):
    """2 P(Z >= |z|) for a standard normal."""
    z = np.asarray(z, dtype=float)
    out = np.full(z.shape, np.nan)
    ok = ~np.isnan(z)
    out[ok] = _erfc(np.abs(z[ok]) / math.sqrt(2.0))
    return out


def hypergeom_tail_np(k, population, marked, drawn):
    """P(X >= k): draw ``drawn`` from ``population`` holding ``marked`` marked items."""
    k, population, marked, drawn = (np.asarray(v, dtype=float) for v in (k, population, marked, drawn))
    least = np.maximum(0.0, drawn - (population - marked))
    low, high = np.maximum(k, least), np.minimum(marked, drawn)
    out = np.where(k <= least, 1.0, 0.0)
    rows = np.flatnonzero((k > least) & (low <= high))
    sizes = (high - low + 1)[rows].astype(np.int64)
    start = 0
    while start < len(rows):  # about a million terms of the sums at a time
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 1 << 20)))
        part, terms = rows[start:stop], sizes[start:stop]
        first = np.cumsum(terms) - terms
        at = np.repeat(part, terms)
        j = low[at] + np.arange(terms.sum()) - np.repeat(first, terms)
        m, n, r = marked[part], population[part], drawn[part]
        whole = _log_gamma(m + 1) + _log_gamma(n - m + 1) + _log_gamma(r + 1) + _log_gamma(n - r + 1) - _log_gamma(n + 1)
        m, n, r = marked[at], population[at], drawn[at]
        logs = np.repeat(whole, terms) - _log_gamma(j + 1) - _log_gamma(m - j + 1) - _log_gamma(r - j + 1) - _log_gamma(n - m - r + j + 1)
        out[part] = np.minimum(1.0, np.add.reduceat(np.exp(logs), first))
        start = stop
    return out
