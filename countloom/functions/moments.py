"""Moments over all units when only non-zero values are stored.

A gene with ``k`` stored values among ``n`` units gets the block of ``n - k``
zeros merged in analytically, so zeros are never materialised and one pass is
enough.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mean_with_zeros(k: Column, mean: Column, n: Column) -> Column:
    return F.when(n > 0, F.coalesce(k, F.lit(0)) * F.coalesce(mean, F.lit(0.0)) / n)


def sq_dev_with_zeros(k: Column, mean: Column, var_pop: Column, n: Column) -> Column:
    """Sum of squared deviations from the mean over all ``n`` units."""
    k0, m0, v0 = F.coalesce(k, F.lit(0)), F.coalesce(mean, F.lit(0.0)), F.coalesce(var_pop, F.lit(0.0))
    return F.when(n > 0, v0 * k0 + m0 * m0 * k0 * (n - k0) / n)


def fourth_dev_with_zeros(k: Column, mean: Column, m2: Column, m3: Column, m4: Column, n: Column) -> Column:
    """Sum of fourth-power deviations; ``m2..m4`` are central power sums of the stored values."""
    z = n - k
    return (
        m4
        + F.pow(mean, 4) * k * z * (k * k - k * z + z * z) / F.pow(n, 3)
        + 6 * mean * mean * z * z * m2 / (n * n)
        + 4 * mean * z * m3 / n
    )


def welch(ma: Column, va: Column, na: Column, mb: Column, vb: Column, nb: Column) -> tuple[Column, Column]:
    """Welch t and its degrees of freedom; null when the pooled error is zero or a side has one unit."""
    ea, eb = va / na, vb / nb
    ok = (na >= 2) & (nb >= 2) & (ea + eb > 0)
    t = F.when(ok, (ma - mb) / F.sqrt(ea + eb))
    df = F.when(ok, (ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1)))
    return t, df
