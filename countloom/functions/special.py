"""Tail probabilities as Arrow-batched column functions.

They run on aggregated rows only (one row per gene, set or state), never on
count-level rows. The NumPy module behind them is sent by value, so executors
need no copy of this package.
"""

from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from countloom.functions import tails
from countloom.functions.tails import normal_quantile, t_quantile


__all__ = ["hypergeom_tail", "normal_quantile", "normal_two_sided", "t_quantile", "t_two_sided"]


@cache
def _udf(name: str) -> Callable:
    compute = getattr(tails, f"{name}_np")

    def batch(*columns):
        import pandas

        values = compute(*[c.to_numpy(dtype=float) for c in columns])
        out = pandas.Series(values)
        return out.where(out.notna(), None)

    if name == "normal_two_sided":
        def call(z: pd.Series) -> pd.Series:
            return batch(z)
    elif name == "t_two_sided":
        def call(t: pd.Series, df: pd.Series) -> pd.Series:
            return batch(t, df)
    else:
        def call(k: pd.Series, population: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
            return batch(k, population, marked, drawn)
    return F.pandas_udf(call, T.DoubleType())


def t_two_sided(t: Column | str, df: Column | str) -> Column:
    """P(|T| >= |t|) with ``df`` degrees of freedom; null in, null out."""
    return _udf("t_two_sided")(t, df)


def normal_two_sided(z: Column | str) -> Column:
    return _udf("normal_two_sided")(z)


def hypergeom_tail(k, population, marked, drawn) -> Column:
    """P(X >= k) when ``drawn`` items are taken from ``population`` holding ``marked`` marked ones."""
    return _udf("hypergeom_tail")(k, population, marked, drawn)
