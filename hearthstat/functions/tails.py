"""Student-t and F tail areas for result rows.

Spark has no such function. These run inside a pandas UDF on aggregated rows only: one row per test or
coefficient, never on base data.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Workers get these functions with the task and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NORMAL_975 = 1.959963984540054  # 0.975 quantile of the standard normal
NEAR_NORMAL = 1e6  # degrees of freedom from which the t distribution is expanded about the normal


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Modified Lentz evaluation of the incomplete-beta continued fraction.

    It takes about as many terms as the root of the larger parameter; an error is raised if those do not suffice.
    """
    tiny, terms = 1e-300, 10_000 + 20 * math.isqrt(int(max(a, b)))
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, terms):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"no convergence for a = {a}, b = {b}, x = {x}")


def _gamma_step(a: float, b: float) -> float:
    """ln gamma(a + b) - ln gamma(a), without cancellation for large a."""
    if a < 50.0:
        return math.lgamma(a + b) - math.lgamma(a)
    c = a + b
    series = (1 / c - 1 / a) / 12 - (1 / c**3 - 1 / a**3) / 360 + (1 / c**5 - 1 / a**5) / 1260
    return b * math.log(c) + (a - 0.5) * math.log1p(b / a) - b + series


def beta_area(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta function I_x(a, b); y = 1 - x is given too, so that neither loses digits."""
    if x <= 0.0 or y <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    big, small = max(a, b), min(a, b)
    front = math.exp(_gamma_step(big, small) - math.lgamma(small) + a * log_x + b * log_y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_fraction(a, b, x) / a
    return 1.0 - front * _continued_fraction(b, a, y) / b


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df >= NEAR_NORMAL:
        # Expansion in 1/df of the equivalent normal deviate; its error is far below a rounding step here.
        y = (df - 0.5) * math.log1p(t * t / df)
        return math.erfc(math.sqrt(y / 2.0) * (1.0 + (y + 3.0) / (48.0 * (df - 0.5) ** 2)))
    return beta_area(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    if any(v is None or math.isnan(v) for v in (f, df1, df2)) or df1 <= 0 or df2 <= 0:
        return float("nan")
    whole = df2 + df1 * f
    return beta_area(df2 / 2.0, df1 / 2.0, df2 / whole, df1 * f / whole)


def t_quantile(level: float, df: float) -> float:
    """Two-sided critical value: P(|T| <= q) = level."""
    if df is None or math.isnan(df) or df <= 0:
        return float("nan")
    low, high = 0.0, 1.0
    while 1.0 - t_two_sided(high, df) < level:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if mid in (low, high):
            break
        if 1.0 - t_two_sided(mid, df) < level:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def _none_for_nan(values) -> pd.Series:
    return pd.Series([None if v is None or np.isnan(v) else float(v) for v in values], dtype="float64")


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _none_for_nan(t_two_sided(a, b) for a, b in zip(t, df))


@F.pandas_udf(DoubleType())
def t_critical_95(df: pd.Series) -> pd.Series:
    return _none_for_nan(t_quantile(0.95, v) for v in df)
