"""Distribution functions as column expressions and as plain functions; Spark has none built in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: float) -> float:
    return math.erfc(x)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17; absolute error below 7.5e-8)."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(x))
    # The approximation's coefficients.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


NORM_CDF_SQL = (
    "(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)",
    "(exp(-({x}) * ({x}) / 2) / 2.5066282746310002 * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))))",
    "(1 / (1 + 0.2316419 * abs({x})))",
)


def norm_cdf_sql(x: str) -> str:
    """The same in SQL text."""
    t = NORM_CDF_SQL[2].format(x=x)
    tail = NORM_CDF_SQL[1].format(x=x, t=t)
    return NORM_CDF_SQL[0].format(x=x, tail=tail)


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """Inverse of the standard normal distribution function, by bisection and Newton steps."""
    if not 0 < p < 1:
        return math.inf if p >= 1 else -math.inf
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - norm_sf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, k: float) -> float:
    return gamma_q(k / 2, x / 2)


def t_sf2(t: float, v: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(v / 2, 0.5, v / (v + t * t))


def f_sf(f: float, a: float, b: float) -> float:
    return beta_i(b / 2, a / 2, b / (b + a * f))
