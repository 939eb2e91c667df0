"""Closed-form probabilities for summary rows (one row per feature, pair or key), with pandas UDF wrappers."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * head
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def chi2_sf(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2) if dof > 0 else 1.0


def beta_regularized(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b) by continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularized(1 - x, b, a)
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 5000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def t_two_sided(t: float, dof: float) -> float:
    return beta_regularized(dof / (dof + t * t), dof / 2, 0.5)


def t_quantile(p: float, dof: float) -> float:
    """Student-t quantile by bisection on the distribution function."""
    if p == 0.5:
        return 0.0
    target, lo, hi = 2 * min(p, 1 - p), 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, dof) > target else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)


def kolmogorov_sf(x: float) -> float:
    """Limit distribution of the scaled two-sample distance."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_p(d: float, n: float, m: float) -> float:
    return kolmogorov_sf(d * math.sqrt(n * m / (n + m)))


def binomial_upper(k: float, n: float, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    return 1.0 if k <= 0 else beta_regularized(p, k, n - k + 1)


# Published response-surface coefficients for unit-root statistics with a constant,
# for one series and for a residual of two series (small-p and large-p polynomials, switch and end points).
UNIT_ROOT = {
    1: {"small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368), "star": -1.61, "low": -18.83, "high": 2.74},
    2: {"small": (2.92, 1.5012, 0.039796), "large": (2.1945, 0.64695, -0.29198, -0.042377), "star": -2.62, "low": -18.86, "high": 0.92},
}

# Published finite-sample critical-value surfaces (constant, 1/n, 1/n^2, 1/n^3) for two series.
COINTEGRATION_CRITICAL = {
    0.01: (-3.89644, -10.9519, -22.527, 0.0),
    0.05: (-3.33613, -6.1101, -6.823, 0.0),
    0.10: (-3.04445, -4.2412, -2.72, 0.0),
}


def unit_root_p(t: float, series: int = 1) -> float:
    s = UNIT_ROOT[series]
    if t > s["high"]:
        return 1.0
    if t < s["low"]:
        return 0.0
    poly = s["small"] if t <= s["star"] else s["large"]
    return normal_cdf(sum(c * t**k for k, c in enumerate(poly)))


def on_rows(fn: Callable[..., float], *cols: Column | str) -> Column:
    """Apply a float function to the few rows of a summary; null in, null out."""

    @F.pandas_udf("double")
    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in vs) else float(fn(*map(float, vs))) for vs in zip(*series)], dtype="float64")

    return apply(*[F.col(c) if isinstance(c, str) else c for c in cols])
