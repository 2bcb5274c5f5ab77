"""Tail probabilities of the t and F distributions for the regression tables."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > floor else floor)
            c = c if abs(c) > floor else floor
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def _log_gamma_step(a: float, b: float) -> float:
    """log Gamma(a + b) - log Gamma(a), without cancellation for large a."""
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)
    tail = lambda z: 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3)
    return (a + b - 0.5) * math.log1p(b / a) + b * math.log(a) - b + tail(a + b) - tail(a)


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularized incomplete beta function; ``y`` is 1 - x when that is known more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    large, small = max(a, b), min(a, b)
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    front = math.exp(_log_gamma_step(large, small) - math.lgamma(small) + a * log_x + b * log_y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else beta_inc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    if math.isnan(f):
        return math.nan
    total = df2 + df1 * f
    return 0.0 if math.isinf(f) else beta_inc(df2 / 2.0, df1 / 2.0, df2 / total, df1 * f / total)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5, by bisection on the two-sided tail."""
    target, low, high = 2.0 * (1.0 - p), 0.0, 1.0
    while t_two_sided(high, df) > target:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, df) > target else (low, mid)
    return (low + high) / 2.0
