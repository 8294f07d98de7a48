"""Tail probabilities for a handful of statistics held on the driver."""

from __future__ import annotations

import math


def normal_two_sided(z: float | None) -> float | None:
    if z is None or math.isnan(z):
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def student_two_sided(t: float | None, df: float | None) -> float | None:
    """P(|T| > |t|) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return None
    t, df = float(t), float(df)
    if math.isinf(t):
        return 0.0
    a, b = df / 2.0, 0.5
    x, rest = df / (df + t * t), t * t / (df + t * t)
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(rest)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(rest, b, a) / b
