"""Distribution functions on the driver, from the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def phi(x: float) -> float:
    return _N.cdf(x)


def phi_inverse(p: float) -> float:
    return _N.inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_1_sf(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact test of k of n against one half."""
    if n == 0:
        return 1.0
    low = sum(math.comb(n, i) for i in range(min(k, n - k) + 1))
    return min(1.0, 2 * low / 2**n)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def student_two_sided(t: float, df: int) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def mcnemar(b: int, c: int, exact: bool | None = None) -> tuple[float, float]:
    """(statistic, p) from the discordant counts; exact below 25 of them."""
    if b + c == 0:
        return 0.0, 1.0
    if exact or exact is None and b + c < 25:
        return float(b), binomial_two_sided(b, b + c)
    x = (abs(b - c) - 1) ** 2 / (b + c)
    return x, chi2_1_sf(x)


def sample_size(d: float, alpha: float = 0.05, power: float = 0.8, test: str = "ttest") -> int:
    if d == 0:
        raise ValueError("effect size must not be zero")
    n = 2 * ((phi_inverse(1 - alpha / 2) + phi_inverse(power)) / d) ** 2
    return math.ceil(n / 0.955 if test == "wilcoxon" else n)


def bca_levels(below: int, n: int, acceleration: float, level: float = 0.95) -> tuple[float, float] | None:
    """The two adjusted quantile levels; None where the bias correction is not finite."""
    if below in (0, n):
        return None
    z0, out = phi_inverse(below / n), []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + phi_inverse(q)
        if 1 - acceleration * z <= 0:
            return None
        out.append(phi(z0 + z / (1 - acceleration * z)))
    return out[0], out[1]
