"""Distribution functions from published series and continued fractions; scalars on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

TINY = 1e-300


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * head)
    b, c = x + 1 - a, 1 / TINY
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or TINY)
        c = b + an / c or TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or TINY)
            c = 1 + num / c or TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def chi2_sf(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_sf2(t: float, dof: float) -> float:
    """Two-sided."""
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def kolmogorov_sf(x: float) -> float:
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_2samp_p(d: float, n: int, m: int) -> float:
    return kolmogorov_sf(math.sqrt(n * m / (n + m)) * d)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def shapiro_wilk(values) -> tuple[float, float]:
    """(W, p) of 3 to 5000 numbers, by Royston's approximation (Applied Statistics algorithm R94)."""
    x = sorted(map(float, values))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = [normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    ss = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    poly = lambda c, t: sum(k * t**i for i, k in enumerate(c))
    a = [v / math.sqrt(ss) for v in m]
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = poly((a[-1], 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
        if n > 5:
            second = poly((a[-2], 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [v / math.sqrt(phi) for v in m]
            a[-1], a[0], a[-2], a[1] = last, -last, second, -second
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [v / math.sqrt(phi) for v in m]
            a[-1], a[0] = last, -last
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0, 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        z = -math.log(max(TINY, g - math.log1p(-w)))
        mu, sigma = poly((0.5440, -0.39978, 0.025054, -6.714e-4), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        z, k = math.log1p(-w), math.log(n)
        mu, sigma = poly((-1.5861, -0.31082, -0.083751, 0.0038915), k), math.exp(poly((-0.4803, -0.082676, 0.0030302), k))
    return w, 1 - normal_cdf((z - mu) / sigma)
