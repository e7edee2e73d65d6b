"""Distribution tails for tests whose statistics Spark has aggregated; scalars only, on the driver."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    if p == 0.5:
        return 0.0
    tail, lo, hi = 2 * min(p, 1 - p), 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)


def jzs_bf10(t: float, n: float, df: float, r: float = 0.707) -> float:
    """Bayes factor of a t statistic with effective size n, Cauchy prior of scale r: Simpson's rule over g = u / (1 - u)."""
    null = (1 + t * t / df) ** (-(df + 1) / 2)

    def at(u: float) -> float:
        g = u / (1 - u)
        k = 1 + n * g * r * r
        return k**-0.5 * (1 + t * t / (k * df)) ** (-(df + 1) / 2) * (2 * math.pi) ** -0.5 * g**-1.5 * math.exp(-1 / (2 * g)) / (1 - u) ** 2

    m = 4000
    h = (1 - 2e-6) / m
    return h / 3 * sum(at(1e-6 + i * h) * (1 if i in (0, m) else 4 if i % 2 else 2) for i in range(m + 1)) / null


def studentized_range_tail(q: float, k: int, df: float) -> float:
    """P(Q > q) of the studentized range of k means with df degrees of freedom: Simpson's rule over the scale and the place."""
    if not q > 0 or k < 2:
        return 1.0
    if math.isinf(q):
        return 0.0
    import numpy as np

    def simpson(y, h):
        return h / 3 * (y[..., 0] + y[..., -1] + 4 * y[..., 1:-1:2].sum(-1) + 2 * y[..., 2:-1:2].sum(-1))

    z = np.linspace(-8.0, 8.0, 401)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    grid = np.linspace(-40.0, 40.0, 40001)
    cdf = np.array([0.5 * math.erfc(-g / math.sqrt(2)) for g in grid])
    below = lambda x: np.interp(x, grid, cdf)

    def inside(w):
        return k * simpson(phi * np.maximum(below(z) - below(z - w[:, None]), 0.0) ** (k - 1), z[1] - z[0])

    spread = 10 / math.sqrt(2 * df)
    s = np.linspace(max(1e-6, 1 - spread), 1 + spread, 401)
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, 1 - simpson(np.exp(log_density) * np.minimum(inside(q * s), 1.0), s[1] - s[0]))))


def k_squared(n: int, g1: float, g2: float) -> float:
    """D'Agostino's K2 of a sample's skewness and excess kurtosis, n of at least 20."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - e) / math.sqrt(v)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    ratio = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


# Royston's polynomials of 1995 for the two outer coefficients and for the mean and spread of log (1 - W).
ROYSTON_OUTER = ((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157), (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981))
ROYSTON_SMALL = ((0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322))
ROYSTON_LARGE = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """Shapiro and Wilk's W and its p by Royston's approximation; 3 to 5,000 values that are not all equal."""
    from statistics import NormalDist

    normal, x = NormalDist(), sorted(values)
    n = len(x)
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    total, u = sum(v * v for v in m), 1 / math.sqrt(n)
    a = [v / math.sqrt(total) for v in m]
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        outer = [sum(c * u ** (5 - k) for k, c in enumerate(p)) for p in ROYSTON_OUTER]
        fixed = 1 if n <= 5 else 2
        new = [a[-1 - k] + outer[k] for k in range(fixed)]
        rest = (total - 2 * sum(v * v for v in m[n - fixed :])) / (1 - 2 * sum(v * v for v in new))
        a = [v / math.sqrt(rest) for v in m]
        for k, v in enumerate(new):
            a[-1 - k], a[k] = v, -v
    mean = sum(x) / n
    w = min(1.0, sum(c * v for c, v in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    by = lambda p, v: sum(c * v**k for k, c in enumerate(p))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if math.log(1 - w) >= gamma:
            return w, 0.0
        y, mu, sigma = -math.log(gamma - math.log(1 - w)), by(ROYSTON_SMALL[0], n), math.exp(by(ROYSTON_SMALL[1], n))
    else:
        y, mu, sigma = math.log(1 - w), by(ROYSTON_LARGE[0], math.log(n)), math.exp(by(ROYSTON_LARGE[1], math.log(n)))
    return w, 1 - normal.cdf((y - mu) / sigma)


def noncentral_f_tail(f: float, d1: float, d2: float, ncp: float) -> float:
    """P(F > f) of a noncentral F: central terms weighed by the Poisson law of half the noncentrality."""
    if ncp == 0:
        return f_tail(f, d1, d2)
    x, half = d1 * f / (d1 * f + d2), ncp / 2
    middle = int(half)
    total, below = 0.0, 0.0
    for step in (1, -1):
        j = middle if step > 0 else middle - 1
        while j >= 0:
            weight = math.exp(-half + j * math.log(half) - math.lgamma(j + 1))
            total += weight * (1 - beta_inc(d1 / 2 + j, d2 / 2, x))
            below += weight
            if weight < 1e-16 and abs(j - middle) > 5:
                break
            j += step
    return min(1.0, max(0.0, total + max(0.0, 1 - below) * 0.5))


def t_power(effect: float, n1: float, n2: float, level: float = 0.05) -> float:
    """Power of the two-sided two-sample t test for a standardised difference, by t squared's noncentral F."""
    df = n1 + n2 - 2
    return noncentral_f_tail(t_quantile(1 - level / 2, df) ** 2, 1, df, effect**2 * n1 * n2 / (n1 + n2))


def f_quantile_tail(level: float, d1: float, d2: float) -> float:
    """The f with P(F > f) = level, by bisection."""
    lo, hi = 0.0, 1.0
    while f_tail(hi, d1, d2) > level:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f_tail(mid, d1, d2) > level else (lo, mid)
    return (lo + hi) / 2


def anova_power(effect: float, groups: int, n: float, level: float = 0.05) -> float:
    """Power of the F test of `groups` means with n values in all, effect Cohen's f."""
    d1, d2 = groups - 1, n - groups
    return noncentral_f_tail(f_quantile_tail(level, d1, d2), d1, d2, effect**2 * n)


def regression_power(f2: float, predictors: int, n: float, level: float = 0.05) -> float:
    """Power of the F test of a regression's r squared, effect Cohen's f squared."""
    d1, d2 = predictors, n - predictors - 1
    return noncentral_f_tail(f_quantile_tail(level, d1, d2), d1, d2, f2 * n)


def least_n(power_of, wanted: float, start: int) -> int:
    """The least n of at least `start` with power_of(n) >= wanted; power_of must rise."""
    hi = start
    while power_of(hi) < wanted:
        hi *= 2
        if hi > 1 << 40:
            raise ValueError("no sample is large enough")
    lo = start
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if power_of(mid) >= wanted else (mid + 1, hi)
    return lo
