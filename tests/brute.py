"""Plain NumPy versions of the statistics, to test against."""

import math

import numpy as np


def ks(ref, cur):
    points = np.unique(np.concatenate([ref, cur]))
    f = np.searchsorted(np.sort(ref), points, side="right") / len(ref)
    g = np.searchsorted(np.sort(cur), points, side="right") / len(cur)
    return float(np.max(np.abs(f - g)))


def psi(ref, cur, bins=10):
    """Cut the sorted reference at its quantiles and compare the shares of each interval [low, high)."""
    ordered = sorted(ref)

    def quantile(q):
        place = q * (len(ordered) - 1)
        low = int(place)
        high = min(low + 1, len(ordered) - 1)
        return ordered[low] + (place - low) * (ordered[high] - ordered[low])

    cuts = sorted({quantile(i / bins) for i in range(bins + 1)})[1:-1]
    if not cuts:
        return 0.0
    total = 0.0
    for low, high in zip([-math.inf, *cuts], [*cuts, math.inf]):
        before = max(sum(low <= x < high for x in ref) / len(ref), 1e-6)
        now = max(sum(low <= x < high for x in cur) / len(cur), 1e-6)
        total += (now - before) * math.log(now / before)
    return total


def ks_one_sample_survival(n, d):
    """P(D_n >= d), exact, by Marsaglia, Tsang and Wang's matrix power."""
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    matrix = np.tril(np.ones((m, m)), 1)
    for i in range(m):
        matrix[i, 0] -= h ** (i + 1)
        matrix[m - 1, i] -= h ** (m - i)
    matrix[m - 1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                matrix[i, j] /= math.factorial(i - j + 1)
    power, scale = np.eye(m), 0.0
    for _ in range(n):
        power = power @ matrix
        top = power[k - 1, k - 1]
        if top > 1e100:
            power, scale = power / 1e100, scale + 100
        if top < 1e-100:
            power, scale = power * 1e100, scale - 100
    log_below = math.log(power[k - 1, k - 1]) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return 1 - math.exp(log_below)
