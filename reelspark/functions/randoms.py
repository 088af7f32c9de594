"""Deterministic randomness: uniforms and normals keyed by a hash of their key columns.

Results depend on keys and seed alone, never on partitioning, order or retries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = float(1 << 32)


def key(*parts) -> Column:
    return F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def hash32(*parts) -> Column:
    """The first 32 bits of the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(key(*parts)), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """In [0, 1)."""
    return hash32(*parts) / F.lit(RANGE)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller of two uniforms."""
    u = (hash32(*parts, "u") + 1) / F.lit(RANGE)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * F.pi() * uniform(*parts, "v"))


def truncated_normal(mean: float, std: float, low: float, high: float, *parts) -> Column:
    """Normal within [low, high] by the inverse of its distribution, in a closed approximation of the probit."""
    from math import erf, sqrt

    a, b = (0.5 * (1 + erf((x - mean) / std / sqrt(2))) for x in (low, high))
    p = a + uniform(*parts) * (b - a)
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), mean + std * probit(p)))


#: Coefficients of a public rational approximation of the normal quantile (relative error 1.15e-9).
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def probit(p: Column) -> Column:
    def poly(x: Column, cs) -> Column:
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * x + c
        return out

    q = p - 0.5
    middle = q * poly(q * q, PROBIT_A) / (poly(q * q, PROBIT_B) * (q * q) + 1.0)
    tail = lambda t: poly(t, PROBIT_C) / (poly(t, PROBIT_D) * t + 1.0)
    low, high = F.sqrt(-2.0 * F.ln(F.greatest(p, F.lit(1e-300)))), F.sqrt(-2.0 * F.ln(F.greatest(1.0 - p, F.lit(1e-16))))
    return F.when(p < 0.02425, tail(low)).when(p > 0.97575, -tail(high)).otherwise(middle)


def lcg_seeds(base: int, worker: int, rank: int, count: int) -> list[int]:
    """A seed sequence by the 64-bit linear congruential generator x -> 6364136223846793005 x + 1 (mod 2^64)."""
    x = (base + worker + (rank << 32)) & (1 << 64) - 1
    out = []
    for _ in range(count):
        x = (x * 6364136223846793005 + 1) & (1 << 64) - 1
        out.append(x >> 32)
    return out


def two_stage_draws(sizes: list[int], weights: list[float], replicas: int, rank: int, seed: int, epoch: int, n: int, shuffle: bool = True) -> list[int]:
    """Global indices of n draws of one rank: a source by weight, then a place of this rank in it.

    With shuffle both come from numpy's default generator, seeded by seed + rank + epoch; without, sources follow a
    round robin that repeats each by its integer weight, starting at the rank's place, and the number of the draw gives
    the place.
    """
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out: list[int] = []
    if shuffle:
        rng = np.random.default_rng(seed + rank + epoch)
        p = np.array(weights, dtype=float) / sum(weights)
        for _ in range(n):
            source = int(rng.choice(range(len(sizes)), p=p))
            out.append(int(offsets[source]) + int(rng.integers(sizes[source] // replicas)) * replicas + rank)
        return out
    if any(w != int(w) for w in weights):
        raise ValueError("a round robin needs integer weights")
    order = [i for i, w in enumerate(weights) for _ in range(int(w))]
    for k in range(n):  # k counts the draws of all sources together
        source = order[(rank + k) % len(order)]
        out.append(int(offsets[source]) + (k * replicas + rank) % sizes[source])
    return out
