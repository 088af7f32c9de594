"""Planning: sample actions, score them, keep the best, refit; and the energy of a grid of actions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.randoms import normal

AXES = ("dx", "dy", "dz", "dg")


def candidates(spark: SparkSession, n: int, mean: list[list[float]], std: list[list[float]], seed: int, step: int, maxnorm: float = 0.05, gripper: float = 0.75, pinned: dict[int, float] | None = None) -> DataFrame:
    """id and, per horizon step h, a_h = array of (dx, dy, dz, dg): mean + std * normal, clipped, pinned axes fixed."""
    out = spark.range(n)
    for h in range(len(mean)):
        values = []
        for axis in range(4):
            v = mean[h][axis] + std[h][axis] * normal(seed, step, F.col("id"), h, axis)
            limit = gripper if axis == 3 else maxnorm
            v = F.greatest(F.lit(-limit), F.least(F.lit(limit), v))
            values.append(F.lit(float(pinned[axis])) if pinned and axis in pinned else v)
        out = out.withColumn(f"a_{h}", F.array(*values))
    return out


def refit(scored: DataFrame, horizon: int, top: int) -> tuple[list[list[float]], list[list[float]]]:
    """Mean and sample deviation of the top candidates of least score, per horizon step and axis: one row to the driver."""
    best = scored.orderBy("score", "id").limit(top)
    aggs = [f(F.get(f"a_{h}", axis)).alias(f"{n}_{h}_{axis}") for h in range(horizon) for axis in range(4) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    r = best.agg(*aggs).first()
    return tuple([[r[f"{n}_{h}_{axis}"] or 0.0 for axis in range(4)] for h in range(horizon)] for n in ("m", "s"))


def plan(spark: SparkSession, score: Callable[[DataFrame, int], Column], horizon: int = 1, samples: int = 400, top: int = 10, steps: int = 5, momentum: tuple[float, float] = (0.25, 0.95), momentum_gripper: tuple[float, float] = (0.15, 0.15), seed: int = 0, close: float = 0.25, **limits) -> list[list[float]]:
    """The cross-entropy method: the mean action per horizon step after steps rounds; small grippers become 0.

    score gives a column of the candidates' costs, from a roll-out of any model over a_0 .. a_{horizon-1}. The state
    between rounds is one small table of means and deviations, so nothing is carried in the lineage.
    """
    mean, std = [[0.0] * 4 for _ in range(horizon)], [[0.05, 0.05, 0.05, 0.75] for _ in range(horizon)]
    blend = lambda old, new, keep: keep * old + (1 - keep) * new
    for step in range(steps):
        c = candidates(spark, samples, mean, std, seed, step, **limits)
        m, s = refit(c.withColumn("score", score(c, step)), horizon, top)
        for h in range(horizon):
            for axis in range(4):
                km, ks = momentum_gripper if axis == 3 else momentum
                mean[h][axis], std[h][axis] = blend(mean[h][axis], m[h][axis], km), blend(std[h][axis], s[h][axis], ks)
    return [[*a[:3], 0.0 if abs(a[3]) < close else a[3]] for a in mean]


def action_grid(spark: SparkSession, n: int, size: float) -> DataFrame:
    """n ** 3 actions on even steps over [-size, size]: one row each, by arithmetic on a range."""
    at = lambda k: -size + 2 * size * k / (n - 1)
    i = F.col("id")
    return spark.range(n**3).select("id", at(F.floor(i / (n * n))).alias("dx"), at(F.floor(i / n) % n).alias("dy"), at(i % n).alias("dz"))


def euclid(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, ((p - q) * (p - q) for p, q in zip(a, b, strict=True))))
