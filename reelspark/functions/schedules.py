"""Schedules: pure functions of a step column, so resuming needs no replay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_stable_decay(step: Column, warmup: int, anneal: int, total: int, start: float, ref: float, final: float) -> Column:
    """Linear up over warmup steps, flat, linear down over the last anneal of total steps."""
    flat = total - warmup - anneal
    up = start + step / max(1.0, float(warmup)) * (ref - start)
    down = ref + (step - warmup - flat) / max(1.0, float(anneal)) * (final - ref)
    return F.when(step < warmup, up).when(step < warmup + flat, F.lit(ref)).otherwise(down)


def warmup_cosine(step: Column, warmup: int, total: int, start: float, ref: float, final: float) -> Column:
    """Linear up, then half a cosine from ref to final, never below final."""
    up = start + step / max(1.0, float(warmup)) * (ref - start)
    at = (step - warmup) / max(1.0, float(total - warmup))
    return F.when(step < warmup, up).otherwise(F.greatest(F.lit(final), final + (ref - final) * 0.5 * (1.0 + F.cos(F.pi() * at))))


def cosine_decay(step: Column, total: int, ref: float, final: float) -> Column:
    """Half a cosine from ref to final; clamped at final from the side that it comes from."""
    value = final + (ref - final) * 0.5 * (1.0 + F.cos(F.pi() * step / total))
    return F.greatest(F.lit(final), value) if final <= ref else F.least(F.lit(final), value)


def linear_decay(step: Column, total: int, ref: float, final: float) -> Column:
    return ref + (final - ref) * step / total


def momentum_ramp(step: Column, total: int, low: float, high: float, clamp: bool = True) -> Column:
    value = low + step * (high - low) / total
    return F.least(F.lit(high), value) if clamp else value


def delayed_ramp(step: Column, begin: int, end: int, value: float) -> Column:
    """0 before begin, linear to value at end, constant after."""
    return F.when(step < begin, F.lit(0.0)).when(step < end, value * (step - begin) / float(end - begin)).otherwise(F.lit(value))
