"""Rigid-pose algebra as column expressions.

A pose is (x, y, z, rx, ry, rz, g): position, extrinsic xyz Euler angles, gripper. A rotation is a list of nine
columns, row by row; R = Rz(rz) Ry(ry) Rx(rx).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rotation = list[Column]


def rotation(rx: Column, ry: Column, rz: Column) -> Rotation:
    (ca, sa), (cb, sb), (cc, sc) = ((F.cos(x), F.sin(x)) for x in (rx, ry, rz))
    return [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa, sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa, -sb, cb * sa, cb * ca]


def transpose(r: Rotation) -> Rotation:
    return [r[3 * j + i] for i in range(3) for j in range(3)]


def times(a: Rotation, b: Rotation) -> Rotation:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def apply(r: Rotation, v: list[Column]) -> list[Column]:
    return [r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3)]


def euler(r: Rotation) -> list[Column]:
    """Angles of a rotation; at the poles (|ry| = pi/2) rz is 0 and rx takes the whole turn."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r[6]))
    pole = F.abs(s) > 1.0 - 1e-12
    rx = F.when(pole, F.when(s > 0, F.atan2(r[1], r[4])).otherwise(F.atan2(-r[1], r[4]))).otherwise(F.atan2(r[7], r[8]))
    return [rx, F.asin(s), F.when(pole, F.lit(0.0)).otherwise(F.atan2(r[3], r[0]))]


def compose(pose: list[Column], action: list[Column]) -> list[Column]:
    """pose moved by action: positions add, rotations multiply (action's on the left), the gripper adds within [0, 1]."""
    xyz = [p + a for p, a in zip(pose[:3], action[:3], strict=True)]
    turned = euler(times(rotation(*action[3:6]), rotation(*pose[3:6])))
    return [*xyz, *turned, F.greatest(F.lit(0.0), F.least(F.lit(1.0), pose[6] + action[6]))]


def difference(start: list[Column], end: list[Column]) -> list[Column]:
    """The action that leads from start to end."""
    turned = euler(times(rotation(*end[3:6]), transpose(rotation(*start[3:6]))))
    return [*(e - s for s, e in zip(start[:3], end[:3], strict=True)), *turned, end[6] - start[6]]


def in_frame(frame: list[Column], pose: list[Column]) -> list[Column]:
    """pose (six columns) seen from frame: inverse(frame) . pose."""
    back = transpose(rotation(*frame[3:6]))
    xyz = apply(back, [p - f for p, f in zip(pose[:3], frame[:3], strict=True)])
    return [*xyz, *euler(times(back, rotation(*pose[3:6])))]
