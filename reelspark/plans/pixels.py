"""Queries over pixel operators: a small clip [2, 3, 4, 3] for each vector, and where its pixels go."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import pixels as P
from .registry import query, table

T, H, W, C = 2, 3, 4, 3
#: A pixel of the clip by vec_id v and its place, in SQL; what a query's own place refers to is given.
PIXEL = "((vec_id * 7 + ({}) * 13) % 256)"


def _clips(spark, d):
    """vec_id, data, shape: bytes (vec_id * 7 + place * 13) mod 256."""
    places = F.sequence(F.lit(0), F.lit(T * H * W * C - 1))
    digits = F.transform(places, lambda k: F.lpad(F.hex((F.col("vec_id") * 7 + k * 13) % 256), 2, "0"))
    shape = F.array(*(F.lit(n) for n in (T, H, W, C)))
    return table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(digits, "")).alias("data"), shape.alias("shape"))


def _sums(spark, d, function, name: str = "total"):
    return _clips(spark, d).select("vec_id", P.checksum(function)("data", "shape").alias(name))


def _sql(n: int, source: str, value: str = "{}") -> str:
    """The checksum of n pixels, the one at place k (from 0) taken from source."""
    return f"SELECT vec_id, list_sum([({value.format(PIXEL.format(source))}) * (k + 1) for k in range({n})])::BIGINT AS total FROM embeddings"


N = T * H * W * C


@query(_sql(N, f"k // {W * C} * {W * C} + ({W - 1} - k // {C} % {W}) * {C} + k % {C}"))
def pixel_flip(spark, d):
    return _sums(spark, d, P.flip)


@query(_sql(T * 2 * 2 * C, f"k // {4 * C} * {H * W * C} + (1 + k // {2 * C} % 2) * {W * C} + (2 + k // {C} % 2) * {C} + k % {C}"))
def pixel_crop(spark, d):
    """Rows 1 and 2, columns 2 and 3 of each frame."""
    return _sums(spark, d, lambda c: P.crop(c, 1, 2, 2, 2))


@query(_sql(5 * H * W * C, f"k // {H * W * C} % {T} * {H * W * C} + k % {H * W * C}"))
def pixel_frame_pad(spark, d):
    """Two frames repeated up to five."""
    return _sums(spark, d, lambda c: P.frame_pad(c, 5))


@query(_sql(N, f"k % {T * H * W} * {C} + k // {T * H * W}"))
def pixel_to_tensor(spark, d):
    """Channels first, in [0, 1]; shown times 255."""
    return _sums(spark, d, lambda c: P.to_tensor(c) * 255)


@query(_sql(N, "k", "255 - {}"))
def policy_invert(spark, d):
    return _sums(spark, d, lambda c: P.policy_op(c, "Invert", 0))


@query(_sql(N, "k", "CASE WHEN {0} < 100 THEN {0} ELSE 255 - {0} END"))
def policy_solarize(spark, d):
    return _sums(spark, d, lambda c: P.policy_op(c, "Solarize", 100))


@query(_sql(N, "k", "CASE WHEN {0} < 128 THEN least({0} + 60, 255) ELSE {0} END"))
def policy_solarize_add(spark, d):
    return _sums(spark, d, lambda c: P.policy_op(c, "SolarizeAdd", 60))


@query(_sql(N, "k", "{} // 16 * 16"))
def policy_posterize(spark, d):
    """The four leading bits stay."""
    return _sums(spark, d, lambda c: P.policy_op(c, "Posterize", 4))


@query(f"SELECT vec_id, list_sum([CASE WHEN k // {C} % {W} = {W - 1} THEN {P.FILL} ELSE {PIXEL.format(f'k + {C}')} END * (k + 1) for k in range({N})])::BIGINT AS total FROM embeddings")
def policy_translate(spark, d):
    """One pixel to the left; the last column is the fill."""
    return _sums(spark, d, lambda c: P.policy_op(c, "TranslateX", 1.0))


def _rotary_sql(pair: str) -> str:
    angle = f"((vec_id % 16) / pow(10000, ({pair}) / 8.0))"
    value = f"e[i + 1] * cos{angle} + CASE i % 2 WHEN 0 THEN -e[i + 2] ELSE e[i] END * sin{angle}"
    return f"SELECT vec_id, round(list_sum([({value}) * (i + 1) for i in range(16)]), 5) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _rotary(spark, d, interleaved: bool):
    @F.pandas_udf("double")
    def run(e, at):
        import numpy as np
        import pandas as pd

        turned = P.rotary(np.stack(e.to_list()), at.to_numpy(dtype=float), interleaved)
        return pd.Series(turned @ np.arange(1.0, 17.0))

    vectors = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.slice(A.dbl(F.col("embedding")), 1, 16).alias("e"))
    return vectors.select("vec_id", F.round(run("e", F.col("vec_id") % 16), 5).alias("total"))


@query(_rotary_sql("i % 8"))
def rotary_tiled(spark, d):
    return _rotary(spark, d, interleaved=False)


@query(_rotary_sql("i // 2"))
def rotary_interleaved(spark, d):
    return _rotary(spark, d, interleaved=True)
