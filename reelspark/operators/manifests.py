"""Manifests: union with provenance, vocabularies, label encoding, semi-joins, resampling of rejected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.randoms import hash32
from .indexing import global_index


def union_sources(parts: list[DataFrame], order: str) -> DataFrame:
    """All rows with source_id, the place of their part in the list, and local_id, their place in it."""
    numbered = [global_index(p, order, "local_id").withColumn("source_id", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def source_weight(df: DataFrame, source: str, weight: Column) -> DataFrame:
    """df with sample_weight = the source's weight / the source's rows."""
    counts = df.groupBy(source).agg(F.count("*").alias("_n"))
    return df.join(counts, source).withColumn("sample_weight", weight / F.col("_n")).drop("_n")


def vocabulary(df: DataFrame, keys: list[str], name: str = "class_id") -> DataFrame:
    """Distinct keys with dense ids from 0, in key order."""
    return df.select(*keys).distinct().withColumn(name, F.dense_rank().over(Window.orderBy(*keys)) - 1)


def encode(df: DataFrame, words: DataFrame, keys: list[str], name: str = "class_id", strict: bool = True) -> DataFrame:
    """df with the dense id of its keys; with strict an unknown key raises."""
    if not strict:
        return df.join(words, keys)
    found = df.join(words, keys, "left")
    return found.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit("key without a class id"))).otherwise(F.col(name)))


def known_only(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), keys, "left_semi")


def first_appearance(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the least order at which each appears."""
    return df.groupBy(key).agg(F.min(order).alias("first_at"))


def refill(slots: DataFrame, slot: str, valid: Column, seed: int = 0) -> DataFrame:
    """slots with `use`: the slot itself where valid, else a valid one drawn by a hash of the slot.

    Cardinality is kept, as rejected samples are replaced and not dropped.
    """
    good = global_index(slots.where(valid).select(F.col(slot).alias("use")), "use", "_place")
    n = F.broadcast(good.agg(F.count("*").alias("_n")))  # one row
    bad = slots.where(~F.coalesce(valid, F.lit(False))).crossJoin(n).withColumn("_place", hash32(seed, F.col(slot)) % F.col("_n"))
    return slots.where(valid).withColumn("use", F.col(slot)).unionByName(bad.join(good, "_place").drop("_place", "_n"))


def of_camera(cameras: Column, camera: Column, suffix: str = "_left") -> Column:
    """The entry of a camera's name in a map of all cameras' extrinsics; an unknown name raises."""
    found = F.element_at(cameras, F.concat(camera, F.lit(suffix)))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no extrinsics of camera "), F.coalesce(camera, F.lit("null"))))).otherwise(found)
