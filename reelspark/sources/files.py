"""Manifests and annotations from delimited files, and a registry of named sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.indexing import concat_ranges

MANIFEST = "path string, label int"
ANNOTATION = "video_id string, start_frame int, stop_frame int, verb_class int, noun_class int"


def separator(spark: SparkSession, path: str) -> str:
    """' ' unless the first line only parses with '::'; decided from one line, declared for the whole file."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return "::" if first and "::" in first[0][0] else " "


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """path, label of a header-less manifest; further columns are ignored."""
    return spark.read.schema(MANIFEST).option("sep", sep or separator(spark, path)).option("enforceSchema", "true").csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One manifest by its suffix; a suffix without a reader raises, as skipping it would shift the sources after it."""
    if path.endswith((".csv", ".txt")):
        return delimited(spark, path)
    if path.endswith(".npy"):
        from .arrays import register

        register(spark)
        return spark.read.format("npy_manifest").load(path).select("path", "label")
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("path", "label")
    raise ValueError(f"no reader for manifest {path}")


def _placed(rows: DataFrame, path: str) -> DataFrame:
    """rows with local_id, their place in the manifest's files by name and offset, without a sort.

    A split's rows have consecutive numbers, so a row's place is what the splits before its own hold, a small table,
    and how far it is from the first of its split.
    """
    splits = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")) if path.endswith((".csv", ".txt", ".parquet")) else F.struct(F.spark_partition_id())
    numbered = rows.select(F.col("path"), F.col("label"), splits.alias("_split"), F.monotonically_increasing_id().alias("_number"))
    per = numbered.groupBy("_split").agg(F.count("*").alias("_here"), F.min("_number").alias("_first"))
    before = F.sum("_here").over(Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    per = F.broadcast(per.select(F.col("_split").alias("_own"), "_first", F.coalesce(before, F.lit(0)).alias("_before")))  # a row per split
    joined = numbered.join(per, F.col("_split") == F.col("_own"))
    return joined.select("path", "label", (F.col("_before") + F.col("_number") - F.col("_first")).alias("local_id"))


def mixture(spark: SparkSession, paths: str | list[str], weights: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with source_id, local_id and sample_weight; sources with n, lo, hi)."""
    paths = [paths] if isinstance(paths, str) else paths
    if weights is not None and len(weights) != len(paths):
        raise ValueError("a weight per manifest is needed")
    rows = reduce(lambda a, b: a.unionByName(b), [_placed(manifest(spark, p), p).withColumn("source_id", F.lit(i)) for i, p in enumerate(paths)])
    sizes = concat_ranges(rows.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "n")
    w = F.get(F.array(*(F.lit(float(x)) for x in (weights or [1.0] * len(paths)))), F.col("source_id"))
    return rows.join(F.broadcast(sizes.select("source_id", "n")), "source_id").withColumn("sample_weight", w / F.col("n")).drop("n"), sizes


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).option("header", "true").csv(path)


def subset(spark: SparkSession, path: str, root: str) -> DataFrame:
    """path and class_name of the lines <class>_<id>... of a subset list."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("line"))
    named = lines.withColumn("class_name", F.split("line", "_")[0])
    return named.select(F.concat_ws("/", F.lit(root), "class_name", "line").alias("path"), "class_name")


class Registry:
    """Named factories, found without regard to case; an unknown name raises."""

    def __init__(self) -> None:
        self.found: dict[str, Callable] = {}

    def add(self, name: str, make: Callable) -> None:
        self.found[name.lower()] = make

    def make(self, name: str, *args, **kwargs):
        if name.lower() not in self.found:
            raise KeyError(f"unknown source {name}; known: {', '.join(sorted(self.found))}")
        return self.found[name.lower()](*args, **kwargs)


SOURCES = Registry()
SOURCES.add("videodataset", mixture)
SOURCES.add("annotations", annotations)
SOURCES.add("subset", subset)


def load_options(text: str, overrides: dict | None = None) -> dict:
    """Nested options from YAML where that library is at hand, else from JSON; overrides go by dotted names."""
    try:
        import yaml

        options = yaml.safe_load(text)
    except ImportError:
        import json

        options = json.loads(text)
    for dotted, value in (overrides or {}).items():
        *path, last = dotted.split(".")
        at = options
        for name in path:
            at = at.setdefault(name, {})
        at[last] = value
    return options


def with_retries(read: Callable, attempts: int = 3, wait: Callable[[float], None] | None = None):
    """read(), again after about 1, 2, 4 ... seconds when it raises; the last error is raised."""
    import random
    import time

    for k in range(attempts):
        try:
            return read()
        except Exception:
            if k == attempts - 1:
                raise
            (wait or time.sleep)(2**k * random.uniform(1, 1.1))
