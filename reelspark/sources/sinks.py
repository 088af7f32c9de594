"""Sinks: typed CSV logs, buffered telemetry per worker, versioned snapshots, options."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def typed_csv(df: DataFrame, path: str, columns: list[tuple[str, str]], order: list[str] | None = None) -> None:
    """Append rows, in the order of some columns, whose columns are shown by printf formats, as (format, name).

    One file per call, and one header: that of the call which makes the folder. A log has a row per step or epoch, so
    one task can write it.
    """
    shown = df.orderBy(*order) if order else df
    lines = shown.select(*(F.format_string(f, name).alias(name) for f, name in columns)).coalesce(1)
    lines.write.mode("append").option("header", str(not _exists(df, path)).lower()).option("escapeQuotes", "false").option("quote", "").csv(path)


def _field(name: str, kind: str) -> Column:
    """A CSV field: numbers as they are, anything else in quotes, with quotes doubled; null is an empty quoted field."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(F.col(name).cast("string"), F.lit('""'))
    return F.concat(F.lit('"'), F.coalesce(F.replace(F.col(name).cast("string"), F.lit('"'), F.lit('""')), F.lit("")), F.lit('"'))


def telemetry(df: DataFrame, path: str, rank: str = "rank", worker: str = "worker", order: str = "timestamp", first: bool = False) -> None:
    """Rows as CSV lines into a folder per rank and worker, in order; strings are quoted and numbers are not.

    The first flush replaces what is there and begins with a header in each folder; later ones append.
    """
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if c not in (rank, worker)]
    line = F.concat_ws(",", *(_field(c, kinds[c]) for c in names))
    lines = df.select(rank, worker, F.lit(1).alias("_part"), F.col(order).alias("_order"), line.alias("value"))
    if first:
        header = ",".join(f'"{c}"' for c in names)
        lines = lines.unionByName(df.select(rank, worker).distinct().select(rank, worker, F.lit(0).alias("_part"), F.lit(None).cast(kinds[order]).alias("_order"), F.lit(header).alias("value")))
    # a worker's lines are one partition, as they are one file
    dealt = lines.repartition(rank, worker).sortWithinPartitions(rank, worker, "_part", "_order").select(rank, worker, "value")
    dealt.write.mode("overwrite" if first else "append").option("lineSep", "\r\n").partitionBy(rank, worker).text(path)


def options(spark, path: str, values: dict) -> None:
    """The options of a run as one JSON text; files.load_options reads it again."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def snapshot(df: DataFrame, path: str, epoch: int, every: int) -> list[str]:
    """Overwrite path/latest, and keep path/e<epoch> too every so many epochs. Errors come back, they don't stop the run."""
    errors = []
    for target in [f"{path}/latest", *([f"{path}/e{epoch}"] if every > 0 and epoch % every == 0 else [])]:
        try:
            df.write.mode("overwrite").parquet(target)
        except Exception as e:  # noqa: BLE001
            errors.append(f"{target}: {e}")
    return errors


def fresh_folder(name: str, exists: bool, resume: bool, now) -> str:
    """name, with a time stamp where the folder is there already and the run does not resume."""
    return f"{name.rstrip('/')}_{now:%y_%m_%d_%H_%M_%S}" if exists and not resume else name
