"""Structured Streaming: telemetry windows, the accepted-only trailing filter, count batches, meters by epoch."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a telemetry sample.
TELEMETRY = (
    "timestamp double, cpu_percent double, read_count long, write_count long, read_bytes long, write_bytes long, read_chars long, write_chars long, "
    "cpu_times_user double, cpu_times_system double, cpu_times_children_user double, cpu_times_children_system double, cpu_times_iowait double, "
    "cpu_affinity string, cpu_num int, num_threads int, num_voluntary_ctx_switches long, num_involuntary_ctx_switches long"
)


def telemetry_windows(samples: DataFrame, every: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Means and maxima per tumbling window of a stream (or table) of telemetry; rows later than late are dropped."""
    timed = samples.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every).alias("w")).agg(F.count("*").alias("n"), F.avg("cpu_percent").alias("cpu"), F.max("num_threads").alias("threads"), F.max("read_bytes").alias("read_bytes")).select("w.start", "n", "cpu", "threads", "read_bytes")


@dataclass
class TrailingFilter:
    """Accepts a value unless it is above mean + k deviations of the last n accepted ones.

    The bound holds only once more than n / 2 values were accepted. More than `most` rejections in all abort; the
    counter is never reset.
    """

    n: int = 300
    k: float = 3.0
    most: int = 10
    abort: bool = True

    def step(self, trail: list[float], rejected: int, value: float) -> tuple[bool, int]:
        """(accepted, rejections so far); trail is changed in place."""
        if math.isnan(value):
            ok = False
        elif len(trail) > self.n / 2:
            m = sum(trail) / len(trail)
            sd = math.sqrt(sum((x - m) ** 2 for x in trail) / len(trail))
            ok = value <= m + self.k * sd
        else:
            ok = True
        if ok:
            trail.append(value)
            del trail[: -self.n]
            return True, rejected
        if self.abort and rejected + 1 > self.most:
            raise ValueError(f"more than {self.most} values above the trailing bound")
        return False, rejected + 1

    def batch(self, df: DataFrame, key: str, order: list[str], value: str, row_id: str) -> DataFrame:
        """key, row_id, accepted of a table: a key's rows in order, one after the other."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, ignore_index=True)
            trail: list[float] = []
            rejected, out = 0, []
            for v in pdf[value]:
                ok, rejected = self.step(trail, rejected, float(v))
                out.append(ok)
            return pd.DataFrame({key: pdf[key], row_id: pdf[row_id], "accepted": out})

        columns = list(dict.fromkeys([key, *order, value, row_id]))
        kinds = dict(df.dtypes)
        return df.select(*columns).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, accepted boolean")

    def stream(self, df: DataFrame, key: str, order: list[str], value: str, row_id: str) -> DataFrame:
        """The same over a stream: the trail is state per key, so a restart goes on where it stopped."""
        from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

        def run(k: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            trail, rejected = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
            pdf = pd.concat(list(parts)).sort_values(order, ignore_index=True)
            out = []
            for v in pdf[value]:
                ok, rejected = self.step(trail, rejected, float(v))
                out.append(ok)
            state.update((json.dumps(trail), rejected))
            yield pd.DataFrame({key: pdf[key], row_id: pdf[row_id], "accepted": out})

        kinds = dict(df.dtypes)
        return df.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, accepted boolean", "trail string, rejected int", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give the result as a table in memory (tests, notebooks)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A sink by callback, batch ids in order; what was written under an id is known after a restart."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_batches(df: DataFrame, key: str, size: int, drop_last: bool = False) -> DataFrame:
    """df with batch_id, size rows each in the order of key; the partial last one is kept unless drop_last."""
    from ..operators.indexing import global_index

    placed = global_index(df, key, "_i").withColumn("batch_id", F.floor(F.col("_i") / size)).drop("_i")
    if not drop_last:
        return placed
    whole = F.broadcast(df.agg(F.floor(F.count("*") / size).alias("_whole")))  # one row
    return placed.crossJoin(whole).where("batch_id < _whole").drop("_whole")
