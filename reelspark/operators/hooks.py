"""User hooks: models by name, recordings decoded once for many windows, stages that give errors as rows, a UDTF."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Name -> factory(**options) of a function on arrays [N, D] -> [N, K].
MODELS: dict[str, Callable[..., Callable[[np.ndarray], np.ndarray]]] = {}


def model(name: str):
    """Register a factory under a name."""

    def add(factory):
        MODELS[name] = factory
        return factory

    return add


@model("identity")
def _identity():
    return lambda x: x


@model("linear")
def _linear(weights, bias=None):
    w = np.asarray(weights, dtype=float)
    return lambda x: x @ w.T + (0.0 if bias is None else np.asarray(bias, dtype=float))


def score(name: str, **options) -> Callable[[Column], Column]:
    """An Arrow-batched column function array<double> -> array<double> of a registered model, built once per task."""
    if name not in MODELS:
        raise KeyError(f"unknown model {name}; known: {', '.join(sorted(MODELS))}")
    factory = MODELS[name]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = factory(**options)
        for s in batches:
            out = [None] * len(s)
            some = [i for i, x in enumerate(s) if x is not None]
            if some:
                for i, y in zip(some, f(np.stack([np.asarray(s.iloc[i], dtype=float) for i in some])), strict=True):
                    out[i] = np.asarray(y, dtype=float).tolist()
            yield pd.Series(out)

    return run


def read_clips(
    plan: DataFrame,
    decoder: Callable[[str], tuple[int, Callable[[list[int]], np.ndarray]]],
    shared_transform: Callable[[np.ndarray], np.ndarray] | None = None,
    transform: Callable[[np.ndarray], np.ndarray] | None = None,
    clips: int = 1,
    stretch: int = 16_384,
) -> DataFrame:
    """plan (path, clip_id, frames array<long>) -> path, clip_id, part, data, shape, error.

    decoder(path) opens a recording and gives its length and a reader of frame indices. Windows are dealt out by path
    and by the stretch of so many frames that they begin in, and sorted: a task meets the windows of a stretch one
    after another and opens the recording once for them, and a long recording with many windows is many tasks.
    The frames of a row are read as one; shared_transform sees all of them, then they are cut into equally long
    clips, a row each with its number as part, and transform sees each clip. What fails comes back as an error row.
    """

    def made(opened, frames):
        length, reader = opened
        if not frames or max(frames) >= length or min(frames) < 0:
            raise IndexError(f"frames outside of 0..{length - 1}")
        data = reader(frames)
        data = shared_transform(data) if shared_transform else data
        each = len(data) // clips
        parts = [data[k * each : (k + 1) * each] for k in range(clips)]
        return [np.ascontiguousarray(transform(x) if transform else x) for x in parts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, opened, failed = None, None, None
        for b in batches:
            for p, clip, frames in zip(b.column("path").to_pylist(), b.column("clip_id").to_pylist(), b.column("frames").to_pylist(), strict=True):
                if p != path:
                    path, opened, failed = p, None, None
                    try:
                        opened = decoder(p)
                    except Exception as e:  # noqa: BLE001
                        failed = f"{type(e).__name__}: {e}"
                rows, error = [], failed
                if opened is not None:
                    try:
                        rows = [(k, x.tobytes(), list(x.shape), None) for k, x in enumerate(made(opened, frames))]
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                for part, data, shape, error in rows or [(0, None, None, error)]:
                    yield pa.RecordBatch.from_pydict({"path": pa.array([p], pa.string()), "clip_id": pa.array([clip], pa.int64()), "part": pa.array([part], pa.int32()), "data": pa.array([data], pa.binary()), "shape": pa.array([shape], pa.list_(pa.int32())), "error": pa.array([error], pa.string())})

    asked = plan.select("path", F.col("clip_id").cast("long").alias("clip_id"), F.col("frames").cast("array<long>").alias("frames"))
    dealt = asked.withColumn("_at", F.floor(F.array_min("frames") / stretch)).repartition("path", "_at").sortWithinPartitions("path", "_at", "clip_id").drop("_at")
    return dealt.mapInArrow(run, "path string, clip_id long, part int, data binary, shape array<int>, error string")


def collated(samples: DataFrame, batch: str, order: str, columns: list[str], collator: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row per batch, of collator(its samples in order); batches are bounded, as indexing or count_batches cut them."""
    names = StructType.fromDDL(schema).names
    kind = dict(samples.dtypes)[batch]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = collator(pdf.sort_values(order, ignore_index=True)[columns])
        return pd.DataFrame([{batch: pdf[batch].iloc[0]} | made])[[batch, *names]]

    return samples.select(*dict.fromkeys([batch, order, *columns])).groupBy(batch).applyInPandas(run, f"{batch} {kind}, {schema}")


def flat_map(df: DataFrame, function: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Rows of function(row) for each row; a row on which it raises gives one row with only error set."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    out += [x | {"error": None} for x in function(r)]
                except Exception as e:  # noqa: BLE001
                    out.append({"error": f"{type(e).__name__}: {e}"})
            if out:
                yield pd.DataFrame(out)

    names = StructType.fromDDL(schema).names
    ordered = lambda it: (p.reindex(columns=[*names, "error"]) for p in run(it))
    return df.mapInPandas(ordered, f"{schema}, error string")


def windows_udtf():
    """A table function (start, stop, size, step) -> one row per window, for use in SQL by lateral join."""

    @F.udtf(returnType="first long, last long")
    class Windows:
        def eval(self, start: int, stop: int, size: int, step: int):
            for first in range(start, stop - size + 1, step):
                yield first, first + size - 1

    return Windows


def no_nan(value: Column, what: str = "loss") -> Column:
    """value, or an error that stops the query where it is NaN."""
    return F.when(F.isnan(value), F.raise_error(F.lit(f"{what} is NaN"))).otherwise(value)
