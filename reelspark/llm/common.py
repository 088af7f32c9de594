"""Helpers that the operators of this subpackage share: tables, staged results, words, grouped batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern and its complement, the white space that parts words.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that scratch() gave out and that nobody has deleted yet, in order.
_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local master (tests, a notebook) gets a folder of its own; on a cluster it is an error, as
    executors do not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reelspark-"))
        base = spark.sparkContext.getCheckpointDir()
    _MADE.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _MADE[-1]


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _place(spark, path)
    return files.exists(where)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged result that nothing reads any more."""
    files, where = _place(spark, path)
    files.delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """The owner of what is staged inside: deleted at the end, so results must be written to a path made before."""
    mark = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[mark:]:
            discard(spark, path)


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing done before.

    A path of scratch() belongs to the workspace around the call; without one it stays until the caller discards it.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver happens to collect its garbage.

    Spark 4.1 does so for each write by itself; earlier versions do not know the setting and keep to their ways.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Commits:
    """Which parts of a folder count: a part is written under a fresh name first, and its row in path/commits last.

    What a failed or unfinished write left behind has no row there and is never read. One writer at a time.
    """

    SCHEMA = "version long, part string, note string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> list:
        """(version, part, note) in order; one row for each change since the last compaction, or earlier ones too."""
        at = f"{self.path}/commits"
        return sorted(self.spark.read.schema(self.SCHEMA).parquet(at).collect()) if exists(self.spark, at) else []

    def fresh(self) -> str:
        return uuid.uuid4().hex

    def add(self, version: int, part: str, note: str = "") -> None:
        self.spark.createDataFrame([(version, part, note)], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of the columns under different seeds, 128 bits together: the identity of a row's content."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_list(text: str | None) -> list[bytes]:
    """A-Z lower-cased words of the whole text; bytes.split() parts at exactly [\\x20\\x09-\\x0D]."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at its end the Python worker, which lives on for other tasks, gives free memory back."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, of at most rows rows and about size bytes of text, so that what Python makes of one stays small.

    A single row is never cut, however long it is.
    """
    for b in batches:
        length = np.zeros(b.num_rows, dtype=np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                length += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(length), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = min(rows, max(1, int(np.searchsorted(ends, before + size, side="right")) - at))
            yield b.slice(at, n)
            at += n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Chunks of a partition sorted by keys (integers, no nulls), each of whole groups, with the groups' bounds.

    Memory is bounded by one batch and the largest group.
    """
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    for b in batches:
        if b.num_rows == 0:
            continue
        same = held and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == b.column(k)[b.num_rows - 1].as_py() for k in keys)
        held.append(b)
        if same:
            continue
        t = pa.Table.from_batches(held)
        at = cut(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
            held = t.slice(at[-2]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, cut(t)
