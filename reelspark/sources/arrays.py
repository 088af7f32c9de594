"""Python data sources: npy manifests, trajectory folders, class folders of images, video metadata.

Each plans one partition per file or folder, so readers scale with files and a lost task rereads one of them.
Paths are read with the standard library or numpy on the executor that owns the partition; put the files on
storage that all executors mount.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FilePart(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Files(DataSourceReader):
    def __init__(self, options: dict, pattern: str):
        self.options, self.pattern = options, pattern

    def partitions(self) -> list[InputPartition]:
        given = [p for p in self.options.get("path", "").split(",") if p]
        found = [str(q) for p in given for q in (sorted(Path(p).glob(self.pattern)) if Path(p).is_dir() else [Path(p)])]
        return [FilePart(p, i) for i, p in enumerate(found)] or [FilePart("", -1)]


class NpyManifest(DataSource):
    """An .npy object array of paths: path, label 0, local_id."""

    @classmethod
    def name(cls) -> str:
        return "npy_manifest"

    def schema(self) -> str:
        return "path string, label int, local_id long"

    def reader(self, schema):
        return _NpyReader(self.options, "*.npy")


class _NpyReader(_Files):
    def read(self, partition: FilePart) -> Iterator[tuple]:
        import numpy as np

        if partition.number >= 0:
            # object arrays hold pickles: only numeric and string arrays are read unless the caller trusts the file
            values = np.load(partition.path, allow_pickle=self.options.get("trusted", "false") == "true")
            for i, v in enumerate(values.ravel().tolist()):
                yield (v if isinstance(v, str) else str(v)), 0, i


class TrajectoryFolder(DataSource):
    """Folders with a side-car *.json and a trajectory.npz (states [T, 6], gripper [T], extrinsics [T, 6])."""

    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        return "traj string, t int, state array<double>, extrinsic array<double>, meta string"

    def reader(self, schema):
        return _TrajectoryReader(self.options, "*")


def first_json(folder: str) -> dict | None:
    """The first side-car, by name, that parses; others are passed over."""
    for p in sorted(Path(folder).glob("*.json")):
        try:
            return json.loads(p.read_text())
        except ValueError:
            continue
    return None


class _TrajectoryReader(_Files):
    def read(self, partition: FilePart) -> Iterator[tuple]:
        import numpy as np

        if partition.number < 0:
            return
        file = Path(partition.path) / "trajectory.npz"
        if not file.exists():
            return
        meta = first_json(partition.path)
        with np.load(file) as data:
            states = np.concatenate([data["states"], data["gripper"].reshape(-1, 1)], axis=1).astype(float)
            for t, (s, e) in enumerate(zip(states.tolist(), data["extrinsics"].astype(float).tolist(), strict=True)):
                yield Path(partition.path).name, t, s, e, json.dumps(meta) if meta is not None else None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyManifest)
    spark.dataSource.register(TrajectoryFolder)


def class_folders(spark: SparkSession, root: str, index: bool = False) -> DataFrame:
    """Files under root/<class>/: path, class_name, target (by sorted class name), length; index adds rows per class."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    named = files.withColumn("class_name", F.element_at(F.split("path", "/"), -2))
    from ..operators.manifests import encode, vocabulary

    rows = encode(named, vocabulary(named, ["class_name"], "target"), ["class_name"], "target")
    return rows.groupBy("target", "class_name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths")) if index else rows


def json_sidecars(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The first side-car of each folder by file name, out of those that parse."""
    raw = spark.read.option("wholetext", "true").text(pattern).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"), F.try_parse_json("value").alias("ok"))
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    return raw.where("ok IS NOT NULL").groupBy(folder.alias("folder")).agg(F.min_by("j", "file").alias("j")).select("folder", "j.*")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of id -> label as rows (class_id, label)."""
    raw = spark.read.option("wholetext", "true").text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,string>"))).select(F.col("key").cast("int").alias("class_id"), F.col("value").alias("label"))
