"""Distributed connected components, and pairs of tiles for comparing the members of a bucket.

Components: each partition of edges is first contracted by a local union-find to a star forest, then large-star
and small-star steps alternate until all that is left are stars, each node linked to its least one alone. No step
holds a node's neighbours in memory: minima are partial aggregates. The join of the edges with the minima sorts, and
spills, the edges of a hot node in one task. Every round is staged, and the one before it is deleted then.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, stage

EDGE = "u long, v long"
#: Members of a bucket that one tile holds; a task compares at most two tiles at a time.
TILE = 1024


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The star forest of a partition's edges: (node, least node of its local component)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x], x = top, p
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        out = [(n, r) for n in part if (r := root(n)) != n]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["u", "v"])


def _is_stars(e: DataFrame) -> bool:
    """Whether no node of the edges (u, v), u > v, has two lower neighbours, or a lower and a higher one."""
    ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 OR (up = 1 AND n > 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge in edges (two long columns); component is its least node.

    Null ends and loops are ignored; repeated edges count once; no edges, no rows.
    """
    u, v = edges.columns
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    path = scratch(edges.sparkSession)
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_contract, EDGE).distinct(), path)
    both = F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    while not _is_stars(e):
        ends = e.select(both)
        least = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # one exchange by the larger end serves the distinct, the minima and the join; a node has few lower neighbours left
        large = ends.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        path, before = scratch(edges.sparkSession), path
        e = stage(small.where("u <> v").distinct(), path)
        discard(edges.sparkSession, before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def settled(rows: DataFrame, key: str, check: str) -> DataFrame:
    """rows without check, with keys that stand for one (key, check) each: 64 bits, told apart by 64 more.

    Two values of check under one key are hardly ever met; such keys then become key xor check.
    """
    twins = rows.groupBy(key).agg(F.min(check).alias("_lo"), F.max(check).alias("_hi")).where("_lo <> _hi").select(F.col(key).alias("_twin"))
    if twins.limit(1).count() == 0:
        return rows.drop(check)
    named = rows.join(twins, F.col(key) == F.col("_twin"), "left")
    return named.withColumn(key, F.when(F.col("_twin").isNotNull(), F.col(key).bitwiseXOR(F.col(check))).otherwise(F.col(key))).drop("_twin", check)


def tiled(members: DataFrame, keys: list[str], count: str, member: str, tile: int = TILE) -> DataFrame:
    """members dealt to pairs of tiles: every two members of a bucket meet in exactly one (keys, tile_i, tile_j).

    Adds tile_i <= tile_j and side, the member's own tile. Where tile_i = tile_j all pairs of the group are meant,
    elsewhere those of different sides. A bucket of n members becomes about (n / tile)^2 / 2 tasks' worth of
    bounded groups instead of one; rows are sorted by group within partitions.
    """
    tiles = F.ceil(F.col(count) / tile).cast("int")
    dealt = (
        members.withColumn("side", F.pmod(F.xxhash64(member), tiles).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumns({"tile_i": F.least("side", "_other"), "tile_j": F.greatest("side", "_other")})
        .drop("_other")
    )
    by = [*keys, "tile_i", "tile_j"]
    return dealt.repartition(*by).sortWithinPartitions(*by)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1, the least node of each one's component under the pairs (left, right)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
