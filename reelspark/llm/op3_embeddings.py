"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

A table's key is the signs of a vector against its hyperplanes. Members of a bucket meet twice, in tiles. First only
sketches travel, the signs against SKETCH further hyperplanes: who has nobody in the bucket within the distance that
signs of linked vectors keep leaves it. Vectors go only to the buckets where somebody is left, and are compared by
their exact cosines in double precision; a pair that also met in an earlier table is counted there only. No pair is
emitted: a tile gives each vector its number of links and the least member of its local component.

The number of bits follows the number of vectors, the number of tables follows the bits: the chance to miss a
link at exactly the threshold is below MISS, and less above it; sketches miss one in 10^11 at most.

Equal vectors, told by 128 bits, are one class with a multiplicity, so a vector that is copied a million times is
compared once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
n_links 0, a component of their own, kept; vectors of different lengths are never linked; a null vec_id links with
nothing, component_id null, kept; repeated rows are other vectors of the same id and link; an empty table gives an
empty result; labels and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, row_key, stage, table, whole_groups
from .components import connected_components, local_roots, settled, tiled

THRESHOLD, MISS = 0.95, 1e-4
#: Vectors that a bucket holds on average, in data without clusters.
BUCKET = 64
#: Signs of a sketch, and by how many standard deviations those of linked vectors may differ more than they do on average.
SKETCH, DEVIATIONS = 512, 7.0


def shape(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - hit))


def _vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values as double and the length of each vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64), np.asarray(column.value_lengths(), dtype=np.int64)


def most_apart(threshold: float) -> int:
    """Signs in which the sketches of linked vectors differ at most."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


def _sign(bits: int, tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                flat, lengths = _vectors(part.column("embedding"))
                starts = np.concatenate([[0], np.cumsum(lengths)])
                keys = np.zeros((part.num_rows, tables), dtype=np.int32)
                sketch: list[bytes] = [b""] * part.num_rows
                for dim in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == dim)
                    x = flat[starts[rows][:, None] + np.arange(dim)]
                    if dim not in planes:
                        planes[dim] = np.concatenate([np.random.default_rng([seed, dim]).standard_normal((dim, n)) for seed, n in ((3, tables * bits), (4, SKETCH))], axis=1)
                    signs = x @ planes[dim] > 0
                    keys[rows] = (signs[:, :-SKETCH].reshape(len(rows), tables, bits) * weights).sum(2)
                    for row, packed in zip(rows.tolist(), np.packbits(signs[:, -SKETCH:], axis=1), strict=True):
                        sketch[row] = packed.tobytes()
                yield pa.RecordBatch.from_pydict({"cid": part.column("cid"), "copies": part.column("copies"), "dim": pa.array(lengths.astype(np.int32)), "keys": pa.array(list(keys), pa.list_(pa.int32())), "sketch": pa.array(sketch, pa.binary()), "embedding": part.column("embedding")})

    return lean(run)


def _near(threshold: float):
    """Members of a group of tiles that have another one within most_apart(threshold) signs."""
    least = SKETCH - 2 * most_apart(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["dim", "tab", "key", "tile_i", "tile_j"]):
            side, ti, tj = (t.column(c).to_numpy() for c in ("side", "tile_i", "tile_j"))
            raw = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH // 8)
            live = np.zeros(t.num_rows, dtype=bool)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                x = np.unpackbits(raw[lo:hi], axis=1).astype(np.float32) * 2 - 1
                if ti[lo] == tj[lo]:
                    close = x @ x.T >= least
                    np.fill_diagonal(close, False)
                    live[lo:hi] = close.any(1)
                else:
                    a, b = (np.flatnonzero(side[lo:hi] == s) for s in (ti[lo], tj[lo]))
                    close = x[a] @ x[b].T >= least
                    live[lo + a[close.any(1)]] = True
                    live[lo + b[close.any(0)]] = True
            if live.any():
                yield from t.select(["dim", "tab", "key", "cid"]).filter(pa.array(live)).to_batches()

    return lean(run)


def _compare(threshold: float, tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["dim", "tab", "key", "tile_i", "tile_j"]):
            dims, tabs, side, ti, tj, cid, copies = (t.column(c).to_numpy() for c in ("dim", "tab", "side", "tile_i", "tile_j", "cid", "copies"))
            flat, lengths = _vectors(t.column("embedding"))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            keys = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(-1, tables)
            out = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                x = flat[starts[lo] : starts[hi]].reshape(hi - lo, dims[lo])
                x = x / np.sqrt((x * x).sum(1))[:, None]
                if ti[lo] == tj[lo]:
                    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                else:
                    a, b = (np.flatnonzero(side[lo:hi] == s) for s in (ti[lo], tj[lo]))
                    i, j = np.nonzero(x[a] @ x[b].T >= threshold)
                    i, j = a[i], b[j]
                k = keys[lo:hi]
                for earlier in range(tabs[lo]):
                    if not len(i):
                        break
                    new = k[i, earlier] != k[j, earlier]
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                own = copies[lo:hi]
                links = np.bincount(i, weights=own[j], minlength=hi - lo) + np.bincount(j, weights=own[i], minlength=hi - lo)
                root = local_roots(hi - lo, i, j)
                some = np.flatnonzero(links)
                out.append((cid[lo:hi][some], links[some].astype(np.int64), cid[lo:hi][root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["cid", "links", "root"])

    return lean(run)


def embedding_links(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links per class, components of classes) of rows with cid and embedding; both keyed by cid."""
    classes = stage(rows.groupBy("cid").agg(F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    bits, tables = shape(classes.count(), threshold)
    signed = stage(classes.mapInArrow(_sign(bits, tables), "cid long, copies long, dim int, keys array<int>, sketch binary, embedding " + classes.schema["embedding"].dataType.simpleString()))
    bucket = ["dim", "tab", "key"]
    dealt = signed.select("dim", "cid", "sketch", F.posexplode("keys").alias("tab", "key"))
    counts = stage(dealt.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"))
    live = stage(tiled(dealt.join(counts, bucket), bucket, "n", "cid").mapInArrow(_near(threshold), "dim int, tab int, key int, cid long").distinct())
    counts = stage(live.groupBy(*bucket).agg(F.count("*").alias("n")))
    whole = live.join(counts, bucket).join(signed.select("cid", "copies", "keys", "embedding"), "cid")
    found = stage(tiled(whole, bucket, "n", "cid").mapInArrow(_compare(threshold, tables), "cid long, links long, root long"))
    return found.groupBy("cid").agg(F.sum("links").alias("links")), connected_components(found.select("cid", "root"))


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    fine = F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()
    first, second = row_key(F.col("embedding"))
    rows = settled(rows.withColumns({"cid": F.when(fine, first), "check": F.when(fine, second)}), "cid", "check")
    links, comp = embedding_links(rows.where("cid IS NOT NULL"), threshold)
    ids = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    ids = stage(ids.join(links, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    named = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    known = ids.join(named, "component").select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cid").join(known, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT v.vec_id, (SELECT count(*) FROM edges WHERE a = v.vec_id)::BIGINT AS n_links, least(v.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = v.vec_id), v.vec_id)) AS component_id,
  least(v.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = v.vec_id), v.vec_id)) = v.vec_id AS kept FROM v
"""
