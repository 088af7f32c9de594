"""MinHash near-dedup with HyperMinHash registers.

A document's set is its distinct word shingles, as 64-bit hashes; that sets are equal is told by 128 bits. The leading bits of a hash choose one of 128
buckets; of the least hash in a bucket the register keeps the number of leading zeros and the 10 bits that follow,
16 bits in all. Empty buckets borrow from others by a fixed probing order, so short texts have full sketches too.
Bands of four registers are the candidate keys. The registers of a candidate pair give a Jaccard estimate,
corrected for chance collisions of registers; pairs far below the threshold go, the others are confirmed on the
full sets.

Equal sets form one class, linked throughout, and only classes are compared. In a bucket each class is paired with
the least one first. Classes of a bucket that this leaves in different components are then compared with each
other, tile by tile on their registers, and those that may be linked across components gather in clusters, whose
full sets are intersected tile by tile. No step emits pairs of a group: tiles give each member the least one that
it is joined to. A link inside a component changes nothing, so groups of thousands of near copies stay cheap, and
no link between components is left out that shares a band.

Chance of missing a link at exactly 0.8 similarity: (1 - 0.8^4)^32, about 5e-8; less above it.

Defined results: a null text, or one without words, has the empty set, n_shingles 0, and links with nothing; fewer
words than a shingle form one shingle of the whole sequence; a null doc_id links with nothing, its component_id is
null and it is kept; repeated rows are equal copies, linked under their one id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mix64, slices, stage, table, whole_groups, word_list
from .components import connected_components, local_roots, settled, tiled

REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
BUCKET_BITS = 7
#: Chance that the registers of two different minima agree, at 10 mantissa bits.
COLLISION = 0.1699 / (1 << MANTISSA)
#: Members of a cluster that one tile of full sets holds.
SET_TILE = 256
#: A class of more copies than this fraction of all rows is broadcast to its rows; there are fewer such classes than this.
HOT_CLASSES = 10_000
#: An estimate may fall this many standard deviations below the threshold before its pair goes unconfirmed.
DEVIATIONS = 6.0
_PROBES = np.random.default_rng(6).integers(0, REGISTERS, size=(2048, REGISTERS))
_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


class WordHash(dict):
    """Word -> 64-bit hash, kept for the words met first, which are the frequent ones."""

    KEEP = 200_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.KEEP:
            self[word] = h
        return h


def shingle_set(text: str | None, words: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    ws = word_list(text)
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, ws), dtype=np.uint64, count=len(ws))
    size = min(words, len(h))
    out = mix64(h[: len(h) - size + 1] + np.uint64(size))
    for i in range(1, size):
        out = mix64(out ^ (h[i : len(h) - size + 1 + i] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)))
    return np.unique(out)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x 128 registers of non-empty sets."""
    least, full = np.zeros((len(sets), REGISTERS), dtype=np.uint64), np.zeros((len(sets), REGISTERS), dtype=bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _STARTS)
        got = s[np.minimum(at, len(s) - 1)]
        full[i] = (at < len(s)) & (got >= _STARTS) & (got >> np.uint64(64 - BUCKET_BITS) == np.arange(REGISTERS, dtype=np.uint64))
        least[i] = got
    rest = least << np.uint64(BUCKET_BITS)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    after = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | after).astype(np.uint16)
    row, col = np.nonzero(~full)
    for probe in _PROBES:
        if not len(row):
            break
        source = probe[col]
        ok = full[row, source]
        out[row[ok], col[ok]] = out[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row.tolist(), col.tolist(), strict=True):
        out[r, c] = out[r, np.flatnonzero(full[r])[0]]
    return out


def set_keys(members: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    raw = xxhash.xxh3_128_digest(members.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _profile(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in slices(batches):
            sets = [shingle_set(t.as_py(), words, memo) for t in b.column("text")]
            some = [s for s in sets if len(s)]
            regs = iter(registers(some)) if some else iter(())
            keys = [set_keys(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array([k for k, _ in keys], pa.int64()),
                    "set_check": pa.array([c for _, c in keys], pa.int64()),
                    "sketch": pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    return lean(run)


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"band": pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), "key": pa.array(keys), "set_key": pa.array(np.repeat(b.column("set_key").to_numpy(), BANDS))})


def least_estimate(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The corrected estimate below which a pair of sets, the smaller of these sizes, needs no confirmation."""
    filled = REGISTERS * -np.expm1(-np.maximum(sizes, 1) / REGISTERS)
    return threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))


def _estimate(share: np.ndarray) -> np.ndarray:
    return (share - COLLISION) / (1 - COLLISION)


def _plausible(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            small, large = (f(b.column("n_a").to_numpy(), b.column("n_b").to_numpy()) for f in (np.minimum, np.maximum))
            ok = (_estimate((x == y).mean(1)) >= least_estimate(small, threshold)) & (small >= threshold * large - 1e-6)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return lean(run)


def _tile_pairs(t: pa.Table, lo: int, hi: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a group of tiles that lie in different components and whose registers agree enough."""
    reg = np.frombuffer(b"".join(t.column("sketch").slice(lo, hi - lo).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    comp, n, side = (t.column(c).slice(lo, hi - lo).to_numpy() for c in ("component", "n_shingles", "side"))
    ti, tj = (t.column(c)[lo].as_py() for c in ("tile_i", "tile_j"))
    left, right = (np.flatnonzero(side == x) for x in (ti, tj))
    out = [np.empty((2, 0), dtype=np.int64)]
    for i in left.tolist():
        others = right[right > i] if ti == tj else right
        others = others[comp[others] != comp[i]]
        small = np.minimum(n[others], n[i])
        fits = small >= threshold * np.maximum(n[others], n[i]) - 1e-6
        others, small = others[fits], small[fits]
        if len(others):
            others = others[_estimate((reg[others] == reg[i]).mean(1)) >= least_estimate(small, threshold)]
            out.append(np.stack([np.full(len(others), i), others]))
    i, j = np.concatenate(out, axis=1)
    return i, j


def _joined(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Each joined member and the least-placed one that it is connected with: the pairs' components in linear size."""
    root = local_roots(len(key), i, j)
    some = np.flatnonzero(root != np.arange(len(key)))
    return pa.RecordBatch.from_pydict({"a": pa.array(key[some]), "b": pa.array(key[root[some]])})


def _cross(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["band", "key", "tile_i", "tile_j"]):
            key = t.column("set_key").to_numpy()
            for lo, hi in pairwise(at.tolist()):
                i, j = _tile_pairs(t, lo, hi, threshold)
                if len(i):
                    yield _joined(key[lo:hi], i, j)

    return lean(run)


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sets."""
    if len(i) <= 64:
        return np.array([len(sets[a]) + len(sets[b]) - len(np.union1d(sets[a], sets[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used.tolist()])
    _, item, times = np.unique(np.concatenate([sets[u] for u in used.tolist()]), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[item]
    owner, item = owner[keep], number[item[keep]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    both = np.zeros((len(used), len(used)), dtype=np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(item, [lo, lo + width])
        has = np.zeros((len(used), width), dtype=np.float32)
        has[owner[a:b], item[a:b] - lo] = 1
        both += has @ has.T
    x, y = place[: len(i)], place[len(i) :]
    return both[x, y].astype(np.int64)


def _confirm_tiles(threshold: float, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["cluster", "tile_i", "tile_j"]):
            key = t.column("set_key").to_numpy()
            for lo, hi in pairwise(at.tolist()):
                i, j = _tile_pairs(t, lo, hi, threshold)
                if not len(i):
                    continue
                sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("members").slice(lo, hi - lo)]
                sizes = np.array([len(x) for x in sets])
                both = _intersections(sets, i, j)
                ok = 100 * both >= percent * (sizes[i] + sizes[j] - both)
                if ok.any():
                    yield _joined(key[lo:hi], i[ok], j[ok])

    return lean(run)


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in slices(batches):
            made = [(k, shingle_set(t.as_py(), words, memo)) for k, t in zip(b.column("want").to_pylist(), b.column("text"), strict=True)]
            made = [(k, s) for k, s in made if k in ((own := set_keys(s))[0], own[0] ^ own[1])]
            yield pa.RecordBatch.from_pydict({"set_key": pa.array([k for k, _ in made], pa.int64()), "members": pa.array([s.tobytes() for _, s in made], pa.binary())})

    return lean(run)


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("members_a"), b.column("members_b"), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return lean(run)


class NearDuplicates:
    """Links and components of the near copies among docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, shingle_words: int = 5, percent: int = 80):
        self.docs, self.words, self.percent, self.threshold = docs.select("doc_id", "text"), shingle_words, percent, percent / 100
        self.profile = settled(stage(self.docs.mapInArrow(_profile(shingle_words), "doc_id long, n_shingles long, set_key long, set_check long, sketch binary")), "set_key", "set_check")
        some = self.profile.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        self.classes = stage(some.groupBy("set_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))

    def links(self) -> DataFrame:
        """Confirmed links (a, b) between classes: enough of them for the components, none that does not hold."""
        bands = self.classes.select("set_key", "sketch").mapInArrow(_bands, "band int, key long, set_key long")
        # staged, so that both sides of the join are plain exchanges and AQE can split a hot bucket
        buckets = stage(bands.groupBy("band", "key").agg(F.min("set_key").alias("low"), F.count("*").alias("n")).where("n > 1"))
        members = stage(bands.join(buckets, ["band", "key"]))
        tried = stage(members.where("set_key <> low").select(F.col("low").alias("a"), F.col("set_key").alias("b")).distinct())
        first = stage(self._confirmed(tried))
        comp = connected_components(first)
        open_ = (
            members.where("n > 2")
            .join(comp.withColumnRenamed("node", "set_key"), "set_key", "left")
            .withColumn("component", F.coalesce("component", "set_key"))
        )
        # staged like the buckets: members of a hot one are dealt anew
        mixed = stage(open_.groupBy("band", "key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("band", "key"))
        open_ = open_.join(mixed, ["band", "key"]).select("band", "key", "set_key", "component", "n")
        sketches = self.classes.select("set_key", "sketch", "n_shingles")
        near = stage(tiled(open_.join(sketches, "set_key"), ["band", "key"], "n", "set_key").mapInArrow(_cross(self.threshold), "a long, b long").distinct())
        if near.limit(1).count() == 0:
            return first
        clusters = connected_components(near).select(F.col("node").alias("set_key"), F.col("component").alias("cluster"))
        sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
        known = comp.withColumnRenamed("node", "set_key")
        inside = clusters.join(sizes, "cluster").join(known, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
        full = inside.join(sketches, "set_key").join(self._full_sets(clusters.select("set_key")), "set_key")
        return first.unionByName(tiled(full, ["cluster"], "n", "set_key", tile=SET_TILE).mapInArrow(_confirm_tiles(self.threshold, self.percent), "a long, b long"))

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        c = self.classes.select("set_key", "sketch", F.col("n_shingles").alias("n"))
        both = pairs
        for x in ("a", "b"):
            both = both.join(c.select(F.col("set_key").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n").alias(f"n_{x}")), x)
        return self._verified(stage(both.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(_plausible(self.threshold), "a long, b long")))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs that hold on the full sets."""
        sets = self._full_sets(pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct())
        both = pairs
        for x in ("a", "b"):
            both = both.join(sets.select(F.col("set_key").alias(x), F.col("members").alias(f"members_{x}")), x)
        return both.select("a", "b", "members_a", "members_b").mapInArrow(_confirm(self.percent), "a long, b long")

    def _full_sets(self, keys: DataFrame) -> DataFrame:
        """set_key, members of the distinct keys: made again from the texts of the documents that stand for them."""
        wanted = keys.join(self.classes.select("set_key", F.col("doc_id").alias("rep")), "set_key").withColumnRenamed("set_key", "want")
        texts = self.docs.join(wanted, self.docs["doc_id"] == wanted["rep"]).select("want", "text")
        return stage(texts.mapInArrow(_sets(self.words), "set_key long, members binary").dropDuplicates(["set_key"]))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of every row."""
        comp = connected_components(stage(self.links())).withColumnRenamed("node", "set_key")
        named = self.classes.select("set_key", "doc_id").join(comp, "set_key").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        found = comp.join(named, "component").select("set_key", "component_id")
        own = self.classes.select("set_key", "copies", F.col("doc_id").alias("_least"))
        classes = stage(own.join(found, "set_key", "left").select("set_key", "copies", F.coalesce("component_id", "_least").alias("component_id")))
        rows = self.profile.select("doc_id", "n_shingles", "set_key")
        # classes of many copies are looked up where their rows lie: fewer than HOT_CLASSES can have that share of all rows
        many = F.col("copies") * HOT_CLASSES > self.profile.count()
        member = F.col("doc_id").isNotNull() & F.col("set_key").isNotNull()
        tried = rows.where(member).join(F.broadcast(classes.where(many).drop("copies")), "set_key", "left")
        rest = tried.where("component_id IS NULL").drop("component_id").join(classes.where(~many).drop("copies"), "set_key")
        alone = rows.where(~member).withColumn("component_id", F.col("doc_id"))
        every = tried.where("component_id IS NOT NULL").unionByName(rest).unionByName(alone)
        return every.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    return NearDuplicates(docs, shingle_words, percent).result()


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def miss_chance(similarity: float) -> float:
    return math.pow(1 - similarity**ROWS, BANDS)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] ELSE ws END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
edges AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, least(w.doc_id, coalesce(low, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id
"""
