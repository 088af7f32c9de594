"""Line dedup, reversible: sharded cuckoo filters backed by exact reference-count tables.

`LineIndex` keeps the set of references (key, doc_id) as a log of changes, the exact table key -> documents and
largest document, and for each shard of the key space a cuckoo filter of the keys that are frequent enough to lose
lines. A change touches what its keys touch: it reads the references of these keys, appends what really changes to the
log and their new counts to the exact table, and puts keys into the filters, or takes them out, that cross the
threshold. Documents to be cleaned send their references to the filters, shard by shard; only hits are looked up in
the exact table, which has the last word, so a false positive costs a lookup and never a line.

The state is what the folder holds: parts count once their row is in path/commits, so an index is opened again by its
path, and what a failed change left behind is never read. One writer at a time.

A shard's references are dealt to groups of about GROUP rows, each with a copy of the shard's filter; keys that very
many documents hold are looked up in several copies of their row. Neither depends on how large the table is.

Keys are 128 bits of two hashes of the line's key. Lines of one document that share a key are one reference.

Defined results: inserting a reference that is there and deleting one that is not change nothing, so counts never go
below what documents hold and an insert may be repeated; deleting takes the references of the text that is given; a
null or empty text is one empty line; a null doc_id has no references, and its lines stay; rows that share a doc_id
are one document when documents are counted; repeated rows change nothing; an empty table gives an empty result;
other columns are kept by `apply` unless their names are those of its results.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Commits, lean, row_key, scratch, slices, stage, table

MIN_CHARS, MIN_DOCS = 40, 5
#: References that one group of a shard holds on average; an index has a shard for each SHARD_ROWS of its first load.
GROUP, SHARD_ROWS, MAX_SHARDS = 8192, 1 << 18, 1 << 16
#: Keys of more documents than this are looked up in several copies; at most HOT_KEYS keys are, whatever the table.
HOT, HOT_KEYS = 8192, 100_000
KEY = ["h1", "h2"]


class CuckooFilter:
    """Partial-key cuckoo filter: 4 slots a bucket, 16-bit fingerprints; grows by rebuilding from its keys' owner."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        need = max(2, int(capacity / self.SLOTS / 0.85) + 1)
        self.buckets = 1 << (need - 1).bit_length() if slots is None else len(slots) // self.SLOTS
        self.slots = np.zeros(self.buckets * self.SLOTS, dtype=np.uint16) if slots is None else slots

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self._print(keys)
        first = keys & np.uint64(self.buckets - 1)
        return p, first, first ^ self._turn(p)

    def _turn(self, p):
        return (p * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the table is too full; the caller then rebuilds it larger."""
        for p, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for kick in range(self.KICKS):
                free = [s for at in (a, b) for s in range(at * self.SLOTS, (at + 1) * self.SLOTS) if self.slots[s] == 0]
                if free:
                    self.slots[free[0]] = p
                    break
                out = b * self.SLOTS + (p + kick) % self.SLOTS
                p, self.slots[out] = int(self.slots[out]), p
                a, b = b, b ^ int(self._turn(np.uint64(p)))
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Only for keys that are in the filter."""
        for p, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for s in (*range(a * self.SLOTS, (a + 1) * self.SLOTS), *range(b * self.SLOTS, (b + 1) * self.SLOTS)):
                if self.slots[s] == p:
                    self.slots[s] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        table_ = self.slots.reshape(-1, self.SLOTS)
        p = p.astype(np.uint16)[:, None]
        return (table_[a.astype(np.int64)] == p).any(1) | (table_[b.astype(np.int64)] == p).any(1)


def line_key(line: Column) -> Column:
    """All [\\x20\\x09-\\x0D] stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: What a seed becomes in Spark's xxhash64(seed, key): the seed is hashed as four bytes under 42.
_SEEDS = tuple(xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42) for seed in (1, 2))


def python_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """(h1, h2) of a line in UTF-8, as references() has them; None if its key is short."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return tuple(x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(key, seed=s) for s in _SEEDS))


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id): the distinct long keys of each document."""
    long_keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(long_keys).alias("key"))
    first, second = row_key(F.col("key"))
    return keyed.select(first.alias("h1"), second.alias("h2"), "doc_id").distinct()


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")


LOG = "h1 long, h2 long, doc_id long, present boolean, version long"
EXACT = "h1 long, h2 long, n_docs long, last_doc long, version long"
FILTERS = "shard int, capacity long, slots binary, version long"


def _crossing(key, old: pa.Table, changes: pa.Table, schema: pa.Schema) -> pa.Table:
    """The shard's filter after its changes (h2, present); capacity -1 if the filter that is there has no room."""
    hashed, present = changes.column("h2").to_numpy().astype(np.uint64), changes.column("present").to_numpy(zero_copy_only=False).astype(bool)
    put, gone = hashed[present], hashed[~present]
    if old.num_rows:
        capacity, slots = old.column("capacity")[0].as_py(), np.frombuffer(old.column("slots")[0].as_py(), dtype=np.uint16).copy()
        f = CuckooFilter(capacity, slots)
        f.delete(gone)
        if not f.insert(put):
            capacity, f.slots = -1, np.zeros(0, dtype=np.uint16)
    else:
        capacity = max(64, 2 * len(put))
        while not (f := CuckooFilter(capacity)).insert(put):
            capacity *= 2
    return pa.table({"shard": [key[0].as_py()], "capacity": [capacity], "slots": [f.slots.tobytes()]}, schema=schema)


def _probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, part), the filter first in each; the references that hit it."""
    ready = None
    for b in batches:
        slots = b.column("slots")
        at = np.flatnonzero(pc.is_valid(slots).to_numpy(zero_copy_only=False))
        hashed = pc.fill_null(b.column("h2"), 0).to_numpy().astype(np.uint64)
        hit = np.zeros(b.num_rows, dtype=bool)
        for lo, hi in zip([0, *(at + 1).tolist()], [*at.tolist(), b.num_rows], strict=True):
            if lo and slots[lo - 1].is_valid:
                ready = CuckooFilter(0, np.frombuffer(slots[lo - 1].as_py(), dtype=np.uint16))
            if hi > lo and ready is not None:
                hit[lo:hi] = ready.contains(hashed[lo:hi])
        yield b.select(["h1", "h2", "doc_id"]).filter(pa.array(hit))


def _drop(min_chars: int):
    """Rows with _text and _drop (h1, h2 in turn, or null) -> n_lines, n_dropped, kept_text in place of both."""

    def one(text: bytes, flat: list[int]) -> tuple[int, bytes]:
        gone, lines = set(zip(flat[::2], flat[1::2], strict=True)), text.split(b"\n")
        known: dict[bytes, bool] = {}
        kept = []
        for line in lines:
            if len(line) < min_chars:
                kept.append(line)
                continue
            if line not in known:
                known[line] = python_key(line, min_chars) in gone
            if not known[line]:
                kept.append(line)
        return len(lines) - len(kept), b"\n".join(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            text, drop = pc.fill_null(b.column("_text"), ""), b.column("_drop")
            n_lines = pc.add(pc.cast(pc.count_substring(text, "\n"), pa.int64()), 1)
            dropped, at = np.zeros(b.num_rows, dtype=np.int64), np.flatnonzero(pc.is_valid(drop).to_numpy(zero_copy_only=False))
            if len(at):
                raw = pc.cast(text.take(pa.array(at)), pa.binary()).to_pylist()
                done = [one(t, d) for t, d in zip(raw, drop.take(pa.array(at)).to_pylist(), strict=True)]
                dropped[at] = [n for n, _ in done]
                mask = np.zeros(b.num_rows, dtype=bool)
                mask[at] = True
                text = pc.replace_with_mask(text, pa.array(mask), pc.cast(pa.array([k for _, k in done], pa.binary()), pa.string()))
            others = [n for n in b.schema.names if n not in ("_text", "_drop")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in others), n_lines, pa.array(dropped), text], [*others, "n_lines", "n_dropped", "kept_text"])

    return lean(run)


class LineIndex:
    """References, counts and filters in a shared folder; a second object on the same path goes on where the first ended."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None):
        """shards, min_docs and min_chars are settled by the first load; by default its size gives the number of shards."""
        self.spark, self.path = spark, path or scratch(spark)
        self.commits = Commits(spark, self.path)
        self.min_docs, self.min_chars, self.shards = min_docs, min_chars, shards
        self.parts: list[str] = []
        self.version = 0
        self.open()

    def open(self) -> LineIndex:
        """Read from the folder which parts count."""
        for version, part, note in self.commits.rows():
            made = json.loads(note)
            self.parts = [part] if made.get("whole") else [*self.parts, part]
            self.version = version
            self.min_docs, self.min_chars, self.shards = made["min_docs"], made["min_chars"], made["shards"]
        return self

    def _read(self, kind: str, schema: str) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}/{kind}" for p in self.parts))

    def log(self) -> DataFrame:
        """The references that are there: h1, h2, doc_id."""
        return self._present(self._read("log", LOG))

    def _present(self, log: DataFrame) -> DataFrame:
        if len(self.parts) <= 1:
            return log.where("present").select(*KEY, "doc_id")
        return log.groupBy(*KEY, "doc_id").agg(F.max_by("present", "version").alias("present")).where("present").select(*KEY, "doc_id")

    def counts(self) -> DataFrame:
        """The exact table: h1, h2, n_docs, last_doc."""
        return self._latest(self._read("exact", EXACT)).where("n_docs > 0")

    def _latest(self, exact: DataFrame) -> DataFrame:
        if len(self.parts) <= 1:
            return exact.drop("version")
        return exact.groupBy(*KEY).agg(F.max(F.struct("version", "n_docs", "last_doc")).alias("x")).select(*KEY, "x.n_docs", "x.last_doc")

    def filters(self) -> DataFrame:
        """shard, capacity, slots: a row per shard that ever had a frequent key."""
        found = self._read("filters", FILTERS)
        if len(self.parts) <= 1:
            return found.drop("version")
        return found.groupBy("shard").agg(F.max_by(F.struct("capacity", "slots"), "version").alias("x")).select("shard", "x.*")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, True)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, False)

    def _change(self, docs: DataFrame, present: bool) -> LineIndex:
        if not self.parts and not present:
            return self
        version, part = self.version + 1, self.commits.fresh()
        at = f"{self.path}/{part}"
        delta = references(docs, self.min_chars)
        mark = lambda df: df.withColumns({"present": F.lit(present), "version": F.lit(version).cast("long")})
        if self.parts:
            delta = stage(delta, f"{at}/asked")
            touched = delta.select(*KEY).distinct()
            held = stage(self._present(self._read("log", LOG).join(touched, KEY, "left_semi")), f"{at}/held")
            changed = delta.join(held, [*KEY, "doc_id"], "left_anti" if present else "left_semi")
            changed = stage(mark(changed), f"{at}/log").select(*KEY, "doc_id")
            after = held.unionByName(changed) if present else held.join(changed, [*KEY, "doc_id"], "left_anti")
            fresh = touched.join(self._counted(after), KEY, "left").fillna(0, ["n_docs"])
            before = self._latest(self._read("exact", EXACT).join(touched, KEY, "left_semi")).select(*KEY, F.col("n_docs").alias("before"))
        else:
            delta = stage(mark(delta), f"{at}/log").select(*KEY, "doc_id")
            fresh, before = self._counted(delta), self.spark.createDataFrame([], "h1 long, h2 long, before long")
        exact = stage(fresh.withColumn("version", F.lit(version).cast("long")), f"{at}/exact")
        if not self.shards:
            n = exact.agg(F.sum("n_docs")).first()[0] or 0
            self.shards = min(MAX_SHARDS, max(16, 1 << (n // SHARD_ROWS).bit_length()))
        crossed = exact.join(before, KEY, "left") if self.parts else exact.withColumn("before", F.lit(0))
        now, was = F.col("n_docs") >= self.min_docs, F.coalesce("before", F.lit(0)) >= self.min_docs
        self._write_filters(crossed.where(now != was).select(shard_of(self.shards), "h2", now.alias("present")), part, version)
        self.commits.add(version, part, self._note())
        self.parts, self.version = [*self.parts, part], version
        return self

    def _note(self, **more) -> str:
        return json.dumps({"min_docs": self.min_docs, "min_chars": self.min_chars, "shards": self.shards, **more})

    @staticmethod
    def _counted(refs: DataFrame) -> DataFrame:
        return refs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def _write_filters(self, change: DataFrame, part: str, version: int) -> None:
        """New filters of the shards in change (shard, h2, present); one without room is built anew from the exact table."""
        schema = pa.schema([("shard", pa.int32()), ("capacity", pa.int64()), ("slots", pa.binary())])
        kind = "shard int, capacity long, slots binary"
        at = f"{self.path}/{part}"
        dated = lambda df: df.withColumn("version", F.lit(version).cast("long"))
        none = self.spark.createDataFrame([], kind)
        build = lambda k, a, b: _crossing(k, a, b, schema) if b.num_rows else none_
        none_ = schema.empty_table()
        if not self.parts:
            stage(dated(none.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(build, kind)), f"{at}/filters")
            return
        made = stage(self.filters().groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(build, kind), f"{at}/tried")
        full = made.where("capacity < 0").select("shard")
        every = self.spark.read.schema(EXACT).parquet(*(f"{self.path}/{p}/exact" for p in (*self.parts, part)))
        latest = every.groupBy(*KEY).agg(F.max_by("n_docs", "version").alias("n_docs")).where(F.col("n_docs") >= self.min_docs)
        members = latest.select(shard_of(self.shards), "h2", F.lit(True).alias("present")).join(full, "shard", "left_semi")
        anew = none.groupBy("shard").cogroup(members.groupBy("shard")).applyInArrow(build, kind)
        stage(dated(made.where("capacity >= 0").unionByName(anew)), f"{at}/filters")

    def compact(self) -> LineIndex:
        """All parts as one, so that reading costs what the state holds and not how often it changed; earlier parts stay as files."""
        if len(self.parts) > 1:
            version, part = self.version + 1, self.commits.fresh()
            for kind, df in (("log", self.log().withColumn("present", F.lit(True))), ("exact", self.counts()), ("filters", self.filters())):
                stage(df.withColumn("version", F.lit(version).cast("long")), f"{self.path}/{part}/{kind}")
            self.commits.add(version, part, self._note(whole=True))
            self.parts, self.version = [part], version
        return self

    def droppable(self, refs: DataFrame) -> DataFrame:
        """(h1, h2, doc_id) of the references that lose their lines: frequent keys outside the last document that holds them."""
        if not self.parts:
            return refs.limit(0)
        sharded = refs.withColumn("shard", shard_of(self.shards))
        filters = self.filters().select("shard", "slots")
        sizes = sharded.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))  # MAX_SHARDS rows at most
        sizes = F.broadcast(sizes.join(filters.select("shard"), "shard"))
        probes = sharded.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int").alias("part"), *KEY, "doc_id", F.lit(None).cast("binary").alias("slots"))
        copies = filters.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), *(F.lit(None).cast("long").alias(c) for c in (*KEY, "doc_id")), "slots")
        dealt = copies.unionByName(probes).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("slots").isNull())
        hits = dealt.mapInArrow(lean(_probe), "h1 long, h2 long, doc_id long")
        exact = self.counts().where(F.col("n_docs") >= self.min_docs)
        total = exact.agg(F.sum("n_docs")).first()[0] or 0
        hot = max(HOT, total // HOT_KEYS)
        copies = F.ceil(F.col("n_docs") / hot).cast("int")
        many = F.broadcast(exact.where(F.col("n_docs") > hot).select(*KEY, copies.alias("copies")))  # at most HOT_KEYS rows
        salted = hits.join(many, KEY, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        rows = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        return salted.join(rows, [*KEY, "salt"]).where("doc_id < last_doc").select(*KEY, "doc_id")

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """docs with n_lines, n_dropped and kept_text; docs needs doc_id and text. refs: their references, if they are at hand."""
        refs = references(docs, self.min_chars) if refs is None else refs
        pair = F.flatten(F.collect_list(F.array(*KEY)))  # no more than the document's lines
        drops = self.droppable(refs).groupBy(F.col("doc_id").alias("_id")).agg(pair.alias("_drop"))
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
        inner = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)), F.col("text").alias("_text"), F.col("doc_id").alias("_doc"))
        joined = inner.join(drops, F.col("_doc") == F.col("_id"), "left").drop("_id", "_doc")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("_text", "_drop"))
        done = joined.mapInArrow(_drop(self.min_chars), f"{fields}, n_lines long, n_dropped long, kept_text string")
        return done.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)), "n_lines", "n_dropped", "kept_text")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row of docs, over an index of docs themselves."""
    slim = docs.select("doc_id", "text")
    index = LineIndex(docs.sparkSession, min_docs=min_docs, min_chars=min_chars).insert(slim)
    return index.apply(slim, index.log()).select("doc_id", "n_lines", "n_dropped", "kept_text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line, length(parts) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, f.k IS NOT NULL AND doc_id < f.last_doc AS gone FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
)
SELECT doc_id, max(n)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
