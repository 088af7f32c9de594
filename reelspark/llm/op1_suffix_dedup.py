"""Suffix-array dedup of byte strings of WINDOW bytes, by a common-prefix-aware distributed merge sort.

Which suffixes are sorted. Every window of 200 bytes has an anchor: the leftmost of its 64-byte grams with the
least hash. Equal windows have their anchors at equal offsets, and neighbouring windows mostly share one, so a
sparse suffix array over anchors, about one in 70 bytes, stands for all windows. A run is the windows of one text
that share an anchor: the suffix from the anchor on, the context before it, and the range of offsets. Anchors whose
gram occurs once in the corpus are dropped before any text moves; none of their windows can repeat.

How they are sorted. Each task sorts its suffixes, folds equal runs into one, front-codes the rest (length of the
prefix shared with the one before, then the remainder) and sends one such block to each range of grams. A range
merges its blocks with a loser tree whose nodes hold the loser and its common prefix with the winner: strings are
compared from there on only, and most matches are settled by the two lengths alone. The merge yields the sorted
suffixes with their LCP array; the contexts are sorted alike from the anchor backwards. Windows at offset o are
equal exactly where both arrays say so: the last o bytes before, and the next 200 - o bytes.

A gram that very many runs share (HOT) is not one range's work: its runs are cut into bands of offsets, narrow at both
ends, and a band goes to the range of the bytes that all its windows share. What is common then folds into few
entries, and what differs goes apart.

Equal strings are compared as strings throughout; hashes only choose anchors and, 128 bits of them, ids of rows.

Defined results: a null text is empty; texts shorter than the window keep all bytes; a null doc_id keeps its row;
repeated rows are texts of their own, and so lose whatever is as long as the window; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, mix64, scratch, slices, stage, swept, table

WINDOW, GRAM = 200, 64
#: Windows of one text that are looked at together, and bytes of text gathered before they are.
CHUNK = 1 << 20
#: Bytes of suffixes that a task sorts at a time, and suffixes that a range compares at a time.
SORT_BYTES, COMPARE = 24 << 20, 20_000
#: Runs of one gram beyond which they are cut into bands.
HOT = 8192
HOT_FLAG = 1 << 62
_INDEX = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(1).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on."""
    h, width = _TABLE[data], 1
    for factor in _FACTORS:
        h = h[:-width] * factor + h[width:]
        width *= 2
    return mix64(h)


def anchored_runs(data: np.ndarray, ranges: list[tuple[int, int]], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, gram hash) of each run; ranges are the (start, end) of texts in data."""
    none = np.empty(0, np.int64)
    if len(data) < window or not any(e - s >= window for s, e in ranges):
        return none, none, none, np.empty(0, np.uint64)
    grams = gram_hashes(data)
    low = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)
    need, width = window - GRAM + 1, 1
    while width * 2 <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(data) - window + 1], low[need - width :][: len(data) - window + 1])
    anchor = (low & _INDEX).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, dtype=bool)
    begin = np.zeros(len(anchor) + 1, dtype=bool)
    for s, e in ranges:
        if e - s >= window:
            valid[s : e - window + 1] = True
            begin[s] = True
    begin[1:-1] |= anchor[1:] != anchor[:-1]
    begin &= valid
    first = np.flatnonzero(begin)
    stop = begin | ~valid
    ends = np.flatnonzero(stop)
    last = ends[np.searchsorted(ends, first, side="right")] - 1
    return first, last, anchor[first], grams[anchor[first]]


def _profile(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            n = len(rows)
            found: list[list[tuple]] = [[] for _ in range(n)]
            pieces, where, size = [], [], 0

            def look() -> None:
                first, last, anchor, gram = anchored_runs(np.frombuffer(b"".join(pieces), np.uint8), [(at, at + length) for _, _, at, length in where], window)
                starts = np.array([at for _, _, at, _ in where])
                own = np.searchsorted(starts, first, side="right") - 1
                cuts = np.searchsorted(own, np.arange(len(where) + 1))
                for k, (row, offset, at, _) in enumerate(where):
                    a, b = cuts[k], cuts[k + 1]
                    place = first[a:b] + (offset - at) << 16 | anchor[a:b] - first[a:b] << 8 | last[a:b] - first[a:b]
                    found[row].append((place, gram[a:b].view(np.int64)))

            for i, (_, _, body) in enumerate(rows):
                for offset in range(0, max(len(body) - window + 1, 0), CHUNK):
                    piece = body[offset : offset + CHUNK + window - 1]
                    pieces.append(piece)
                    where.append((i, offset, size, len(piece)))
                    size += len(piece)
                    if size >= CHUNK:
                        look()
                        pieces, where, size = [], [], 0
            if where:
                look()
            merged = [[np.concatenate(c) for c in zip(*f, strict=True)] if f else [np.empty(0, np.int64)] * 2 for f in found]
            lists = {name: pa.array([m[k] for m in merged], pa.list_(pa.int64())) for k, name in enumerate(("place", "gram"))}
            return pa.RecordBatch.from_pydict(
                {
                    "rid": pa.array([r for r, _, _ in rows], pa.binary()),
                    "doc_id": pa.array([d for _, d, _ in rows], pa.int64()),
                    "n_bytes": pa.array([len(b) for _, _, b in rows], pa.int64()),
                    "sha": [hashlib.sha256(b).hexdigest() for _, _, b in rows],
                    **lists,
                }
            )

        for b in slices(batches):
            rows, size = [], 0
            for row in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("body").to_pylist(), strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= CHUNK:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    return lean(run)


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, which are known to share at bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "little") ^ int.from_bytes(b[at:n], "little")
    return n if x == 0 else at + ((x & -x).bit_length() - 1 >> 3)


def put_number(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def front_code(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """Sorted entries (suffix, context, many, rid, first) as one compressed block."""
    out, before = bytearray(), b""
    for suffix, context, many, rid, first in entries:
        lcp = shared(before, suffix)
        for n in (lcp, len(suffix) - lcp, len(context), many):
            put_number(out, n)
        out += suffix[lcp:]
        out += context
        if not many:
            out += rid.to_bytes(16, "little")
            put_number(out, first)
        before = suffix
    return zstandard.ZstdCompressor(level=1).compress(bytes(out))


def front_decode(block: bytes) -> Iterator[tuple[bytes, int, bytes, int, int, int]]:
    """(suffix, lcp with the one before, context, many, rid, first) in order."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, end, before = 0, len(raw), b""
    while at < end:
        numbers = []
        for _ in range(4):
            n, shift = 0, 0
            while (x := raw[at]) > 127:
                n |= (x & 127) << shift
                shift += 7
                at += 1
            numbers.append(n | x << shift)
            at += 1
        lcp, rest, size, many = numbers
        suffix = before[:lcp] + raw[at : at + rest]
        at += rest
        context = raw[at : at + size]
        at += size
        rid = first = 0
        if not many:
            rid = int.from_bytes(raw[at : at + 16], "little")
            at += 16
            shift = 0
            while (x := raw[at]) > 127:
                first |= (x & 127) << shift
                shift += 7
                at += 1
            first |= x << shift
            at += 1
        yield suffix, lcp, context, many, rid, first
        before = suffix


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of (suffix, lcp with the run's one before, ...); lcp of the output is with the output's one before.

    A loser tree: lcp[i] is what run i's head shares with the last winner on its path, so of two heads the one
    that shares more with it is the lesser, and only at equal lengths are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's lcp becomes the one with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if lcp[a] > lcp[b]:
            return a, b
        if lcp[b] > lcp[a]:
            return b, a
        s, t = x[0], y[0]
        n = shared(s, t, lcp[a])
        if n < len(s) and (n == len(t) or s[n] > t[n]):
            lcp[a] = n
            return b, a
        lcp[b] = n
        return a, b

    level = list(range(k))
    base = k
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            w, out = play(level[i], level[i + 1])
            loser[base + i // 2] = out
            up.append(w)
        level = up
    winner = level[0]
    while heads[winner] is not None:
        x = heads[winner]
        yield (x[0], lcp[winner], *x[2:])
        heads[winner] = x = next(runs[winner], None)
        if x is not None:
            lcp[winner] = x[1]
        node = winner + k >> 1
        while node:
            winner, loser[node] = play(winner, loser[node])
            node >>= 1


def bands(window: int) -> list[tuple[int, int]]:
    """Ranges [lo, hi) of offsets whose widths double from either end."""
    top = window - GRAM + 1
    steps = [1 << k for k in range(top.bit_length()) if 1 << k <= top // 2]
    return list(pairwise(sorted({0, *steps, *(top - x for x in steps), top})))


def _send(window: int, ranges: int):
    """Rows with text and runs -> blocks for the ranges, intervals known already, and the texts that have runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[bool, list[tuple[int, int]]]] = {}
        cuts, size = bands(window), 0

        def flush() -> Iterator[pa.RecordBatch]:
            entries: dict[tuple[bytes, bytes], tuple[int, tuple[int, int] | None]] = {}
            rid, lo, hi = [], [], []

            def known(suffix: bytes, context: bytes, place: tuple[int, int]) -> None:
                rid.append(place[0].to_bytes(16, "little"))
                lo.append(place[1])
                hi.append(place[1] + len(context) + len(suffix))

            def put(suffix: bytes, context: bytes, common: bytes, place: tuple[int, int] | None) -> None:
                """place is None if the windows are known to repeat; so are those of an entry that comes again."""
                if (suffix, context) in entries:
                    part, other = entries[suffix, context]
                    for x in (place, other):
                        if x is not None:
                            known(suffix, context, x)
                    entries[suffix, context] = part, None
                else:
                    entries[suffix, context] = xxhash.xxh3_64_intdigest(common) % ranges, place

            for (suffix, context), (hot, places) in held.items():
                if len(places) > 1:  # all windows of a run that occurs twice repeat
                    for place in places:
                        known(suffix, context, place)
                one = places[0] if len(places) == 1 else None
                if not hot:
                    put(suffix, context, suffix[:GRAM], one)
                    continue
                for a, b in cuts:
                    if max(a, window - len(suffix)) <= min(b - 1, len(context)):
                        before = context[max(0, len(context) - b + 1) :]
                        common = context[len(context) - a :] + suffix[: window - b + 1]
                        put(suffix[: window - a], before, common, one and (one[0], one[1] + len(context) - len(before)))
            blocks: dict[int, list[tuple]] = {}
            for suffix, context in sorted(entries):
                part, place = entries[suffix, context]
                blocks.setdefault(part, []).append((suffix, context, int(place is None), *(place or (0, 0))))
            for part, block in blocks.items():
                yield row(part=[part], block=[front_code(block)])
            if rid:
                yield row(rid=rid, lo=lo, hi=hi)

        for b in slices(batches):
            for r, body, places in zip(b.column("rid").to_pylist(), b.column("body").to_pylist(), b.column("runs").to_pylist(), strict=True):
                yield row(rid=[r], text=[zstandard.ZstdCompressor(level=3).compress(body)])
                for p in places:
                    hot, p = bool(p & HOT_FLAG), p & ~HOT_FLAG
                    first, anchor, last = p >> 16, (p >> 16) + (p >> 8 & 255), (p >> 16) + (p & 255)
                    key = body[anchor : last + window], body[first:anchor]
                    if key not in held:
                        size += (300 + len(key[0]) + len(key[1])) * (8 if hot else 1)
                        held[key] = hot, []
                    held[key][1].append((int.from_bytes(r, "little"), first))
                    size += 100
                if size > SORT_BYTES:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    return lean(run)


SENT = pa.schema([("part", pa.int32()), ("block", pa.binary()), ("rid", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("text", pa.binary())])


def row(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in SENT], schema=SENT)


def repeated_windows(entries: list[tuple], window: int = WINDOW) -> tuple[list[int], list[int], list[int]]:
    """(rid, lo, hi) of the bytes under repeated windows; entries are whole groups of merged (suffix, lcp, context, many, rid, first)."""
    n = len(entries)
    lcp_right = np.array([e[1] for e in entries])
    lcp_right[0] = 0
    group = np.cumsum(lcp_right < GRAM)
    alone = np.bincount(group)[group] < 2
    right, left = (np.array([len(e[i]) for e in entries]) for i in (0, 2))
    many = np.array([e[3] for e in entries], dtype=np.int64)
    backwards = [e[2][::-1] for e in entries]
    groups = group.tolist()
    order = sorted(range(n), key=lambda i: (groups[i], backwards[i]))
    lcp_left = np.array([-1] + [shared(backwards[i], backwards[j]) if groups[i] == groups[j] else -1 for i, j in pairwise(order)])
    order = np.array(order)
    hit = np.zeros((n, window - GRAM + 2), dtype=bool)
    live = np.flatnonzero(~alone)
    for o in range(window - GRAM + 1):
        at = live[(window - right[live] <= o) & (o <= left[live])]
        if len(at) < 2:
            continue
        side = np.empty(n, dtype=np.int64)
        side[order] = np.cumsum(lcp_left < o)
        key = np.cumsum(lcp_right < window - o)[at] * (n + 1) + side[at]
        _, own, times = np.unique(key, return_inverse=True, return_counts=True)
        if many[at].any():
            times = np.bincount(own, weights=1 + many[at])
        hit[at, o] = times[own] > 1
    hit[many > 0] = False
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), hit.astype(np.int8)], axis=1), axis=1)
    who, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)  # offsets start .. stop - 1, of the same rows in the same order
    rid = [entries[w][4] for w in who.tolist()]
    anchor = np.array([e[5] + len(e[2]) for e in entries])[who]
    return rid, (anchor - stop + 1).tolist(), (anchor - start + window).tolist()


def _merge(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
            entries: list[tuple] = []
            for e in merge_runs([front_decode(x) for x in blocks]):
                if len(entries) >= COMPARE and e[1] < GRAM:
                    yield row_of(*repeated_windows(entries, window))
                    entries = []
                entries.append(e)
            if entries:
                yield row_of(*repeated_windows(entries, window))

        def row_of(rid: list[int], lo: list[int], hi: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.to_bytes(16, "little") for r in rid], pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["rid", "lo", "hi"])

        part, blocks = None, []
        for b in batches:
            for p, block in zip(b.column("part").to_pylist(), b.column("block").to_pylist(), strict=True):
                if p != part and blocks:
                    yield from settle(blocks)
                    blocks = []
                part = p
                blocks.append(block)
        if blocks:
            yield from settle(blocks)

    return lean(run)


def _cut(text: Callable[[bytes], bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: dict[str, list] = {"rid": [], "n_removed": [], "n_spans": [], "kept": []}
            for rid, packed, spans in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                body, kept, at, removed, n = text(packed), [], 0, 0, 0
                end = -1
                for s in sorted((s["lo"], s["hi"]) for s in spans):
                    if s[0] > end:
                        n += 1
                        kept.append(body[max(end, 0) : s[0]])
                        removed += s[1] - s[0]
                        end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        end = s[1]
                kept.append(body[max(end, 0) :])
                for name, value in zip(out, (rid, removed, n, b"".join(kept)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["rid"], pa.binary()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary())], list(out))

    return lean(run)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def body_of(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def row_id(doc_id: Column, text: Column) -> Column:
    """16 bytes for a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))))


class SuffixDedup:
    """Repeated byte strings of docs (doc_id, text) and what is left without them."""

    def __init__(self, docs: DataFrame, window: int = WINDOW):
        if not 2 * GRAM <= window <= GRAM + 255:
            raise ValueError("the window must hold two grams, and its offsets must fit in a byte")
        self.window, self.spark = window, docs.sparkSession
        self.rows = docs.select(row_id(F.col("doc_id"), F.col("text")).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), body_of(F.col("text")).alias("body"))
        lists = "place array<long>, gram array<long>"  # a run is its first window << 16, and the anchor and last window behind it in 8 bits each
        self.profile = stage(self.rows.mapInArrow(_profile(window), f"rid binary, doc_id long, n_bytes long, sha string, {lists}"))

    def intervals(self) -> tuple[DataFrame, DataFrame]:
        """((rid, lo, hi) under repeated windows, packed texts of the rows that may have some)."""
        runs = self.profile.select("rid", F.inline(F.arrays_zip("place", "gram")))
        ranges = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        at, kept_at = scratch(self.spark), scratch(self.spark)
        with swept(self.spark):  # the grams' shuffles are gone before the texts move, and the texts' before the blocks do
            # staged, so that both sides of the join are plain exchanges and AQE can split a hot gram
            again = stage(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", F.when(F.col("n") > HOT, HOT_FLAG).otherwise(0).alias("flag")), at)
            kept = stage(runs.join(again, "gram").groupBy("rid").agg(F.collect_set(F.col("place") + F.col("flag")).alias("runs")), kept_at)
            discard(self.spark, at)
            sent = stage(self.rows.join(kept, "rid").select("rid", "body", "runs").mapInArrow(_send(self.window, ranges), "part int, block binary, rid binary, lo int, hi int, text binary"))
            discard(self.spark, kept_at)
        merged = sent.where("part IS NOT NULL").select("part", "block").repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(_merge(self.window), "rid binary, lo int, hi int")
        return merged.unionByName(sent.where("lo IS NOT NULL").select("rid", "lo", "hi")), sent.where("text IS NOT NULL").select("rid", "text")

    def removed(self) -> DataFrame:
        """rid, n_removed, n_spans, kept (bytes) of the rows that lose something."""
        found, texts = self.intervals()
        spans = found.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
        return texts.dropDuplicates(["rid"]).join(spans, "rid").select("rid", "text", "spans").mapInArrow(_cut(_unpack), "rid binary, n_removed long, n_spans long, kept binary")

    def digests(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
        lost = self.removed().select("rid", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
        return self.profile.select("rid", "doc_id", "n_bytes", "sha").join(lost, "rid", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SuffixDedup(table(spark, sf_dir, "documents")).digests()
