"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

Texts are tokenised once and the ids staged. Counts of all ids, one row per id of the vocabulary, give the code
lengths by package-merge; the codes are canonical, so a table of lengths is the whole code book. Documents are
dealt out by ranges of doc_id, sorted, and packed into files of about FILE_IDS ids.

A file is one binary value, so it can live in any store that Spark writes (here a Parquet folder, one file per
row). Its layout, little-endian: magic "HUF2"; uint32 documents, uint32 how many of them, the first ones, have no doc_id; uint64 ids, uint64 ids of the partition before
this file, uint32 ids per block, uint32 blocks; int64 doc_id and uint32 length of each document; uint64 bit offset
of each block; the bits, most significant first. Blocks decode independently from their bit-offset checkpoints;
the decoder steps through all blocks of a file at once, one table lookup per id.

Limits: a document lies in one file, and Spark's binary values end at 2 GB, so one document may have some 10^9 ids; a
vocabulary may have 2^24 ids, as codes have at most 25 bits, and no fewer than it takes to tell its ids apart.

Defined results: a null or empty text is the end id alone; null doc_ids come first, ties of doc_id are ordered by
their ids; repeated rows are written each; an empty table gives no documents; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, scratch, slices, stage, table

FILE_IDS, BLOCK_IDS, MAX_BITS = 1 << 19, 1 << 9, 18
#: Bytes of text that are encoded together; a worker holds some 50 times as much meanwhile.
PIECE_BYTES = 2 << 20
MAGIC, HEAD = b"HUF2", "<4sIIQQII"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies show bytes that are not printable as the letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}


BYTES = _byte_letters()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at starts, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    kind = np.int32 if max(len(flat), int(ends[-1])) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(ends[-1], dtype=kind)
    return flat[at]


class Encoder:
    """Ids of texts, the same as the tokenizer's encode(text, add_special_tokens=False).

    No token, special or not, reaches over a space or a line feed in tokenizers that drop white space, so a text's
    ids are those of its pieces between them, and a batch's distinct pieces are enough. Pieces of Latin-1 letters
    and ASCII marks after them go to the tokenizer's model in these two parts, as its pre-tokeniser would give them;
    other pieces are encoded together, parted by a lone NUL that is a token of its own. Ids of parts met lately are
    kept. A tokenizer without these properties, which are tried on examples, encodes whole texts.
    """

    #: Parts whose ids are kept, and new ones that go to the tokenizer together: what it returns is many times their size.
    KEEP, TOGETHER = 400_000, 10_000
    PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
    TRIES = ("Ab \0\n cD", "Élan vît, ÀÖØöøÿß. The end. (x) Don't, 'S it's: <|endoftext|> a_b É1é x--", " a  b\n\nc, ")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(path)
        self.model = self.one.model
        self.kind = np.dtype("<u2") if self.one.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        nul = self.ids("\0")
        self.part = nul[0] if len(nul) == 1 else None
        self.rows: dict[str, int] = {}
        self.starts, self.lengths, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)
        if self.part is not None and any(self.encode(pa.array([t]), 0)[0].tolist()[:-1] != self.ids(t) for t in self.TRIES):
            self.part = None

    def ids(self, text: str) -> list[int]:
        return self.one.encode(text, add_special_tokens=False).ids

    def _shrink(self) -> None:
        """Keep the half that was met first: frequent parts come early."""
        n = self.KEEP // 2
        self.rows = dict(itertools.islice(self.rows.items(), n))
        self.starts, self.lengths = self.starts[:n].copy(), self.lengths[:n].copy()
        self.flat = self.flat[: int(self.starts[-1] + self.lengths[-1])].copy()

    def _learn(self, names: Sequence[str], ids: list[list[int]]) -> None:
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.rows.update(zip(names, range(len(self.rows), len(self.rows) + len(names)), strict=True))
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], dtype=self.kind)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def _plain(self, parts: pa.Array) -> np.ndarray:
        """Rows of parts that are pre-tokens as they are; null and empty parts have no ids."""
        enc = parts.dictionary_encode()
        names = enc.dictionary.to_pylist()
        new = [n for n in names if n and n not in self.rows]
        tokenize = self.model.tokenize
        for some in itertools.batched(new, self.TOGETHER):
            self._learn(some, [[t.id for t in tokenize(n if n.isascii() else n.encode().decode("latin-1").translate(BYTES))] for n in some])
        rows = np.array([self.rows[n] if n else -1 for n in names] + [-1], dtype=np.int64)
        return rows[enc.indices.fill_null(len(names)).to_numpy()]

    def _other(self, pieces: list[str]) -> np.ndarray:
        """Rows of whole pieces; their keys begin with a space, which no part does."""
        new = [p for p in pieces if p and " " + p not in self.rows]
        odd, rest = [p for p in new if "\0" in p], [p for p in new if "\0" not in p]
        for some in itertools.batched(rest, self.TOGETHER):
            found: list[list[int]] = [[]]
            for i in self.ids(" \0 ".join(some)):
                if i == self.part:
                    found.append([])
                else:
                    found[-1].append(i)
            self._learn([" " + p for p in some], found)
        if odd:
            self._learn([" " + p for p in odd], [self.ids(p) for p in odd])
        return np.array([self.rows[" " + p] if p else -1 for p in pieces], dtype=np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end_id after each; number of ids of each text, end_id included)."""
        texts = pc.fill_null(texts, "")
        if self.part is None:
            each = [[*self.ids(t), end_id] for t in texts.to_pylist()]
            return np.array([i for x in each for i in x], dtype=self.kind), np.array([len(x) for x in each], dtype=np.int64)
        if len(self.rows) > self.KEEP:
            self._shrink()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        enc = split.flatten().dictionary_encode()
        pieces, at = enc.dictionary, enc.indices.to_numpy()
        two = pc.extract_regex(pieces, self.PLAIN)
        other = np.flatnonzero(pc.is_null(two).to_numpy(zero_copy_only=False))
        letters, marks = (pc.if_else(pc.is_valid(two), pc.struct_field(two, [i]), pa.scalar("")) for i in (0, 1))
        rows = np.stack([self._plain(pc.utf8_lower(letters)), self._plain(marks)], axis=1)
        rows[other, 0] = self._other(pieces.take(pa.array(other)).to_pylist())
        rows = rows.ravel()
        lengths = np.where(rows >= 0, self.lengths[rows], 0)
        flat = gather(self.flat, np.where(rows >= 0, self.starts[rows], 0), lengths)
        sizes = lengths.reshape(-1, 2).sum(1)
        own = sizes[at]
        ids = gather(flat, (np.cumsum(sizes) - sizes)[at], own)
        words = np.asarray(split.value_lengths(), dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(upto) + 1
        out = np.empty(len(ids) + len(counts), dtype=self.kind)
        last = np.zeros(len(out), dtype=bool)
        last[np.cumsum(counts) - 1] = True
        out[last], out[~last] = end_id, ids
        return out, counts


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that tasks after the first find its pieces."""
    return Encoder(path)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << 24:
        raise ValueError(f"{n} symbols need codes of more than 25 bits")
    limit = max(limit, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, merged = [], leaves
    is_leaf = np.ones(n, dtype=bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged, is_leaf = both[by], by < n
    lengths, need = np.zeros(n, dtype=np.int64), 2 * n - 2
    for flags in reversed(levels):
        used = int(flags[:need].sum())
        lengths[:used] += 1
        need = 2 * (need - used)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code book: symbols ordered by (length, id) get consecutive codes."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.sizes = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.sizes.max(initial=1))
        self.codes, code, last = np.zeros(len(order), dtype=np.uint64), 0, 0
        for i, size in enumerate(self.sizes.tolist()):
            code <<= size - last
            self.codes[i], last = code, size
            code += 1

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        top = int(self.symbols.max(initial=0)) + 1
        code, size = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.int64)
        code[self.symbols], size[self.symbols] = self.codes, self.sizes
        return code, size

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for every value of the next self.bits bits."""
        spread = 1 << (self.bits - self.sizes)
        symbol, size = np.zeros(1 << self.bits, dtype=np.uint32), np.zeros(1 << self.bits, dtype=np.int32)
        total = int(spread.sum())
        symbol[:total], size[:total] = np.repeat(self.symbols, spread), np.repeat(self.sizes, spread)
        return symbol, size


def pack(ids: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of each block) of ids."""
    n = size[ids]
    ends = np.cumsum(n)
    at = ends - n
    value, word = code[ids], at >> 6
    shift = 64 - (at & 63) - n
    fits = shift >= 0
    high = np.where(fits, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    words = np.zeros(int(ends[-1] + 63 >> 6) + 1, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.add.reduceat(high, first)
    over = np.flatnonzero(~fits)
    words[word[over] + 1] |= value[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[::BLOCK_IDS].astype(np.uint64)


def unpack(bits: bytes, offsets: np.ndarray, n: int, code: Code, tables: tuple[np.ndarray, np.ndarray], block: int = BLOCK_IDS) -> np.ndarray:
    """The n ids of a file; every step decodes the next id of all blocks."""
    symbol, size = tables
    raw = np.frombuffer(bits + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    next32 = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at, out = offsets.astype(np.int32 if len(bits) < 1 << 28 else np.int64), np.zeros((block, len(offsets)), dtype=np.uint32)
    last = n - (len(offsets) - 1) * block
    mask, room = np.uint32((1 << code.bits) - 1), 32 - code.bits
    for step in range(block):
        if step == last and len(at):
            at = at[:-1]
        if not len(at):
            break
        window = next32[at >> 3] >> (room - (at & 7)).astype(np.uint32) & mask
        out[step, : len(at)] = symbol[window]
        at = at + size[window]
    return out.T.reshape(-1)[:n]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            at = 0
            while at < b.num_rows:
                ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column("text").slice(at)), 0), dtype=np.int64))
                n = max(1, int(np.searchsorted(ends, PIECE_BYTES, side="right")))
                part = b.slice(at, n)
                ids, counts = enc.encode(part.column("text"), end_id)
                offsets = np.concatenate([[0], np.cumsum(counts) * enc.kind.itemsize]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])], ["doc_id", "ids"])
                at += n

    return lean(run)


def _count(kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in slices(batches, 1 << 16):
            c = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype=kind))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), dtype=np.int64)])
            total[: len(c)] += c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return lean(run)


def _write(symbols: np.ndarray, lengths: np.ndarray, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, size = Code(symbols, lengths).encoder()
        part, before, number = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            nonlocal before, number
            ids = np.concatenate(held).astype(np.int64)
            bits, offsets = pack(ids, code, size)
            body = struct.pack(HEAD, MAGIC, len(docs), docs.count(None), len(ids), before, BLOCK_IDS, len(offsets)) + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([len(h) for h in held], "<u4").tobytes() + offsets.astype("<u8").tobytes() + bits
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "body": pa.array([body], pa.binary())})
            before, number = before + len(ids), number + 1
            docs.clear()
            held.clear()
            return row

        waiting = 0
        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                docs.append(doc)
                held.append(np.frombuffer(raw.as_py(), dtype=kind))
                waiting += len(held[-1])
                if waiting >= FILE_IDS:
                    yield file()
                    waiting = 0
        if held:
            yield file()

    return lean(run)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> str:
    """Write doc_id and text of docs as token files under path: path/files and path/codes."""
    tokenizer = tokenizer or tokenizer_path()
    kind = encoder(tokenizer).kind.str
    ids = stage(docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, ids binary"))
    counts = ids.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    symbols, lengths = counts["id"].to_numpy(np.int64), code_lengths(counts["n"].to_numpy(np.int64))
    spark = docs.sparkSession
    spark.createDataFrame([(int(s), int(n)) for s, n in zip(symbols, lengths, strict=True)], "id long, bits long").coalesce(1).write.parquet(f"{path}/codes")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(_write(symbols, lengths, kind), "part int, number int, n_ids long, body binary").write.option("compression", "uncompressed").parquet(f"{path}/files")
    return path


def _read(symbols: np.ndarray, lengths: np.ndarray, base: dict[int, int], digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(symbols, lengths)
        tables = code.decoder()
        for b in batches:
            for part, body in zip(b.column("part").to_pylist(), b.column("body"), strict=True):
                raw = body.as_buffer()
                magic, n_docs, n_null, n_ids, before, block, blocks = struct.unpack_from(HEAD, raw)
                if magic != MAGIC:
                    raise ValueError("not a token file")
                at = struct.calcsize(HEAD)
                docs = np.frombuffer(raw, "<i8", n_docs, at)
                sizes = np.frombuffer(raw, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
                offsets = np.frombuffer(raw, "<u8", blocks, at + 12 * n_docs)
                ids = unpack(memoryview(raw)[at + 12 * n_docs + 8 * blocks :].tobytes(), offsets, n_ids, code, tables, block).astype("<u4")
                ends = np.cumsum(sizes)
                for lo in range(0, n_docs, 2000):
                    hi = min(lo + 2000, n_docs)
                    start = (base[part] + before + ends - sizes)[lo:hi]
                    rows = {"doc_id": pa.array(docs[lo:hi], mask=np.arange(lo, hi) < n_null), "start": pa.array(start), "n_tokens": pa.array(sizes[lo:hi])}
                    cut = [ids[e - n : e] for e, n in zip(ends[lo:hi].tolist(), sizes[lo:hi].tolist(), strict=True)]
                    rows["ids_crc32" if digest else "ids"] = pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()) if digest else pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(rows)

    return lean(run)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids, or with digest ids_crc32, of every document in the files.

    One number per range partition and the code book, one row per id of the vocabulary, come to the driver.
    """
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").toPandas()
    files = spark.read.schema("part int, number int, n_ids long, body binary").parquet(f"{path}/files")
    base, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[r.part] = total
        total += r.n
    last = "ids_crc32 long" if digest else "ids array<long>"
    return files.select("part", "body").mapInArrow(_read(codes["id"].to_numpy(np.int64), codes["bits"].to_numpy(np.int64), base, digest), f"doc_id long, start long, n_tokens long, {last}")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def token_output(docs: DataFrame) -> DataFrame:
    return read_token_files(docs.sparkSession, write_token_files(docs, scratch(docs.sparkSession)), digest=True)
