"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A text holds an item if the item can be laid on it so that some stretch of WINDOW of the item's words (the whole item,
if it is shorter) has 0.8 of its words equal in place. A seed is a few words at the fixed positions of a mask, which
ignores the positions between; seeds of texts and items are joined by hash, and the words around each hit decide.

The masks miss nothing at a similarity of 0.8 or more. Eleven words with at most two replaced hold six in a row with
at most one replaced, so five of those six are a seed; this covers every stretch of 13 and all items of eleven and
more. Of ten words only the replacement of the fifth and sixth is left, which a mask of its own ignores; items of six
to nine words may have one word replaced, items of five too, for which masks of four words ignore each in turn; items
of one to four words are their own seed. Masks that no item needs, by its length, are left out.

An item's seed is joined under its context, the up to 12 words before it and 18 from it on: places of items with equal
contexts are one, however many items share a passage and however often it comes again. A hit takes the same stretch
of the text and compares word by word, so its cost does not depend on the length of item or text. Items are cut into
pieces of PIECE words, overlapping by a context, and texts alike before their seeds are taken.

Benchmark seeds are counted before they are broadcast; above SEED_ROWS the joins shuffle instead. So are the rows that
name the texts with hits, above HIT_ROWS.

Defined results: null texts and null items have no words and are never reported; rows that share a doc_id are one
document in `overlaps`, reported by its best overlap, but each a row of its own in `clean`; a null doc_id or item_id is
reported as an id of its own; repeated rows change nothing; ties between stretches go to the first place in the text;
an empty table gives an empty result; other columns are ignored by `overlaps` and kept by `clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, row_key, stage, table

WINDOW, SIMILARITY = 13, 0.8
#: Benchmark seeds of at most this many rows are broadcast, and names of texts with hits.
SEED_ROWS, HIT_ROWS = 500_000, 500_000
#: Words of a text or an item whose seeds are made in one row.
PIECE = 4096


@dataclass(frozen=True)
class Mask:
    """Word positions of a seed, the lengths of the items that it serves, and where in an item it is taken (None: all over)."""

    words: tuple[int, ...]
    least: int
    most: int | None = None
    at: tuple[int, ...] | None = None

    @property
    def second(self) -> int:
        return self.words[1] if len(self.words) > 1 else 0


MASKS = (
    Mask((0, 1, 2, 3, 4), 6), Mask((0, 1, 2, 3, 5), 6), Mask((0, 1, 2, 4, 5), 6), Mask((0, 1, 3, 4, 5), 6), Mask((0, 2, 3, 4, 5), 6),
    Mask((0, 1, 2, 3, 6), 10, 10, (0,)),
    Mask((0, 1, 2, 3), 4, 5, (0, 1)), Mask((0, 1, 2, 4), 5, 5, (0,)), Mask((0, 1, 3, 4), 5, 5, (0,)), Mask((0, 2, 3, 4), 5, 5, (0,)),
    Mask((0, 1, 2), 3, 3, (0,)), Mask((0, 1), 2, 2, (0,)), Mask((0,), 1, 1, (0,)),
)
SPAN = 7
#: Words of a context before a seed's first word, and from it on.
BEFORE, AFTER = WINDOW - 1, SPAN + WINDOW - 1


def word_hashes(text: Column) -> Column:
    """Hashes of the A-Z lower-cased words [^\\x20\\x09-\\x0D]+ of a text."""
    words = F.split(F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), SPACE, -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def pieces(rows: DataFrame, before: int = 0, after: int = SPAN - 1) -> DataFrame:
    """rows with hashes cut into from_word and piece: PIECE words, and as many before and after them as asked for.

    A piece's first word is number from_word - least(from_word, before) of the text.
    """
    cut = rows.withColumn("from_word", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(PIECE))))
    lead = F.least(F.col("from_word"), F.lit(before))
    return cut.withColumn("piece", F.slice("hashes", F.col("from_word") - lead + 1, lead + PIECE + after)).drop("hashes")


def seeds(rows: DataFrame, span: int) -> DataFrame:
    """rows (hashes) by position: pos, w0, w1, ...: the span words from each position on, null beyond the end."""
    cut = pieces(rows.where(F.size("hashes") > 0), 0, span - 1)
    others = [c for c in cut.columns if c not in ("from_word", "piece")]
    shifted = F.slice(F.arrays_zip(*(F.slice("piece", i + 1, PIECE + span).alias(f"w{i}") for i in range(span))), 1, PIECE)
    placed = cut.select(*others, "from_word", F.posexplode(shifted).alias("in_piece", "at"))
    return placed.select(*others, (F.col("from_word") + F.col("in_piece")).alias("pos"), *(F.col(f"at.w{i}").alias(f"w{i}") for i in range(span)))


def seed_of(mask: Mask, number: int) -> Column:
    """(mask, seed), or null where the text ends before the mask does."""
    return F.when(F.col(f"w{mask.words[-1]}").isNotNull(), F.struct(F.lit(number).alias("mask"), F.xxhash64(*(F.col(f"w{p}") for p in mask.words)).alias("seed")))


def _pair(second: int) -> Column:
    return F.xxhash64("w0", f"w{second}", F.lit(second))


def around(hashes: Column, pos: Column) -> Column:
    """The words of a context, null where the text has none."""
    return F.transform(F.sequence(F.lit(-BEFORE), F.lit(AFTER - 1)), lambda i: F.get(hashes, pos + i))


class Benchmark:
    """Items by seed and context: what all texts are held against."""

    def __init__(self, benchmark: DataFrame):
        """benchmark: item_id, text."""
        items = stage(benchmark.select("item_id", word_hashes(F.col("text")).alias("hashes")).where(F.size("hashes") > 0))
        lengths = items.groupBy(F.least(F.size("hashes"), F.lit(11)).alias("n")).agg(F.sum(F.size("hashes")).alias("words")).collect()  # eleven rows at most
        have = {r.n for r in lengths}
        self.masks = {i: m for i, m in enumerate(MASKS) if any(m.least <= n and (m.most is None or n <= m.most) for n in have)}
        self.span = 1 + max((m.words[-1] for m in self.masks.values()), default=0)
        self.small = sum(r.words for r in lengths) * 5 <= SEED_ROWS
        n_item = F.size("hashes").alias("n_item")
        placed = pieces(items.select("item_id", n_item, "hashes"), BEFORE, AFTER)
        lead = F.least(F.col("from_word"), F.lit(BEFORE))
        own = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.col("n_item") - F.col("from_word")) - 1)
        placed = placed.select("item_id", "n_item", F.inline(F.transform(own, lambda i: F.struct((F.col("from_word") + i).alias("item_pos"), around(F.col("piece"), lead + i).alias("context")))))
        # hashes of arrays pass over nulls; with these three numbers they are told apart
        limits = (F.least("n_item", F.lit(WINDOW)), F.least("item_pos", F.lit(BEFORE)), F.least(F.col("n_item") - F.col("item_pos"), F.lit(AFTER)))
        first, second = row_key(*limits, F.col("context"))
        words = [F.get("context", F.lit(BEFORE + i)).alias(f"w{i}") for i in range(self.span)]
        placed = stage(placed.select("item_id", "n_item", "item_pos", first.alias("c1"), second.alias("c2"), "context", *words))
        served = lambda m: F.col("n_item").between(m.least, m.most or (1 << 31) - 1) & (F.col("item_pos").isin(*m.at) if m.at else F.lit(True))
        keys = F.array(*(F.when(served(m), seed_of(m, i)) for i, m in self.masks.items())) if self.masks else F.array(F.when(F.lit(False), F.struct(F.lit(0).alias("mask"), F.lit(0).cast("long").alias("seed"))))
        self.wanted = stage(placed.select(F.inline(F.filter(keys, lambda x: x.isNotNull())), "c1", "c2", *words).distinct())
        # contexts without a seed of their own (the last words of an item) are never hit
        self.contexts = placed.select("c1", "c2", "context", F.least("n_item", F.lit(WINDOW)).alias("size")).dropDuplicates(["c1", "c2"])
        self.members = placed.select("c1", "c2", "item_id", "n_item").distinct()

    def known(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def hits(self, docs: DataFrame) -> DataFrame:
        """r1, r2, pos, c1, c2: places of rows of docs (r1, r2, hashes) where a seed agrees with one under a context."""
        train = seeds(docs, self.span).join(self.known(self.wanted.select("w0").distinct()), "w0", "left_semi")
        by_second: dict[int, list[int]] = {}
        for i, m in self.masks.items():
            by_second.setdefault(m.second, []).append(i)
        for second, numbers in sorted(by_second.items()):
            pairs = self.wanted.where(F.col("mask").isin(numbers)).select(_pair(second).alias("_pair"), F.lit(True).alias(f"go{second}")).distinct()
            train = train.withColumn("_pair", _pair(second)).join(self.known(pairs), "_pair", "left").drop("_pair")
        keys = F.array(*(F.when(F.col(f"go{m.second}"), seed_of(m, i)) for i, m in self.masks.items()))
        keyed = train.where(" OR ".join(f"go{s}" for s in sorted(by_second))).select("r1", "r2", "pos", F.inline(F.filter(keys, lambda x: x.isNotNull())))
        return keyed.join(self.known(self.wanted.select("mask", "seed", "c1", "c2")), ["mask", "seed"]).select("r1", "r2", "pos", "c1", "c2").distinct()


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, r1, r2: equal texts are one row to search in, whatever their ids."""
    first, second = row_key(F.col("text"))
    return docs.select("doc_id", "text", first.alias("r1"), second.alias("r2"))


def laid(docs: DataFrame, bench: Benchmark, similarity: float) -> DataFrame:
    """r1, r2, c1, c2, matched, size, doc_start: the best stretch at each context that is similar enough."""
    if similarity < 0.8:
        raise ValueError("the masks find all overlaps from a similarity of 0.8 on only")
    if not bench.masks:
        return docs.sparkSession.createDataFrame([], "r1 long, r2 long, c1 long, c2 long, matched long, size int, doc_start long")
    rows = _named(docs)
    found = stage(bench.hits(rows.select("r1", "r2", word_hashes(F.col("text")).alias("hashes"))))
    places = stage(found.groupBy("r1", "r2").agg(F.collect_set("pos").alias("places")))  # at most the words of the row
    few = places.limit(HIT_ROWS + 1).count() <= HIT_ROWS
    named = rows.join(F.broadcast(places.select("r1", "r2")) if few else places.select("r1", "r2"), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    texts = stage(named.select("r1", "r2", word_hashes(F.col("text")).alias("hashes")))
    seen = texts.join(places, ["r1", "r2"]).select("r1", "r2", F.inline(F.transform("places", lambda p: F.struct(p.alias("pos"), around(F.col("hashes"), p).alias("here")))))
    both = found.join(seen, ["r1", "r2", "pos"]).join(bench.contexts, ["c1", "c2"])
    same = [F.when(F.get("here", F.lit(i)) == F.get("context", F.lit(i)), 1).otherwise(0).alias(f"e{i}") for i in range(BEFORE + AFTER)]
    has = lambda i: F.get("context", F.lit(i)).isNotNull()
    whole = [(has(s) & has(s + WINDOW - 1)).alias(f"s{s}") for s in range(BEFORE + 1)]
    first = F.array_position(F.transform("context", lambda w: w.isNotNull()), True).cast("int") - 1
    flat = both.select("r1", "r2", "c1", "c2", "pos", "size", first.alias("first"), *same, *whole)
    add = lambda ids: sum((F.col(f"e{i}") for i in ids), F.lit(0))
    # the more words match the better, then the further left the better
    windows = [F.when(F.col(f"s{s}"), add(range(s, s + WINDOW)) * 32 + (31 - s)) for s in range(BEFORE + 1)]
    best = F.when(F.col("size") == WINDOW, F.greatest(*windows)).otherwise(add(range(BEFORE + AFTER)) * 32 + 31 - F.col("first"))
    scored = flat.select("r1", "r2", "c1", "c2", "size", "pos", best.alias("best"))
    matched, start = F.floor(F.col("best") / 32), F.col("pos") - BEFORE + 31 - F.col("best") % 32
    return scored.select("r1", "r2", "c1", "c2", matched.cast("long").alias("matched"), "size", start.cast("long").alias("doc_start")).where(F.col("matched") >= F.lit(similarity) * F.col("size"))


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, overlap, matched, doc_start, n_item: the best verified overlap of each pair that has one.

    docs: doc_id, text. benchmark: item_id, text. doc_start is the word of the text on which the best stretch begins; it
    is negative where the stretch, less than all of which matches, reaches over the beginning.
    """
    bench = Benchmark(benchmark)
    best = laid(docs, bench, similarity).groupBy("r1", "r2", "c1", "c2", "size").agg(F.max(F.struct("matched", (-F.col("doc_start")).alias("back"))).alias("b"))
    ids = _named(docs).select("doc_id", "r1", "r2")
    best = stage(best.select("r1", "r2", "c1", "c2", (F.col("b.matched") / F.col("size")).alias("overlap"), "b.matched", "b.back"))
    names = best.select("r1", "r2").distinct()
    few = names.limit(HIT_ROWS + 1).count() <= HIT_ROWS
    ids = stage(ids.join(F.broadcast(names) if few else names, ["r1", "r2"], "left_semi").distinct())
    rows = best.join(ids, ["r1", "r2"]).join(bench.members, ["c1", "c2"])
    top = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "matched", "back", F.col("n_item").cast("long").alias("n_item"))).alias("b"))
    return top.select("doc_id", "item_id", "b.overlap", "b.matched", (-F.col("b.back")).alias("doc_start"), "b.n_item")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = 1) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns, whatever their names) that hold no item of least_words words or more."""
    bench = Benchmark(benchmark.where(F.size(word_hashes(F.col("text"))) >= least_words))
    gone = stage(laid(docs, bench, similarity).select("r1", "r2").distinct())
    few = gone.limit(HIT_ROWS + 1).count() <= HIT_ROWS
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    first, second = row_key(F.col("row.text"))
    left = named.withColumns({"r1": first, "r2": second}).join(F.broadcast(gone) if few else gone, ["r1", "r2"], "left_anti")
    return left.select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(name: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos, len(ws) AS n FROM (SELECT {key}, [x FOR x IN regexp_split_to_array({lowered}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM {name})"


#: Every alignment that shares enough words, then its best stretch: brute force.
ORACLE = f"""
WITH d AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}),
m AS (SELECT doc_id, item_id, d.pos - b.pos AS shift, b.n AS n_item, least(13, b.n) AS size, list(b.pos) AS ps FROM d JOIN b ON d.w = b.w GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 0.8 * least(13, b.n)),
s AS (SELECT *, unnest(range(n_item - size + 1)) AS st FROM m),
c AS (SELECT doc_id, item_id, shift + st AS doc_start, n_item, size, len([x FOR x IN ps IF x >= st AND x < st + size]) AS matched FROM s)
SELECT doc_id, item_id, matched / size::DOUBLE AS overlap, matched::BIGINT AS matched, doc_start::BIGINT AS doc_start, n_item::BIGINT AS n_item FROM c WHERE matched >= 0.8 * size
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched / size::DOUBLE DESC, doc_start) = 1
"""
