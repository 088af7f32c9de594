"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact word length within each source. A source whose target is r whole repeats and
a remainder takes every document r times and fits the remainder: first the same share of every length, then,
for what rounding leaves, a bounded knapsack over the lengths, solved by dynamic programming on bit sets. How
many documents of each length are taken is then exact; which ones is settled by a seeded hash.

Memory: a knapsack keeps one number per reachable sum, at most FINE of them, and one source's lengths with their
counts are one group, so a source costs what its distinct lengths cost, however many documents it has.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last
in order; a null doc_id is an id like any other; repeated rows are documents of their own, each with its own place in
the draw; an empty table gives an empty result; a source without words has target 0. Other columns are ignored by
`mix_plan` and kept by `mix_documents`, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage, table

#: Documents of one source and length are ranked in parts of about this many, so that a hot length is not one task.
PART = 512
#: Bounds the bit sets of the knapsack (bits); a greedy fill leaves it at most half of that.
KNAPSACK = 1 << 16
#: Sums of a knapsack that starts from nothing; beyond that many words lengths are counted in larger units.
FINE = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(caps: list[int], weights: list[int], total: int) -> list[float]:
    """Targets by weight whose sum is total, none over its cap: the excess is shared again until none is above."""
    target, free, left = [Fraction(0)] * len(caps), [i for i, c in enumerate(caps) if c > 0], Fraction(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > caps[i]]
        if not over:
            for i in free:
                target[i] = weights[i] * unit
            break
        for i in over:
            target[i] = Fraction(caps[i])
            left -= caps[i]
        free = [i for i in free if i not in set(over)]
    return [float(t) for t in target]


def knapsack(lengths: np.ndarray, rooms: list[np.ndarray], budget: int) -> tuple[np.ndarray, int]:
    """(how many of each length to add, words over or under budget) nearest to budget, by bit sets of reachable sums.

    Of the rooms, bounds per length, the first is used alone if it can hit the budget.
    """
    add = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or not len(lengths):
        return add, -budget
    space = min(max(budget + budget // 64, KNAPSACK), budget + int(lengths.max()))
    mask, reach, steps = (1 << (space + 1)) - 1, 1, []
    made = np.full(space + 1, -1, dtype=np.int32)  # the step that reached a sum first, from sums of earlier steps
    for room in rooms:
        for i in np.argsort(lengths, kind="stable").tolist():
            length = int(lengths[i])
            spare, size = min(int(room[i]), space // length), 1
            while spare > 0 and not reach >> budget & 1:  # a bounded count as parts 1, 2, 4, ... and the rest
                part = min(size, spare)
                before = reach
                reach |= (reach << (part * length)) & mask
                if reach != before:
                    fresh = np.frombuffer((reach ^ before).to_bytes(space // 8 + 1, "little"), dtype=np.uint8)
                    made[np.flatnonzero(np.unpackbits(fresh, bitorder="little"))] = len(steps)
                    steps.append((i, part))
                spare -= part
                size *= 2
    best = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    if above and (over := (above & -above).bit_length()) < budget - best:
        best = budget + over
    gap = best - budget
    while best:
        i, part = steps[made[best]]
        add[i] += part
        best -= part * int(lengths[i])
    return add, gap


def fitted(lengths: np.ndarray, rooms: list[np.ndarray], budget: int) -> tuple[np.ndarray, int]:
    """knapsack() with lengths in units of so many words that there are FINE sums at most; the gap is in words."""
    unit = max(1, -(-budget // FINE))
    add, _ = knapsack(np.maximum(1, (lengths + unit // 2) // unit), rooms, budget // unit)
    return add, int((add * lengths).sum()) - budget


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = 1) -> np.ndarray:
    """How many documents of each length to take so that the words come nearest to budget, which is at most all words.

    Every length gives the same share first. Then the rounding loss is filled, largest lengths first, and the rest
    fitted by the knapsack, with second and further copies, up to most of a document, only where first ones can't
    hit the budget. Where a few long documents leave a gap of over a hundredth, the knapsack starts from nothing instead,
    and the nearer of the two is taken.
    lengths are distinct and positive.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    have = int((lengths * counts).sum())
    if budget >= have:
        return counts.copy()
    take = np.array([int(c) * budget // have for c in counts], dtype=np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= KNAPSACK // 2:
            break
        more = min(int(counts[i] - take[i]), (left - KNAPSACK // 4) // int(lengths[i]))
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    add, gap = fitted(lengths, [counts - take, counts * (most - 1)], left)
    if abs(gap) > budget // 100:
        anew, other = fitted(lengths, [counts, counts * (most - 1)], budget)
        if abs(other) < abs(gap):
            return anew
    return take + add


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, share: float = 1.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies, taken, and the columns of carry as _0, _1, ...

    Sources by code point, null last, get the weights in turn, repeating. One row per source comes to the driver,
    as the mix is configured per source; everything per document or per length stays distributed.
    """
    spark = docs.sparkSession
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    draw = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    kept = (F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("skey"), draw.alias("draw"), *kept)
    slim = stage(named.select("doc_id", "source", "size", "skey", "draw"))
    sized = named if carry else slim
    sums = sorted((r.skey, r.words) for r in slim.groupBy("skey").agg(F.sum("size").alias("words")).collect())
    # Python orders str by code point, so "0..." sources come first and null ("1") last
    total = int(sum(w for _, w in sums) * Fraction(str(share)))
    targets = fill([cap * w for _, w in sums], [weights[i % len(weights)] for i in range(len(sums))], total)
    plan = {k: (w, t, min(cap, int(t // w)) if w else 0) for (k, w), t in zip(sums, targets, strict=True)}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        words, target, times = plan[pdf["skey"].iloc[0]]
        pdf = pdf.sort_values("size", ignore_index=True)
        some = pdf["size"].to_numpy() > 0
        extra = np.zeros(len(pdf), dtype=np.int64)
        if times < cap:
            extra[some] = fit_counts(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], int(round(target)) - times * words, cap - times)
        n = pdf["n"].to_numpy()
        return pdf.assign(extra=extra % n, times=times + extra // n, source_size=words, target=float(target))

    lengths = stage(slim.groupBy("skey", "size").agg(F.count("*").alias("n")).groupBy("skey").applyInPandas(fit, "skey string, size long, n long, extra long, times long, source_size long, target double"))
    parted = sized.join(lengths, ["skey", "size"]).withColumn("part", F.pmod(F.xxhash64("draw"), F.greatest(F.lit(1), F.ceil(F.col("n") / PART))).cast("long"))
    hot = lengths.where(F.col("n") > PART).select("skey", "size", "extra")
    filled = (
        slim.join(lengths.where(F.col("n") > PART), ["skey", "size"])
        .groupBy("skey", "size", F.pmod(F.xxhash64("draw"), F.greatest(F.lit(1), F.ceil(F.col("n") / PART))).cast("long").alias("part"))
        .agg(F.count("*").alias("here"))
        .join(hot, ["skey", "size"])
        .withColumn("before", F.coalesce(F.sum("here").over(Window.partitionBy("skey", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("skey", "size", "part", F.greatest(F.lit(0), F.col("extra") - F.col("before")).alias("quota"))
    )
    ranked = parted.join(filled, ["skey", "size", "part"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("draw", "doc_id")))
    copies = F.col("times") + F.when(F.col("rank") <= F.coalesce("quota", "extra"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(f"_{i}" for i in range(len(carry)))).withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row as often as the plan takes that row, with the columns of docs.

    The rows themselves go through the plan, so repeated, equal and null ids need no care.
    """
    plan = mix_plan(docs, carry=tuple(docs.columns), **options).where("copies > 0")
    again = plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
