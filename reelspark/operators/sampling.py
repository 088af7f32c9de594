"""Sampling: weighted draws with replacement, round robins, two-stage draws, uniform shuffles with padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.randoms import hash32, two_stage_draws, uniform
from .indexing import global_index, global_sum, next_row


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement, by the inverse of the cumulative integer weights.

    Draws and rows are sorted together by their places on the scale of cumulative weights, range by range, and a draw
    takes the next row: work grows with draws and rows, never with their product.
    """
    upto = global_sum(rows, key, weight, "_hi").where(F.col(weight) > 0)
    total = upto.agg(F.max("_hi")).first()[0] or 0
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row")
    spans = upto.select(F.lit(None).cast("long").alias("draw"), F.col("_hi").cast("long").alias("_at"), row)
    places = F.floor(uniform(seed, F.col("id")) * total) + 1  # the row whose sum reaches it first is drawn
    draws = rows.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), places.cast("long").alias("_at"), F.lit(None).cast(spans.schema["_row"].dataType).alias("_row"))
    return next_row(spans.unionByName(draws), "_at", "_row").where("draw IS NOT NULL").select("draw", "_row.*")


def round_robin_draws(spark: SparkSession, sizes: list[int], weights: list[int], replicas: int, rank: int, n: int) -> DataFrame:
    """draw, in_source, idx of one rank: sources repeat by integer weight from the rank's place on.

    A draw's own number, over all sources, steps through the rows of whichever source has its turn.
    """
    if any(w != int(w) for w in weights):
        raise ValueError("a round robin needs integer weights")
    order = [i for i, w in enumerate(weights) for _ in range(w)]
    offsets = [sum(sizes[:i]) for i in range(len(sizes))]
    pick = lambda values, at: F.get(F.array(*(F.lit(int(v)) for v in values)), at.cast("int"))
    source = pick(order, (F.col("id") + rank) % len(order))
    place = (F.col("id") * replicas + rank) % pick(sizes, F.col("in_source"))
    return spark.range(n).withColumn("in_source", source).select(F.col("id").alias("draw"), "in_source", (pick(offsets, F.col("in_source")) + place).cast("long").alias("idx"))


def permutation_draws(spark: SparkSession, sizes: list[int], weights: list[float], replicas: int, seed: int, epoch: int, n: int) -> DataFrame:
    """rank, draw, in_source, idx: sources by weight, rows of a source in a seeded order, anew ordered when all were drawn.

    A source's rows of a rank are those at its places; a rank draws each of them once before any comes again.
    """

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for b in batches:
            for rank in b.column("rank").to_pylist():
                rng = np.random.default_rng([seed, epoch, rank])
                source = rng.choice(len(sizes), size=n, p=np.array(weights, dtype=float) / sum(weights))
                idx = np.zeros(n, dtype=np.int64)
                for s in np.unique(source).tolist():
                    at, own = np.flatnonzero(source == s), sizes[s] // replicas
                    order = np.concatenate([rng.permutation(own) for _ in range(-(-len(at) // own))])[: len(at)]
                    idx[at] = offsets[s] + order * replicas + rank
                yield pa.RecordBatch.from_pydict({"rank": pa.array([rank] * n, pa.int64()), "draw": pa.array(range(n), pa.int64()), "in_source": pa.array(source, pa.int64()), "idx": pa.array(idx, pa.int64())})

    return spark.range(replicas).withColumnRenamed("id", "rank").repartition("rank").mapInArrow(draw, "rank long, draw long, in_source long, idx long")


def two_stage(spark: SparkSession, sizes: list[int], weights: list[float], replicas: int, seed: int, epoch: int, n: int) -> DataFrame:
    """rank, draw, idx of n draws of each rank; a rank's generator is sequential, ranks run in parallel."""

    def draw(batches):
        import pyarrow as pa

        for b in batches:
            for rank in b.column("rank").to_pylist():
                found = two_stage_draws(sizes, weights, replicas, rank, seed, epoch, n)
                yield pa.RecordBatch.from_pydict({"rank": pa.array([rank] * n, pa.int64()), "draw": pa.array(range(n), pa.int64()), "idx": pa.array(found, pa.int64())})

    return spark.range(replicas).withColumnRenamed("id", "rank").repartition("rank").mapInArrow(draw, "rank long, draw long, idx long")


def shuffled_shard(rows: DataFrame, key: str, seed: int, epoch: int, rank: int, world: int, drop_last: bool = False) -> DataFrame:
    """A rank's rows of a hash shuffle; all ranks get equally many, by wrapping around or by dropping the tail."""
    placed = global_index(rows.withColumn("_h", hash32(seed, epoch, F.col(key))), "_h", "_place", ties=[key]).drop("_h")
    n = placed.count()
    even = n // world * world if drop_last else -(-n // world) * world
    again = placed.where(F.col("_place") < even - n).withColumn("_place", F.col("_place") + n) if even > n else placed.limit(0)
    return placed.unionByName(again).where((F.col("_place") < even) & (F.col("_place") % world == rank)).withColumnRenamed("_place", "place")


def per_source_permutation(rows: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """rows with pass_place: their place in a seeded permutation of their source.

    Places are counted over all sources at once, by ranges of (source, hash), so a large source is many tasks.
    """
    first = rows.groupBy(source).agg(F.count("*").alias("_n"))
    number = (F.dense_rank().over(Window.orderBy(source)) - 1).alias("_number")  # a dimension: one row per source
    before = F.coalesce(F.sum("_n").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before_source")
    placed = rows.join(F.broadcast(first.select(F.col(source).alias("_source"), number, before)), F.col(source).eqNullSafe(F.col("_source")))
    placed = placed.withColumn("_h", F.col("_number") * (1 << 32) + hash32(seed, F.col(key)))
    return global_index(placed, "_h", "_place", ties=[key]).withColumn("pass_place", F.col("_place") - F.col("_before_source")).drop("_h", "_place", "_before_source", "_number", "_source")
