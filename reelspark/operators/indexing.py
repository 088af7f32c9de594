"""Global positions without a single-task window: a row's place among all rows in the order of a key.

Rows fall into ranges of the key at approximate quantiles; counts of the ranges, a bounded table, give each range
its offset, and the place inside a range is a window over that range alone. The number of ranges follows the number
of rows. A key that alone fills ranges is cut further by the first tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; ranges of a key at most, and of one hot value at most. Their product bounds the table of offsets.
RANGE_ROWS, RANGES, HOT_RANGES = 1 << 17, 4096, 64


def _spread(cuts: list, wanted: int) -> list:
    """About wanted of the sorted cuts, evenly spread."""
    step = max(1, len(cuts) // max(wanted, 1))
    return cuts[step - 1 :: step]


def _quantiles(df: DataFrame, key: Column, parts: int) -> list:
    """About parts - 1 cuts of key, sorted; a value that fills several parts comes as often."""
    steps = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    return df.select(key.alias("k")).agg(F.expr(f"percentile_approx(k, array({steps}), {4 * parts})")).first()[0] or []


def _ranged(df: DataFrame, key: Column, ties: list[str] = ()) -> DataFrame:
    """df with _range, in the order of key and the first tie; equal rows are in one range."""
    n = df.count()
    wanted = -(-n // RANGE_ROWS) - 1
    cuts = _spread(_quantiles(df, key, RANGES) if wanted else [], wanted)
    hot = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    ranged = df.withColumn("_range", _below(sorted(set(cuts)), key).cast("long") * HOT_RANGES)
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    if not hot or not ties or dict(df.dtypes).get(ties[0]) not in numbers:
        return ranged
    steps = [i / HOT_RANGES for i in range(1, HOT_RANGES)]
    inner = df.where(key.isin(hot)).groupBy(key.alias("_hot")).agg(F.percentile_approx(ties[0], steps, 1000).alias("_cuts"))  # a row per hot value
    return ranged.join(F.broadcast(inner), key == F.col("_hot"), "left").withColumn("_range", F.col("_range") + F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(ties[0]))), F.lit(0))).drop("_hot", "_cuts")


def _below(cuts: list, key: Column, width: int = 64) -> Column:
    """How many of the sorted cuts are less than key, by a chunk first and then inside it."""
    if not cuts:
        return F.lit(0)
    chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    lits = lambda values: F.array(*(F.lit(v) for v in values))
    count = lambda a: F.size(F.filter(a, lambda c: c < key))
    passed = count(lits([c[-1] for c in chunks]))
    inside = F.coalesce(count(F.get(F.array(*(lits(c) for c in chunks)), passed)), F.lit(0))
    return F.least(passed * width, F.lit(len(cuts))) + F.greatest(inside, F.lit(0))


def _offsets(ranged: DataFrame, value: Column) -> DataFrame:
    per = ranged.groupBy("_range").agg(F.sum(value).alias("_here"))
    before = F.sum("_here").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return per.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per range


def global_index(df: DataFrame, key: str | Column, name: str = "idx", ties: list[str] | None = None) -> DataFrame:
    """df with its 0-based place in the order of a numeric key, then of ties."""
    key = F.col(key) if isinstance(key, str) else key
    ranged = _ranged(df, key, ties or [])
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key, *(ties or []))) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(_offsets(ranged, F.lit(1))), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def global_sum(df: DataFrame, key: str, value: str, name: str = "upto") -> DataFrame:
    """df with the running sum of value, its own row included, in the order of a numeric key without ties."""
    ranged = _ranged(df, F.col(key))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(F.broadcast(_offsets(ranged, F.col(value))), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def next_row(df: DataFrame, pos: str, value: str) -> DataFrame:
    """df with value filled in, where it is null, from the next row that has one in the order of pos, then of nulls first.

    One sorted pass by ranges of pos; a range that has no such row behind takes the first one of the ranges after it.
    """
    ranged = _ranged(df, F.col(pos))
    later = Window.partitionBy("_range").orderBy(F.desc(pos), F.col(value).isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.withColumn("_own", F.last(value, ignorenulls=True).over(later))
    heads = ranged.groupBy("_range").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("_head"))
    behind = F.last("_head", ignorenulls=True).over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    heads = F.broadcast(heads.select("_range", behind.alias("_behind")))  # a row per range
    return filled.join(heads, "_range").withColumn(value, F.coalesce("_own", "_behind")).drop("_range", "_own", "_behind")


def concat_ranges(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """sizes, one row per source, with lo and hi of each source in the concatenation."""
    hi = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))  # a dimension: one row per source
    return sizes.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col(size))


def locate(ids: DataFrame, idx: str, ranges: DataFrame) -> DataFrame:
    """ids joined to the source whose [lo, hi) holds idx, with local = idx - lo; ids out of all ranges are gone."""
    return ids.join(F.broadcast(ranges), (F.col(idx) >= F.col("lo")) & (F.col(idx) < F.col("hi"))).withColumn("local", F.col(idx) - F.col("lo"))


def locate_one(sizes: list[int], idx: int) -> tuple[int, int]:
    """(source, local) of one global index; an index out of range raises."""
    if idx < 0:
        raise IndexError(idx)
    for source, n in enumerate(sizes):
        if idx < n:
            return source, idx
        idx -= n
    raise IndexError(idx)


def shard(df: DataFrame, rank: int, world: int, key: str = "doc_id") -> DataFrame:
    """Every world-th row from place rank on, in the order of key."""
    return global_index(df, key, "_place").where(F.col("_place") % world == rank).drop("_place")
