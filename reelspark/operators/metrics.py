"""Meters and evaluation metrics: two-level means, ensembles, class-mean recall, histograms, trailing bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meter(df: DataFrame, value: str, n: Column, order: str, *by: str) -> DataFrame:
    """last, avg (weighted by n), min, max, sum and count of a value, as a running meter ends up."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.max_by(v, order).alias("last"), (F.sum(v * n) / F.sum(n)).alias("avg"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v * n).alias("total"), F.sum(n).alias("n"))


def best(scores: Column) -> Column:
    """0-based place of the greatest score, ties to the least place."""
    return F.array_position(scores, F.array_max(scores)).cast("long") - 1


def top_k(scores: Column, k: int) -> Column:
    """0-based places of the k greatest scores, best first, ties to the least place."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def class_mean_recall(df: DataFrame, scores: Column, label: Column, k: int = 5, eps: float = 1e-8, valid: Column | None = None) -> DataFrame:
    """recall, accuracy (percent) and classes, over all rows: a row hits if its label is among its k best scores.

    With valid, an array of booleans per class, the other classes' scores are 0. Recall is the mean over the
    classes that occur; partial counts per class are all that is shuffled.
    """
    if valid is not None:
        scores = F.zip_with(scores, valid, lambda s, ok: F.when(ok, s).otherwise(0.0))
    hit = F.array_contains(top_k(scores, k), label.cast("int"))
    per = df.groupBy(label.alias("_class")).agg(F.sum(hit.cast("long")).alias("tp"), F.count("*").alias("n"))
    return per.agg((100.0 * F.sum(F.col("tp") / (F.col("n") + eps)) / F.count("*")).alias("recall"), (100.0 * F.sum("tp") / F.sum("n")).alias("accuracy"), F.count("*").alias("classes"))


def mean_of_means(df: DataFrame, batch: Column, value: Column) -> DataFrame:
    """The unweighted mean of batch means, and beside it the mean over all rows."""
    per = df.groupBy(batch.alias("_batch")).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count("*").alias("n"))
    return per.agg(F.avg("m").alias("mean_of_means"), (F.sum("s") / F.sum("n")).alias("micro"), F.count("*").alias("batches"))


def histogram_2d(df: DataFrame, x: str, y: str, weight: Column, bins: int, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Weighted counts by (bx, by); the last bin includes its right edge, points outside are gone."""

    def place(v: str, lo: float, hi: float) -> Column:
        return F.least(F.floor((F.col(v) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")

    inside = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.groupBy(place(x, *x_range).alias("bx"), place(y, *y_range).alias("by")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def trailing_bound(df: DataFrame, value: str, order: list[str], n: int, k: float, *by: str) -> DataFrame:
    """df with bound = mean + k standard deviations of the n rows before; +infinity while there are none."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    bound = F.avg(value).over(w) + k * F.stddev_pop(value).over(w)
    return df.withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))


def ema(df: DataFrame, value: str, order: list[str], keep: float, *by: str) -> DataFrame:
    """One row per group: the exponential average keep * k + (1 - keep) * q after its last row, in closed form.

    Row r of n weighs (1 - keep) keep^(n - r), the first one keep^(n - 1); weights below the least double are 0.
    """
    w = Window.partitionBy(*by)
    placed = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    weight = F.when(F.col("_r") == 1, F.lit(1.0)).otherwise(1.0 - keep) * F.pow(F.lit(keep), F.col("_n") - F.col("_r"))
    return placed.groupBy(*by).agg(F.sum(weight * F.col(value)).alias("ema"), F.count("*").alias("n"))


def islands(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Distinct integers as ranges: one row per group with text such as 0-2,5."""
    v = df.select(*by, value).distinct()
    run = v.withColumn("_g", F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    spans = run.groupBy(*by, "_g").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda s: F.when(s["lo"] == s["hi"], s["lo"].cast("string")).otherwise(F.concat_ws("-", s["lo"], s["hi"])))
    return spans.groupBy(*by).agg(F.array_join(text, ",").alias("ranges"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with value of the last right row of its key at or before at: both sides in one sorted pass, no range join."""
    both = left.withColumns({"_is": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(right.select(key, at, F.lit(0).alias("_is"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_is").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_is = 1").drop("_is", "_v")


class Recall:
    """Class-mean recall as a state of its own: hits and rows by class, a table that batches and workers add up to."""

    STATE = "class_id int, tp long, n long"

    def __init__(self, k: int = 5):
        self.k = k

    def zero(self, spark) -> DataFrame:
        return spark.createDataFrame([], self.STATE)

    def of(self, batch: DataFrame, scores: Column, label: Column) -> DataFrame:
        hit = F.array_contains(top_k(scores, self.k), label.cast("int")).cast("long")
        return batch.groupBy(label.cast("int").alias("class_id")).agg(F.sum(hit).alias("tp"), F.count("*").alias("n"))

    def merge(self, *states: DataFrame) -> DataFrame:
        every = states[0]
        for s in states[1:]:
            every = every.unionByName(s)
        return every.groupBy("class_id").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))

    def update(self, state: DataFrame, batch: DataFrame, scores: Column, label: Column) -> DataFrame:
        return self.merge(state, self.of(batch, scores, label))

    def value(self, state: DataFrame) -> DataFrame:
        """recall and accuracy in percent, and classes: one row."""
        return state.agg((100.0 * F.avg(F.col("tp") / F.col("n"))).alias("recall"), (100.0 * F.sum("tp") / F.sum("n")).alias("accuracy"), F.count("*").alias("classes"))
