"""Augmentation policies as data: the configuration grammar, the table of operations, and drawing from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.randoms import hash32, normal, uniform

#: Operation, factor and offset of its argument by magnitude / 10, whether it is signed, whether whole.
OPERATIONS = (
    ("AutoContrast", 0.0, 0.0, False, False),
    ("Equalize", 0.0, 0.0, False, False),
    ("Invert", 0.0, 0.0, False, False),
    ("Rotate", 30.0, 0.0, True, False),
    ("Posterize", 4.0, 0.0, False, True),
    ("Solarize", 256.0, 0.0, False, True),
    ("SolarizeAdd", 110.0, 0.0, False, True),
    ("Color", 1.8, 0.1, False, False),
    ("Contrast", 1.8, 0.1, False, False),
    ("Brightness", 1.8, 0.1, False, False),
    ("Sharpness", 1.8, 0.1, False, False),
    ("ShearX", 0.3, 0.0, True, False),
    ("ShearY", 0.3, 0.0, True, False),
    ("TranslateXRel", 0.45, 0.0, True, False),
    ("TranslateYRel", 0.45, 0.0, True, False),
)
#: What stands in for an operation where severity must increase with the magnitude.
INCREASING = {"Posterize": (-4.0, 4.0, False, True), "Solarize": (-256.0, 256.0, False, True), "Color": (0.9, 1.0, True, False), "Contrast": (0.9, 1.0, True, False), "Brightness": (0.9, 1.0, True, False), "Sharpness": (0.9, 1.0, True, False)}

#: How likely an operation is chosen under w0 and w1; those not named are never chosen.
CHOICE_WEIGHTS = (
    {"Rotate": 0.3, "ShearX": 0.2, "ShearY": 0.2, "TranslateXRel": 0.1, "TranslateYRel": 0.1, "Color": 0.025, "Sharpness": 0.025, "AutoContrast": 0.025, "Solarize": 0.005, "SolarizeAdd": 0.005, "Contrast": 0.005, "Brightness": 0.005, "Equalize": 0.005},
    {"Color": 0.25, "Sharpness": 0.25, "AutoContrast": 0.25, "Solarize": 0.05, "SolarizeAdd": 0.05, "Contrast": 0.05, "Brightness": 0.05, "Equalize": 0.05},
)


def parse(config: str) -> dict[str, float]:
    """Options of a policy string such as rand-m7-n4-mstd0.5-inc1; any inc switches increasing on, unknown keys are ignored."""
    kind, *parts = config.split("-")
    if kind != "rand":
        raise ValueError(f"unknown policy {kind}")
    found: dict[str, float] = {"m": 10.0, "n": 2.0, "mstd": 0.0, "w": -1.0, "inc": 0.0}
    for part in parts:
        name = part.rstrip("0123456789.")
        value = part[len(name) :]
        if name in found and value:
            found[name] = 1.0 if name == "inc" else float(value)
    return found


def parse_column(config: Column) -> Column:
    """map of the options named in a column of policy strings."""
    parts = F.filter(F.slice(F.split(config, "-"), 2, 99), lambda p: F.regexp_like(p, F.lit(r"^[a-z]+[0-9.]+$")))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^[a-z]+", 0), F.regexp_extract(p, r"[0-9.]+$", 0).cast("double"))))


def table_of(spark: SparkSession, increasing: bool = False) -> DataFrame:
    """op_id, op, factor, offset, is_signed, whole; op_id counts from 0."""
    rows = [(i, n, *(INCREASING.get(n, (f, o, s, w)) if increasing else (f, o, s, w))) for i, (n, f, o, s, w) in enumerate(OPERATIONS)]
    made = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(r, ("op_id", "op", "factor", "offset", "is_signed", "whole"), strict=True))) for r in rows))
    return spark.range(1).select(F.inline(made))


def weighted_choice(w: int, n: int, seed: int, key: Column) -> Column:
    """n different operations by the weights of w: each runs a race of exponential speed, the first n to arrive are chosen."""
    weights = [CHOICE_WEIGHTS[w].get(name, 0.0) for name, *_ in OPERATIONS]
    arrivals = [F.struct((-F.ln(uniform(seed, key, i, "race")) / weight).alias("t"), F.lit(i).alias("op_id")) for i, weight in enumerate(weights) if weight]
    return F.transform(F.slice(F.array_sort(F.array(*arrivals)), 1, n), lambda x: x["op_id"])


def draw(samples: DataFrame, key: str, config: str, seed: int) -> DataFrame:
    """samples with one row per chosen operation: pick, op, magnitude, argument, applied (half of them)."""
    o = parse(config)
    if o["w"] >= 0:
        picks = samples.select("*", F.posexplode(weighted_choice(int(o["w"]), int(o["n"]), seed, F.col(key))).alias("pick", "op_id"))
    else:
        picks = samples.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(int(o["n"]) - 1))))
        picks = picks.withColumn("op_id", (hash32(seed, F.col(key), F.col("pick"), "op") % len(OPERATIONS)).cast("int"))
    k = (seed, F.col(key), F.col("pick"))
    drawn = picks.withColumn("magnitude", F.greatest(F.lit(0.0), F.least(F.lit(10.0), o["m"] + o["mstd"] * normal(*k, "m"))))
    ops = F.broadcast(table_of(samples.sparkSession, bool(o["inc"])))
    base = F.col("magnitude") / 10 * F.col("factor")
    sign = F.when(F.col("is_signed") & (uniform(*k, "sign") > 0.5), -1.0).otherwise(1.0)
    argument = F.when(F.col("whole"), base.cast("int").cast("double")).otherwise(base * sign) + F.col("offset")
    return drawn.join(ops, "op_id").withColumn("argument", argument).withColumn("applied", uniform(*k, "p") < 0.5).drop("op_id", "factor", "offset", "is_signed", "whole")
