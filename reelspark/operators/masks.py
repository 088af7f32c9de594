"""Block masks over a (frames, rows, columns) grid: draws, unions, complements, truncation, gather."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import complement, let
from ..functions.randoms import uniform


@dataclass(frozen=True)
class MaskConfig:
    """One mask generator; scales are shares of the grid's area and of its frames, aspect is height over width."""

    spatial: tuple[float, float] = (0.15, 0.15)
    temporal: tuple[float, float] = (1.0, 1.0)
    aspect: tuple[float, float] = (0.75, 1.5)
    blocks: int = 8
    max_context: float = 1.0
    max_keep: int | None = None
    full_complement: bool = False
    pred_full_complement: bool = False
    inverse: bool = False


def _between(low: float, high: float, u: Column) -> Column:
    return low + (high - low) * u


def block_size(depth: int, height: int, width: int, cfg: MaskConfig, *key) -> tuple[Column, Column, Column]:
    """(t, h, w) of the blocks of a step: one draw for all samples; halves round to even, as round() does."""
    t = F.greatest(F.lit(1), (depth * _between(*cfg.temporal, uniform(*key, "t"))).cast("int"))
    n = (height * width * _between(*cfg.spatial, uniform(*key, "s"))).cast("int")
    ratio = _between(*cfg.aspect, uniform(*key, "a"))
    h = F.least(F.rint(F.sqrt(n * ratio)).cast("int"), F.lit(height))
    w = F.least(F.rint(F.sqrt(n / ratio)).cast("int"), F.lit(width))
    return t, F.greatest(h, F.lit(1)), F.greatest(w, F.lit(1))


def blocks(samples: DataFrame, sample: str, depth: int, height: int, width: int, cfg: MaskConfig, seed: int, step: Column) -> DataFrame:
    """samples with blocks: cfg.blocks cuboids (t0, y0, x0, t, h, w), sizes by step, places by sample and block."""
    t, h, w = block_size(depth, height, width, cfg, seed, step)

    def block(i: Column) -> Column:
        place = lambda axis, room: F.floor(uniform(seed, step, F.col(sample), i, axis) * (room + 1)).cast("int")
        return F.struct(place("d", depth - F.col("_t")).alias("t0"), place("y", height - F.col("_h")).alias("y0"), place("x", width - F.col("_w")).alias("x0"), F.col("_t").alias("t"), F.col("_h").alias("h"), F.col("_w").alias("w"))

    sized = samples.withColumns({"_t": t, "_h": h, "_w": w})
    return sized.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.lit(cfg.blocks - 1)), block)).drop("_t", "_h", "_w")


def hidden_cells(cuboids: Column, depth: int, height: int, width: int, max_context: float = 1.0) -> Column:
    """Sorted ids of the cells in any cuboid; frames past the context limit are hidden too."""
    limit = max(1, int(depth * max_context))

    def covered(i: Column, cuboids: Column) -> Column:
        f, r = F.floor(i / (height * width)).cast("int"), i % (height * width)
        y, x = F.floor(r / width).cast("int"), r % width
        inside = F.exists(cuboids, lambda b: f.between(b["t0"], b["t0"] + b["t"] - 1) & y.between(b["y0"], b["y0"] + b["h"] - 1) & x.between(b["x0"], b["x0"] + b["w"] - 1))
        return inside | (f >= limit)

    return let(cuboids, lambda c: F.filter(F.sequence(F.lit(0), F.lit(depth * height * width - 1)), lambda i: covered(i, c)))


def make_masks(samples: DataFrame, sample: str, batch: str, depth: int, height: int, width: int, cfg: MaskConfig, seed: int = 0, redraws: int = 2) -> DataFrame:
    """samples with context and target, equal in size within each batch.

    An empty context is drawn again, up to redraws times, by the next seed. Both masks keep the least ids up to the
    batch's minimum; the complements are taken after that, and the swap last.
    """
    n = depth * height * width
    drawn = blocks(samples, sample, depth, height, width, cfg, seed, F.col(batch)).withColumn("target", hidden_cells(F.col("blocks"), depth, height, width, cfg.max_context))
    for k in range(1, redraws + 1):
        drawn = blocks(drawn.drop("blocks"), sample, depth, height, width, cfg, seed + k * 1_000_003, F.col(batch))
        drawn = drawn.withColumn("target", F.when(F.size("target") < n, F.col("target")).otherwise(hidden_cells(F.col("blocks"), depth, height, width, cfg.max_context)))
    drawn = drawn.drop("blocks").withColumn("context", complement(F.col("target"), n))
    own = Window.partitionBy(batch)  # a batch is what one step takes, so it is bounded
    drawn = drawn.withColumns({"_c": F.min(F.size("context")).over(own), "_t": F.min(F.size("target")).over(own)})
    keep = lambda name, c: F.slice(name, 1, c if cfg.max_keep is None else F.least(c, F.lit(cfg.max_keep)))
    cut = drawn.withColumns({"context": keep("context", F.col("_c")), "target": F.slice("target", 1, F.col("_t"))}).drop("_c", "_t")
    if cfg.full_complement:
        cut = cut.withColumn("target", complement(F.col("context"), n))
    elif cfg.pred_full_complement:
        cut = cut.withColumn("context", complement(F.col("target"), n))
    if cfg.inverse:
        cut = cut.withColumnsRenamed({"context": "_swap", "target": "context"}).withColumnRenamed("_swap", "target")
    return cut


def collate(samples: DataFrame, length: str, lengths: list[int], configs: list[MaskConfig], sample: str, batch: str, grid: tuple[int, int, int], seed: int = 0) -> DataFrame:
    """One row per sample and mask config, with fpc, cfg_id, context and target; rows of other lengths are dropped.

    Frames per clip decide the depth of the grid; each (length, config) has a generator of its own.
    """
    parts = []
    for i, fpc in enumerate(lengths):
        own = samples.where(F.col(length) == fpc)
        for j, cfg in enumerate(configs):
            made = make_masks(own, sample, batch, fpc // grid[0], grid[1], grid[2], cfg, seed + 7919 * (i * len(configs) + j))
            parts.append(made.withColumns({"fpc": F.lit(fpc), "cfg_id": F.lit(j)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def causal_pairs(ids: DataFrame, frame_tokens: int, extra: int = 0) -> DataFrame:
    """(i, j) of a block-causal mask: token i sees j iff j's frame is not later; extra tokens come before each frame."""
    n = frame_tokens + extra
    frames = ids.select(F.floor(F.col("id") / n).alias("f")).distinct()
    seen = frames.select("f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("f"))).alias("g"))
    expand = lambda c: F.explode(F.sequence(F.col(c) * n, F.col(c) * n + n - 1))
    return seen.select(expand("f").alias("i"), "g").select("i", expand("g").alias("j"))
