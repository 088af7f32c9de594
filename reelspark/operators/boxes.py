"""Box and crop arithmetic as column expressions; pixels themselves are in functions.pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.randoms import uniform

Box = tuple[Column, Column, Column, Column]


def crop_box(b: Box, dx, dy) -> Box:
    return b[0] - dx, b[1] - dy, b[2] - dx, b[3] - dy


def clip_box(b: Box, height: int, width: int) -> Box:
    x, y = ((lambda c, m=m: F.greatest(F.lit(0.0), F.least(F.lit(float(m - 1)), c))) for m in (width, height))
    return x(b[0]), y(b[1]), x(b[2]), y(b[3])


def flip_box(b: Box, width) -> Box:
    return width - b[2] - 1, b[1], width - b[0] - 1, b[3]


def scale_box(b: Box, factor: Column) -> Box:
    return tuple(c * factor for c in b)


def short_side(height: Column, width: Column, size: int) -> tuple[Column, Column]:
    """(height, width) with the shorter side at size, the other scaled and truncated."""
    tall = height >= width
    return F.when(tall, (size * height / width).cast("int")).otherwise(size), F.when(tall, size).otherwise((size * width / height).cast("int"))


def uniform_crop(height: Column, width: Column, size: int, index: int) -> tuple[Column, Column]:
    """(y, x) of the index-th of three crops along the longer side: start, centre rounded up, end."""
    y, x = F.ceil((height - size) / 2).cast("int"), F.ceil((width - size) / 2).cast("int")
    tall = height > width
    ends = {0: lambda v, room: F.lit(0), 1: lambda v, room: v, 2: lambda v, room: room}[index]
    return F.when(tall, ends(y, height - size)).otherwise(y), F.when(tall, x).otherwise(ends(x, width - size))


def center_crop(height: Column, width: Column, h: int, w: int) -> tuple[Column, Column]:
    """(y, x), halves rounded to even."""
    return F.rint((height - h) / 2.0).cast("int"), F.rint((width - w) / 2.0).cast("int")


def short_side_jitter(height: Column, width: Column, low: int, high: int, *key, inverse: bool = False) -> tuple[Column, Column]:
    """short_side at a size drawn between low and high; inverse draws evenly between 1 / high and 1 / low."""
    u = uniform(*key, "short")
    size = F.rint(1.0 / (1.0 / high + (1.0 / low - 1.0 / high) * u) if inverse else low + (high - low) * u)
    return short_side(height, width, size)


def resized_crop(height: Column, width: Column, scale: tuple[float, float], ratio: tuple[float, float], tries: int, *key, log_scale: bool = True, switch: bool = False) -> Column:
    """struct(i, j, h, w): the first of tries draws of area and aspect that fits, else a central crop.

    The aspect is drawn by its logarithm, or as it is without log_scale; with switch every second draw swaps h and w.
    The draws are unrolled to a coalesce, so there is no loop and no retry state.
    """
    from math import log

    found = []
    for k in range(tries):
        area = height * width * (scale[0] + (scale[1] - scale[0]) * uniform(*key, k, "area"))
        lo, hi = (log(r) for r in ratio) if log_scale else ratio
        aspect = lo + (hi - lo) * uniform(*key, k, "ratio")
        aspect = F.exp(aspect) if log_scale else aspect
        w, h = F.rint(F.sqrt(area * aspect)).cast("int"), F.rint(F.sqrt(area / aspect)).cast("int")
        if switch:
            turned = uniform(*key, k, "switch") < 0.5
            w, h = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
        fits = (w > 0) & (w <= width) & (h > 0) & (h <= height)
        i = F.floor(uniform(*key, k, "i") * (height - h + 1)).cast("int")
        j = F.floor(uniform(*key, k, "j") * (width - w + 1)).cast("int")
        found.append(F.when(fits, F.struct(i.alias("i"), j.alias("j"), h.alias("h"), w.alias("w"))))
    own = width / height
    h = F.when(own < ratio[0], F.rint(width / ratio[0])).otherwise(height).cast("int")
    w = F.when(own > ratio[1], F.rint(height * ratio[1])).otherwise(width).cast("int")
    h, w = F.least(h, height.cast("int")), F.least(w, width.cast("int"))
    central = F.struct(F.floor((height - h) / 2).cast("int").alias("i"), F.floor((width - w) / 2).cast("int").alias("j"), h.alias("h"), w.alias("w"))
    return F.coalesce(*found, central)


def shifted_boxes(first: Column, last: Column, frames: int) -> Column:
    """Boxes struct(i, j, h, w) of each frame, between two by steps that are truncated to whole numbers."""
    step = lambda n, t: (first[n] + (last[n] - first[n]) * t / max(frames - 1, 1)).cast("int").alias(n)
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda t: F.struct(*(step(n, t) for n in ("i", "j", "h", "w"))))


def erase_plan(height: Column, width: Column, frames: int, area: tuple[float, float], aspect: float, *key, count: int = 1, cube: bool = True, splits: int = 1, probability: float = 1.0) -> Column:
    """array of struct(frame, i, j, h, w): count boxes that share the area, the same in all frames (cube) or each frame's own.

    With splits the first part of the frames stays as it is. A clip, or a frame of its own, is erased by probability.
    """

    def boxes_of(who: tuple, tries: int) -> Column:
        found = F.array(*(erase_box(height, width, tuple(a / count for a in area), aspect, tries, *key, *who, c) for c in range(count)))
        return F.when(uniform(*key, *who, "p") < probability, F.filter(found, lambda b: b.isNotNull())).otherwise(F.slice(found, 1, 0))

    shown = lambda found, t: F.transform(found, lambda b: F.struct(t.alias("frame"), *(b[n].alias(n) for n in ("i", "j", "h", "w"))))
    at = F.sequence(F.lit(frames // splits if splits > 1 else 0), F.lit(frames - 1))
    if cube:
        return let(boxes_of((), 20), lambda found: F.flatten(F.transform(at, lambda t: shown(found, t))))
    return F.flatten(F.transform(at, lambda t: shown(boxes_of((t,), 10), t)))


def erase_box(height: Column, width: Column, area: tuple[float, float], aspect: float, tries: int, *key) -> Column:
    """struct(i, j, h, w) of the first draw that is smaller than the frame, null if none of tries is."""
    from math import log

    found = []
    for k in range(tries):
        a = height * width * (area[0] + (area[1] - area[0]) * uniform(*key, k, "area"))
        r = F.exp(log(aspect) * (1.0 - 2.0 * uniform(*key, k, "aspect")))
        h, w = F.rint(F.sqrt(a * r)).cast("int"), F.rint(F.sqrt(a / r)).cast("int")
        i, j = F.floor(uniform(*key, k, "i") * (height - h + 1)).cast("int"), F.floor(uniform(*key, k, "j") * (width - w + 1)).cast("int")
        found.append(F.when((h < height) & (w < width), F.struct(i.alias("i"), j.alias("j"), h.alias("h"), w.alias("w"))))
    return F.coalesce(*found)
