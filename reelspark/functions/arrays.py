"""Column expressions over numeric arrays: norms, softmax, losses, distances, position tables.

All are Catalyst expressions on arrays of double; a null array gives null. `dbl` casts float arrays first, so that
sums are the same on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(a: Column) -> Column:
    return a.cast("array<double>")


def fold(a: Column, f=lambda x: x) -> Column:
    """Sum of f over the elements, left to right."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def mean(a: Column) -> Column:
    return fold(a) / F.size(a)


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps)."""
    spread = lambda c: F.sqrt(fold(c, lambda x: x * x) / F.size(c) + eps)
    centred = let(mean(a), lambda m: F.transform(a, lambda x: x - m))
    return let(centred, lambda c: let(spread(c), lambda s: F.transform(c, lambda x: x / s)))


def chunk_layer_norm(a: Column, chunks: int, width: int, eps: float = 1e-5) -> Column:
    """layer_norm of each of the first chunks pieces of width elements, concatenated."""
    return F.concat(*(layer_norm(F.slice(a, i * width + 1, width), eps) for i in range(chunks)))


def softmax(a: Column) -> Column:
    e = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(e, lambda e: let(fold(e), lambda total: F.transform(e, lambda x: x / total)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def lp_loss(z: Column, h: Column, p: float) -> Column:
    """mean(|z - h| ** p) / p."""
    return fold(F.zip_with(z, h, lambda a, b: F.pow(F.abs(a - b), F.lit(p)))) / F.size(z) / p


def l1_distance(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """log-softmax negative log-likelihood; label is 0-based."""
    total = let(F.array_max(logits), lambda top: F.ln(fold(logits, lambda x: F.exp(x - top))) + top)
    return total - F.get(logits, label)


def focal_terms(logits: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Sigmoid focal loss of each class against the one-hot label, in the stable form of the cross entropy."""

    def term(x: Column, i: Column) -> Column:
        t = F.when(i == label, 1.0).otherwise(0.0)
        ce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
        p = sigmoid(x)
        pt = p * t + (1.0 - p) * (1.0 - t)
        loss = ce * F.pow(1.0 - pt, F.lit(gamma))
        return loss * (alpha * t + (1.0 - alpha) * (1.0 - t)) if alpha >= 0 else loss

    return F.transform(logits, term)


def zero_small(x: Column, threshold: float) -> Column:
    return F.when(F.abs(x) < threshold, 0.0).otherwise(x)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def circulant_pad(a: Column, total: Column) -> Column:
    """a repeated cyclically up to total elements."""
    return F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.get(a, i % F.size(a)))


def stride_select(a: Column, step: int) -> Column:
    return F.filter(a, lambda x, i: i % step == 0)


def split_clips(a: Column, clips: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(clips - 1)), lambda i: F.slice(a, i * width + 1, width))


def slide(window: Column, new: Column, size: int) -> Column:
    """The last size elements of window followed by new: a first-in first-out window."""
    both = F.concat(window, new)
    return F.when(F.size(both) <= size, both).otherwise(F.slice(both, F.size(both) - size + 1, size))


def drop_last(a: Column, n: int) -> Column:
    return F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - n))


def complement(mask: Column, n: int) -> Column:
    """Sorted ids of [0, n) that are not in mask."""
    return F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), mask))


def gather(tokens: Column, mask: Column) -> Column:
    """tokens at the 0-based ids of mask, in the order of mask, repeats kept."""
    return F.transform(mask, lambda i: F.get(tokens, i))


def argsort(a: Column) -> Column:
    """0-based positions in ascending order of value, ties by position."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def sincos(dim: int, pos: Column) -> Column:
    """dim/2 sines, then dim/2 cosines of pos * 10000 ** (-2 i / dim)."""
    angle = F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda i: pos * F.pow(F.lit(10000.0), -(i / (dim / 2.0))))
    return F.concat(F.transform(angle, F.sin), F.transform(angle, F.cos))


def token_position(token: Column, height: int, width: int) -> tuple[Column, Column, Column]:
    """(frame, row, column) of a token id on a grid."""
    frame = F.floor(token / (height * width)).cast("long")
    rest = token - frame * (height * width)
    row = F.floor(rest / width).cast("long")
    return frame, row, rest - row * width


def rope_rescale(pos: Column, pretrained: int, actual: int) -> Column:
    return pos * (pretrained - 1.0) / (actual - 1.0)
