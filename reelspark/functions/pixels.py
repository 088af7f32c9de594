"""Pixel transforms over clips as numpy arrays [T, H, W, C], and the Arrow function that applies them to rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Weights of blue, green and red in grey.
GREY = (0.114, 0.587, 0.299)
#: Fixed value: what geometric operations of a policy put where no pixel is.
FILL = 128


def to_tensor(clip: np.ndarray, scale: float = 255.0) -> np.ndarray:
    """uint8 [T, H, W, C] -> float32 [C, T, H, W] in [0, 1]."""
    return np.ascontiguousarray(clip.transpose(3, 0, 1, 2)).astype(np.float32) / np.float32(scale)


def normalize(clip: np.ndarray, mean=MEAN, std=STD) -> np.ndarray:
    """[C, T, H, W] by channel."""
    shape = (-1, 1, 1, 1)
    return (clip - np.array(mean, np.float32).reshape(shape)) / np.array(std, np.float32).reshape(shape)


def normalize_bytes(clip: np.ndarray, mean=MEAN, std=STD) -> np.ndarray:
    """uint8 [T, H, W, C] -> normalised [C, T, H, W] with mean and std multiplied by 255 beforehand."""
    return normalize(to_tensor(clip, 1.0), np.array(mean) * 255.0, np.array(std) * 255.0)


def crop(clip: np.ndarray, y: int, x: int, h: int, w: int) -> np.ndarray:
    return clip[:, y : y + h, x : x + w]


def flip(clip: np.ndarray) -> np.ndarray:
    return clip[:, :, ::-1]


def resize(clip: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres at halves, edges repeated; returns float32 [T, h, w, C]."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = axis(clip.shape[1], h), axis(clip.shape[2], w)
    v = clip.astype(np.float32)
    fy, fx = fy[None, :, None, None], fx[None, None, :, None]
    rows = v[:, y0] * (1 - fy) + v[:, y1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def resize_short(clip: np.ndarray, size: int) -> np.ndarray:
    h, w = clip.shape[1:3]
    return resize(clip, int(size * h / w), size) if h >= w else resize(clip, size, int(size * w / h))


def blend(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    return a * alpha + b * (1 - alpha)


def grayscale(clip: np.ndarray) -> np.ndarray:
    """All channels at the grey of a BGR clip."""
    return np.repeat((clip.astype(np.float32) @ np.array(GREY, np.float32))[..., None], clip.shape[-1], axis=-1)


def adjust_hue(clip: np.ndarray, turn: float) -> np.ndarray:
    """RGB in 0..255 with the hue moved by turn of the colour circle; value and saturation stay, greys too."""
    v = clip.astype(np.float32)
    high, low = v.max(-1, keepdims=True), v.min(-1, keepdims=True)
    spread = np.where(high > low, high - low, 1)
    r, g, b = (v[..., c : c + 1] for c in range(3))
    sixth = np.where(high == r, (g - b) / spread, np.where(high == g, 2 + (b - r) / spread, 4 + (r - g) / spread))
    # a channel falls from high to low as the hue, in sixths, leaves the place where that channel is full
    away = (np.array([5, 3, 1], np.float32) + sixth + 6 * np.float32(turn)) % 6
    return high - (high - low) * np.clip(np.minimum(away, 4 - away), 0, 1)


def color_jitter(clip: np.ndarray, order: list[str], amounts: dict[str, float]) -> np.ndarray:
    """Brightness, contrast and saturation, each blended in turn in the order given; hue is a turn of the circle."""
    out = clip.astype(np.float32)
    for name in order:
        if name == "hue":
            out = adjust_hue(out, amounts.get(name, 0.0))
            continue
        base = {"brightness": lambda c: np.zeros_like(c), "contrast": lambda c: np.broadcast_to(grayscale(c).mean(axis=(1, 2, 3), keepdims=True), c.shape), "saturation": grayscale}[name](out)
        out = blend(out, base, 1.0 + amounts.get(name, 0.0))
    return out


def lighting(clip: np.ndarray, alpha: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return clip + (vectors * alpha * values).sum(1)[::-1]


def erase(clip: np.ndarray, y: int, x: int, h: int, w: int, fill: str, rng: np.random.Generator) -> np.ndarray:
    """The same box in all frames, filled with zeros (const), one normal per channel (rand) or per pixel (pixel)."""
    out = clip.astype(np.float32)
    shape = {"const": None, "rand": (1, 1, 1, clip.shape[-1]), "pixel": (clip.shape[0], h, w, clip.shape[-1])}[fill]
    out[:, y : y + h, x : x + w] = 0.0 if shape is None else rng.standard_normal(shape)
    return out


def frame_pad(clip: np.ndarray, total: int) -> np.ndarray:
    """Frames repeated cyclically up to total."""
    return clip[np.arange(total) % len(clip)]


def rotate(clip: np.ndarray, degrees: float, fill: float = FILL, bilinear: bool = False) -> np.ndarray:
    """About the centre; what comes from outside is fill."""
    h, w = clip.shape[1:3]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2]).reshape(2, 1, 1)
    return _sample(clip, np.cos(a) * y + np.sin(a) * x + (h - 1) / 2, -np.sin(a) * y + np.cos(a) * x + (w - 1) / 2, fill, bilinear)


def _sample(clip: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float, bilinear: bool) -> np.ndarray:
    """clip at the places (y, x): the nearest pixel, or the mean of the four around by distance."""
    h, w = clip.shape[1:3]
    inside = (y > -0.5) & (y < h - 0.5) & (x > -0.5) & (x < w - 0.5)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    if bilinear:
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        fy, fx = ((v - v0)[None, :, :, None] for v, v0 in ((y, y0), (x, x0)))
        out = (clip[:, y0, x0] * (1 - fx) + clip[:, y0, x1] * fx) * (1 - fy) + (clip[:, y1, x0] * (1 - fx) + clip[:, y1, x1] * fx) * fy
        out = np.rint(out) if np.issubdtype(clip.dtype, np.integer) else out
    else:
        out = clip[:, np.rint(y).astype(int), np.rint(x).astype(int)]
    return np.where(inside[None, :, :, None], out, fill).astype(clip.dtype)


def affine(clip: np.ndarray, shear_x=0.0, shear_y=0.0, move_x=0.0, move_y=0.0, fill: float = FILL, bilinear: bool = False) -> np.ndarray:
    y, x = np.mgrid[0 : clip.shape[1], 0 : clip.shape[2]].astype(float)
    return _sample(clip, y + shear_y * x + move_y, x + shear_x * y + move_x, fill, bilinear)


def _smooth(clip: np.ndarray) -> np.ndarray:
    """3 x 3 mean with a heavy centre (5 of 13), borders as they are."""
    out = clip.astype(np.float32)
    inner = sum(out[:, dy : dy + out.shape[1] - 2, dx : dx + out.shape[2] - 2] * (5.0 if (dy, dx) == (1, 1) else 1.0) for dy in range(3) for dx in range(3)) / 13.0
    out = out.copy()
    out[:, 1:-1, 1:-1] = inner
    return out


def _stretch(clip: np.ndarray) -> np.ndarray:
    low, high = clip.min(axis=(1, 2), keepdims=True).astype(float), clip.max(axis=(1, 2), keepdims=True).astype(float)
    return np.where(high > low, (clip - low) * 255.0 / np.maximum(high - low, 1), clip)


def _equal(clip: np.ndarray) -> np.ndarray:
    out = clip.copy()
    for t in range(clip.shape[0]):
        for c in range(clip.shape[-1]):
            counts = np.bincount(clip[t, :, :, c].ravel(), minlength=256)
            step = (counts.sum() - counts[np.flatnonzero(counts)[-1]]) // 255
            if step:
                table = np.minimum((np.cumsum(counts) - counts + step // 2) // step, 255)
                out[t, :, :, c] = table[clip[t, :, :, c]]
    return out


#: Operation of a policy -> function of (uint8 clip, argument).
POLICY_OPS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "AutoContrast": lambda c, a: _stretch(c),
    "Equalize": lambda c, a: _equal(c),
    "Invert": lambda c, a: 255 - c,
    "Rotate": rotate,
    "Posterize": lambda c, a: c if a >= 8 else c & np.uint8(0xFF & ~((1 << (8 - int(a))) - 1)),
    "Solarize": lambda c, a: np.where(c < a, c, 255 - c),
    "SolarizeAdd": lambda c, a: np.where(c < 128, np.minimum(c.astype(int) + int(a), 255), c),
    "Color": lambda c, a: blend(c, grayscale(c[..., ::-1]), a),
    "Contrast": lambda c, a: blend(c, np.full(c.shape, np.rint(grayscale(c[..., ::-1]).mean())), a),
    "Brightness": lambda c, a: c * a,
    "Sharpness": lambda c, a: blend(c, _smooth(c), a),
    "ShearX": lambda c, a: affine(c, shear_x=a),
    "ShearY": lambda c, a: affine(c, shear_y=a),
    "TranslateX": lambda c, a: affine(c, move_x=a),
    "TranslateY": lambda c, a: affine(c, move_y=a),
    "TranslateXRel": lambda c, a: affine(c, move_x=a * c.shape[2]),
    "TranslateYRel": lambda c, a: affine(c, move_y=a * c.shape[1]),
}


def policy_op(clip: np.ndarray, op: str, argument: float) -> np.ndarray:
    return np.clip(np.rint(POLICY_OPS[op](clip, argument)), 0, 255).astype(np.uint8)


def rotary(x: np.ndarray, pos: np.ndarray, interleaved: bool) -> np.ndarray:
    """Rotary encoding of x [..., D] at positions pos; frequencies tiled over the halves, or repeated in pairs."""
    d = x.shape[-1]
    angle = pos[..., None] / 10000 ** (np.arange(d // 2) / (d / 2.0))
    angle = np.repeat(angle, 2, axis=-1) if interleaved else np.concatenate([angle, angle], axis=-1)
    pairs = x.reshape(*x.shape[:-1], d // 2, 2)
    turned = np.stack([-pairs[..., 1], pairs[..., 0]], axis=-1).reshape(x.shape)
    return x * np.cos(angle) + turned * np.sin(angle)


def checksum(function: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A column function of (binary clip, shape): the sum of value * place, places from 1, of the result's rounded values."""

    @F.pandas_udf("long")
    def run(data: pd.Series, shape: pd.Series) -> pd.Series:
        out = [np.rint(function(np.frombuffer(b, np.uint8).reshape([int(n) for n in s]))).astype(np.int64).ravel() if b is not None else None for b, s in zip(data, shape, strict=True)]
        return pd.Series([None if o is None else int(o @ np.arange(1, len(o) + 1)) for o in out], dtype="Int64")

    return run


def apply_to_clips(function: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A column function of (binary clip, its shape array) -> struct(data binary float32, shape array<int>)."""

    @F.pandas_udf("data binary, shape array<int>")
    def run(data: pd.Series, shape: pd.Series) -> pd.DataFrame:
        out = [function(np.frombuffer(b, np.uint8).reshape([int(n) for n in s])) if b is not None else None for b, s in zip(data, shape, strict=True)]
        return pd.DataFrame({"data": [None if o is None else np.ascontiguousarray(o, np.float32).tobytes() for o in out], "shape": [None if o is None else list(o.shape) for o in out]})

    return run


def to_tensor_signed(clip: np.ndarray) -> np.ndarray:
    """uint8 [T, H, W, C] -> float32 [C, T, H, W] in [-1, 1]."""
    return to_tensor(clip, 127.5) - np.float32(1.0)


def compose(*steps: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    def run(clip: np.ndarray) -> np.ndarray:
        for step in steps:
            clip = step(clip)
        return clip

    return run


def train_clip(clip: np.ndarray, plan: dict, size: int, mean=MEAN, std=STD) -> np.ndarray:
    """Augment, crop and resize, flip, normalise, erase, pad: as a plan of drawn values says.

    plan: ops [(name, argument)], box (i, j, h, w), flip, erase (i, j, h, w) or None, frames or None. The values come
    from columns (operators.policy, operators.boxes), so a clip's augmentation does not depend on where it runs.
    """
    for name, argument in plan.get("ops", ()):
        clip = policy_op(clip, name, argument)
    i, j, h, w = plan["box"]
    out = resize(crop(clip, i, j, h, w), size, size)
    if plan.get("flip"):
        out = flip(out)
    out = normalize(to_tensor(out), mean, std)
    if plan.get("erase"):
        y, x, eh, ew = plan["erase"]
        out = erase(out.transpose(1, 2, 3, 0), y, x, eh, ew, plan.get("fill", "const"), np.random.default_rng(plan.get("seed", 0))).transpose(3, 0, 1, 2)
    if plan.get("frames"):
        out = frame_pad(out.transpose(1, 0, 2, 3), plan["frames"]).transpose(1, 0, 2, 3)
    return out


def eval_views(clip: np.ndarray, size: int, views: int, mean=MEAN, std=STD) -> list[np.ndarray]:
    """Normalised square crops along the longer side of the clip at short side size; one view is the centre."""
    small = resize_short(clip, size)
    h, w = small.shape[1:3]
    room = max(h, w) - size
    starts = [round(room / 2)] if views == 1 else [k * (room // (views - 1)) for k in range(views)]
    cuts = [(s, 0) if h > w else (0, s) for s in starts]
    return [normalize(to_tensor(crop(small, y, x, size, size)), mean, std) for y, x in cuts]


def _interpolation(n: int, m: int, scale: float, cubic: bool) -> np.ndarray:
    """m x n weights of linear or cubic interpolation (a = -0.75), pixel centres at halves, edges repeated."""
    at = (np.arange(m) + 0.5) / scale - 0.5
    at = at if cubic else np.clip(at, 0, n - 1)
    taps = np.floor(at)[:, None] + (np.arange(-1, 3) if cubic else np.arange(2))
    far = np.abs(at[:, None] - taps)
    if cubic:
        weights = np.where(far <= 1, (1.25 * far - 2.25) * far**2 + 1, -0.75 * (((far - 5) * far + 8) * far - 4))
    else:
        weights = 1 - far
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m)[:, None], np.clip(taps, 0, n - 1).astype(int)), weights)
    return out


def resize_positions(table: np.ndarray, grid: tuple[int, ...], new: tuple[int, ...], cubic: bool = False) -> np.ndarray:
    """A position table [product of grid, D] interpolated along each axis of the grid; with cubic by one scale for all."""
    out = np.asarray(table, dtype=float).reshape(*grid, -1)
    same = (np.prod(new) / np.prod(grid)) ** (1 / len(grid))
    for axis, (n, m) in enumerate(zip(grid, new, strict=True)):
        out = np.moveaxis(np.tensordot(_interpolation(n, m, same if cubic else m / n, cubic), out, axes=(1, axis)), 0, axis)
    return out.reshape(int(np.prod(new)), -1)
