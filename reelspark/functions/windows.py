"""Window generators: which frames of a recording a sample takes, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _linspace_clipped(points: Column, high: Column, total: int, shift: Column, start: Column | None = None, cap: Column | None = None) -> Column:
    """trunc of `points` evenly spaced values from 0 to high, padded with high to total, at most cap, plus shift."""
    begin = F.lit(0.0) if start is None else start
    cap = high - 1 if cap is None else cap

    def at(j: Column) -> Column:
        even = F.when((points > 1) & (j == points - 1), high.cast("double")).when(points > 1, j * (high.cast("double") / (points - 1))).otherwise(F.lit(0.0))
        value = F.when(j >= points, high.cast("double")).otherwise(even)
        return F.floor(begin + F.least(value, cap.cast("double"))).cast("long") + shift

    return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), at)


def clip_indices(n_frames: Column, frames: int, step: int, clips: int, overlap: bool = False, draw: Column | None = None) -> Column:
    """array<array<long>>: frame indices of each clip; null where the recording is too short for any.

    n_frames is cut in clips segments. A segment longer than frames * step gives evenly spread frames of a stretch of
    that length, at its start or, with draw (uniform in [0, 1) per row), at a random place. A shorter one gives every
    step-th frame and then its last one; with overlap the clips share the whole recording instead.
    """
    span, n = frames * step, n_frames.cast("long")
    part = F.floor(n / clips).cast("long")

    def clip(i: Column) -> Column:
        begin = F.lit(0) if draw is None else F.floor(draw * F.greatest(part - span, F.lit(1))).cast("long")
        long_ = _linspace_clipped(F.lit(frames), F.lit(span), frames, i * part + begin)
        short = _linspace_clipped(F.floor(part / step).cast("long"), part, frames, i * part)
        reach = F.least(F.lit(span), n) - 1
        move = F.when(n > span, F.floor((n - span) / max(clips - 1, 1))).otherwise(F.lit(0)).cast("long")
        shared = _linspace_clipped(F.floor(reach / step).cast("long"), reach, frames, i * move)
        return F.when(part > span, long_).otherwise(shared if overlap else short)

    enough = (n >= 2) if overlap else (part >= 1)
    return F.when(enough, F.transform(F.sequence(F.lit(0), F.lit(clips - 1)), clip))


def step_from_duration(duration: float, fps: Column, frames: int) -> Column:
    return (duration * F.ceil(fps) / frames).cast("long")


def step_from_fps(video_fps: Column, fps: int) -> Column:
    """ceil(video_fps) // fps; null where that is 0, so the row can be rejected and counted."""
    step = F.floor(F.ceil(video_fps) / fps).cast("long")
    return F.when(step > 0, step)


def anticipation_anchor(start: Column, stop: Column, ahead: Column, point: Column, video_fps: Column) -> Column:
    """The frame that a window must end before: point weighs the start of the action, ahead is in seconds."""
    return (start * point + (1.0 - point) * stop - (ahead * video_fps).cast("long")).cast("long")


def anticipation_indices(anchor: Column, video_fps: Column, fps: float, frames: int) -> Column:
    """frames indices up to anchor at the wanted rate, below 0 clamped; null where the rate is above the recording's."""
    step = (video_fps / fps).cast("long")
    found = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.greatest(F.lit(0), anchor - (frames - i) * step).cast("long"))
    return F.when(step > 0, found)


def trajectory_window(length: Column, video_fps: Column, fps: float, frames: int, draw: Column) -> Column:
    """frames indices with a random end in [frames * step, length); null unless the trajectory is strictly longer."""
    step = F.ceil(video_fps / fps).cast("long")
    need = step * frames
    end = need + F.floor(draw * (length - need)).cast("long")
    return F.when(length > need, F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: end - need + i * step))


def view_offsets(height: Column, width: Column, views: int) -> Column:
    """Offsets of views square crops along the longer side; views must be at least 2."""
    side = F.least(height, width)
    step = F.floor((F.greatest(height, width) - side) / (views - 1)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(views - 1)), lambda i: i * step)


def future_tokens(n_tokens: int, grid: int, ahead: Column, fps: float, tubelet: int, out_frames: int) -> Column:
    """Ids of the tokens of out_frames frames that lie ahead seconds behind n_tokens known ones."""
    skip = n_tokens + grid * grid * (ahead * fps / tubelet).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(grid * grid * (out_frames // tubelet) - 1)), lambda i: skip + i)
