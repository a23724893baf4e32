"""Greedy samplers: recurrences over time, one pass over each video's sorted frames.

A video's frames come to one task in time order, in Arrow batches. Only what was kept last is carried from batch to
batch, and within a batch the next frame to keep is found by bisection, so time is linear in the frames and memory is
that of a batch, however many frames a video has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _next(times: np.ndarray, start: int, about: float, kept: Callable[[float], bool]) -> int:
    """The first position from `start` on that is kept; `about` is near it, and what follows a kept one would be kept too."""
    at = start + int(np.searchsorted(times[start:], about))
    while at > start and kept(times[at - 1]):
        at -= 1
    while at < len(times) and not kept(times[at]):
        at += 1
    return at


class Clock:
    """Which frames of a video are kept: the first, then each that is `late` enough after the last one kept.

    first_due: when the second one is due, if that doesn't follow from the first.
    """

    def __init__(self, first_due: float | None, step: float, late: Callable[[float, float], bool]) -> None:
        self.first_due, self.step, self.late = first_due, step, late
        self.last, self.n = 0.0, 0  # n: frames kept so far

    def kept(self, times: np.ndarray) -> list[int]:
        """Positions that are kept of times that follow those seen before."""
        keep, at = [], 0
        while at < len(times):
            if self.n:
                if self.n == 1 and self.first_due is not None:
                    at = _next(times, at, self.first_due, lambda t: t >= self.first_due)
                else:
                    at = _next(times, at, self.last + self.step, lambda t: self.late(t, self.last))
                if at == len(times):
                    break
            keep.append(at)
            self.last, self.n, at = float(times[at]), self.n + 1, at + 1
        return keep


def checks(interval: float) -> Clock:
    """The first frame, then each at or after the last check's time plus `interval`, the first of these at `interval`."""
    step = float(interval)
    return Clock(step, step, lambda t, last: t >= last + step)


def by_video(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Stretches of one video in batches that are sorted by their first column, and whether a new video begins."""
    video, any_yet = None, False
    for batch in batches:
        place = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        for a, b in zip(edges := [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)], edges[1:], strict=False):
            if a < b:
                own = batch.column(0)[a].as_py()
                yield not any_yet or own != video, batch.slice(a, b - a)
                video, any_yet = own, True


def in_order(frames: DataFrame, *columns: str) -> DataFrame:
    """Frames that have a time, each video's in one task in time order. The first three columns are video_id, frame_number, timestamp."""
    own = frames.where("timestamp IS NOT NULL").select("video_id", F.col("frame_number").cast("bigint").alias("frame_number"), F.col("timestamp").cast("double").alias("timestamp"), *columns)
    return own.repartition("video_id").sortWithinPartitions("video_id", "timestamp", "frame_number")


def _passed(frames: DataFrame, clock: Callable[[], Clock]) -> DataFrame:
    """(video_id, frame_number, timestamp) of the frames that a video's clock keeps. Frames without a time are left out."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = clock()
        for starts, part in by_video(batches):
            own = clock() if starts else own
            if keep := own.kept(part.column(2).to_numpy()):
                yield part.take(pa.array(keep))

    sorted_ = in_order(frames)
    return sorted_.mapInArrow(f, f"video_id {sorted_.schema['video_id'].dataType.simpleString()}, frame_number bigint, timestamp double")


def sampled(frames: DataFrame, interval: float) -> DataFrame:
    """The first frame, then each at or after the last check's time plus `interval`; drifts with actual times.

    The first check is due at `interval`, whatever the first frame's time is.
    """
    return _passed(frames, lambda: checks(interval))


def spaced(frames: DataFrame, gap: float) -> DataFrame:
    """The first frame, then each at least `gap` after the last one kept."""
    step = float(gap)
    return _passed(frames, lambda: Clock(None, step, lambda t, last: t - last >= step))
