"""The greedy samplers with a video split over many tasks.

Which frame is kept next depends on the one kept last, so a video looks like one long loop. But a stretch of it does
nothing more than turn the time kept last before it into the time kept last in it. Videos are cut into runs of `SPAN`
intervals of time. Of each run, one task computes that function: only frames of its first interval can be the first kept
one, each leads to a last one by successors, and neighbours that lead to the same last one are one step. Functions of
`FAN` neighbouring runs are composed into that of the whole, level by level, up to one for a video; then the states before
each run are handed down the same tree, and every run is decided by itself. No task sees more than a run, or the
steps of the functions that it composes, however long a video is; of frames at equal times two are enough from the start.

Frames without a finite time are left out, and steps must be positive. The rows are those of `sampling.sampled` and
`sampling.spaced`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pagerank import written
from .sampling import Clock, by_video

#: Intervals in a run; functions composed at once are 2 to the power of `FAN`.
SPAN, FAN = 256, 6
Late = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _first_late(times: np.ndarray, last: np.ndarray, step: float, late: Late) -> np.ndarray:
    """For each `last` the first position of sorted `times` that is late enough after it; their number if none is."""
    at = np.searchsorted(times, last + step)
    while True:  # sums and differences round differently: mostly no turn
        back = (at > 0) & late(times[np.maximum(at - 1, 0)], last)
        on = ~back & (at < len(times)) & ~late(times[np.minimum(at, len(times) - 1)], last)
        if not (back.any() or on.any()):
            return at
        at = at - back + on


def function_of(times: np.ndarray, step: float, late: Late, virtual: float | None, twice: bool = False) -> tuple[np.ndarray, np.ndarray, bool, float]:
    """A run's steps (upto, out), whether a time kept before can reach past all its frames, and what it gives if it comes first.

    A time kept before that makes `upto[k]` the first late enough step leads to `out[k]` as the time kept last.
    times: distinct, sorted. virtual: what counts as kept after the first frame of all, if not its own time; twice: whether
    there are more frames at the first time, of which the next may then be kept as well.
    """
    n = len(times)
    jump = np.append(_first_late(times, times, step, late), n)
    final = np.arange(n + 1)
    while (jump[:n] < n).any():  # doubling: the last position that is reached from each
        final = np.where(jump < n, final[np.minimum(jump, n)], final)
        jump = jump[np.minimum(jump, n)]
    start = times[0] if virtual is None else virtual
    at = max(int(_first_late(times, np.array([start]), step, late)[0]), 0 if twice else 1)
    cold = float(times[final[at]]) if at < n else float(start)
    # what was kept before is no later than this run's first time, but for the virtual one
    limit = max(times[0], virtual) if virtual is not None else times[0]
    most = int(_first_late(times, np.array([limit]), step, late)[0])
    end = final[: min(most + 1, n)]
    cut = np.flatnonzero(np.append(end[1:] != end[:-1], True))
    return times[cut], times[end[cut]], most >= n, cold


def applied(upto: np.ndarray, out: np.ndarray, last: np.ndarray, step: float, late: Late) -> np.ndarray:
    """The times kept last after a run, of those before it; what reaches past the run stays."""
    if not len(upto):
        return last
    at = _first_late(upto, last, step, late)
    return np.where(at < len(upto), out[np.minimum(at, len(out) - 1)], last)


def composed(parts: list[tuple[np.ndarray, np.ndarray, bool, float]], step: float, late: Late) -> tuple[np.ndarray, np.ndarray, bool, float]:
    """The function of neighbouring runs, in order."""
    upto, out, past, cold = parts[-1]
    for a_upto, a_out, a_past, a_cold in reversed(parts[:-1]):
        through = applied(upto, out, np.append(a_out, a_cold), step, late)
        cold = float(through[-1])
        if a_past:  # beyond the first run's frames the others decide
            upto, out = np.concatenate([a_upto, upto]), np.concatenate([through[:-1], out])
        else:
            upto, out, past = a_upto, through[:-1], False
    keep = np.flatnonzero(np.append(out[1:] != out[:-1], True))
    return upto[keep], out[keep], past, cold


def _split(frames: DataFrame, step: float, late: Late, virtual: float | None) -> DataFrame:
    kind = frames.schema["video_id"].dataType.simpleString()
    if step <= 0:
        raise ValueError("steps are positive")
    own = frames.where(F.abs("timestamp") < float("inf")).select("video_id", F.col("frame_number").cast("bigint").alias("frame_number"), F.col("timestamp").cast("double").alias("timestamp"))
    alike = Window.partitionBy("video_id", "timestamp").orderBy("frame_number")
    own = own.withColumn("r", F.row_number().over(alike)).where("r <= 2").drop("r")
    own = own.withColumn("run", F.floor(F.col("timestamp") / (SPAN * step)).cast("bigint"))
    own = written(own)
    # numbered from 0 on, or runs on either side of time 0 would never meet in one function
    lowest = own.agg(F.min("run")).first()[0] or 0
    own = own.withColumn("run", F.col("run") - lowest)
    schema = f"video_id {kind}, run bigint, upto array<double>, `out` array<double>, past boolean, cold double"

    def of_run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        times, n = np.unique(group["timestamp"].to_numpy(), return_counts=True)
        upto, out, past, cold = function_of(times, step, late, virtual, bool(n[0] > 1))
        return pd.DataFrame([(key[0], key[1], upto.tolist(), out.tolist(), past, cold)], columns=["video_id", "run", "upto", "out", "past", "cold"])

    def parts_of(group: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, bool, float]]:
        return [(np.asarray(a, np.float64), np.asarray(b, np.float64), bool(c), float(d)) for a, b, c, d in zip(group["upto"], group["out"], group["past"], group["cold"], strict=True)]

    def compose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        upto, out, past, cold = composed(parts_of(group.sort_values("run")), step, late)
        return pd.DataFrame([(key[0], key[1], upto.tolist(), out.tolist(), past, cold)], columns=["video_id", "run", "upto", "out", "past", "cold"])

    levels = [written(own.groupBy("video_id", "run").applyInPandas(of_run, schema))]
    while levels[-1].groupBy("video_id").count().where("count > 1").limit(1).count():
        above = levels[-1].groupBy("video_id", F.shiftright("run", FAN).alias("up")).applyInPandas(compose, schema)
        levels.append(written(above))

    def hand_down(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("run")
        last, states = group["state"].iloc[0], []
        for upto, out, _, cold in parts_of(group):
            states.append(last)
            last = cold if last is None or np.isnan(last) else float(applied(upto, out, np.array([last]), step, late)[0])
        return pd.DataFrame({"video_id": group["video_id"], "run": group["run"], "state": pd.array([None if x is None or np.isnan(x) else x for x in states], "Float64")})

    states = levels[-1].select("video_id", "run", F.lit(None).cast("double").alias("state"))
    for level in reversed(levels[:-1]):
        upper = states.select(F.col("video_id").alias("v"), F.col("run").alias("up"), "state")
        met = level.join(upper, F.col("video_id").eqNullSafe(F.col("v")) & (F.shiftright("run", FAN) == F.col("up"))).drop("v")
        states = written(met.groupBy("video_id", "up").applyInPandas(hand_down, f"video_id {kind}, run bigint, state double"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock, run = None, None
        for starts, part in by_video(batches):
            runs = part.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for a, b in zip(edges, edges[1:], strict=False):
                if starts and a == 0 or clock is None or runs[a] != run:
                    state = part.column(4)[a].as_py()
                    clock = Clock(None if virtual is None else virtual + step, step, lambda t, last: bool(late(np.float64(t), np.float64(last))))
                    if state is not None:
                        clock.last, clock.n = state, 2
                    run = runs[a]
                if keep := clock.kept(part.column(2).to_numpy()[a:b]):
                    yield part.slice(a, b - a).take(pa.array(keep)).select(["video_id", "frame_number", "timestamp"])

    held = states.select(F.col("video_id").alias("v"), F.col("run").alias("r"), "state")
    met = own.join(held, F.col("video_id").eqNullSafe(F.col("v")) & (F.col("run") == F.col("r"))).select("video_id", "frame_number", "timestamp", "run", "state")
    return met.repartition("video_id", "run").sortWithinPartitions("video_id", "run", "timestamp", "frame_number").mapInArrow(decide, f"video_id {kind}, frame_number bigint, timestamp double")


def sampled(frames: DataFrame, interval: float) -> DataFrame:
    """`sampling.sampled`, with a video's frames dealt over tasks by time."""
    step = float(interval)
    return _split(frames, step, lambda t, last: t >= last + step, 0.0)


def spaced(frames: DataFrame, gap: float) -> DataFrame:
    """`sampling.spaced`, with a video's frames dealt over tasks by time."""
    step = float(gap)
    return _split(frames, step, lambda t, last: t - last >= step, None)
