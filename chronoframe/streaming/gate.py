"""The keyframe gate over streams of frames, with the batch form's state machine.

`gate` decides frames as they come and needs them in order. `late_gate` takes them in any order within a delay: frames
wait in state until the watermark has passed them, and are then decided in time order, so the order of arrival makes no
difference. What is later than the delay is dropped and counted by Spark (`numRowsDroppedByWatermark` of the progress).
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS, Settings
from ..operators.gate import DECISIONS, Gate
from ..operators.sampling import checks

STATE = "text string, time double, thumb binary, recent array<string>, due double, latest double"


def gate(frames: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Decisions on a streaming DataFrame of frames.

    A micro-batch's frames are taken in time order. A frame older than the latest one decided is dropped: frames are
    expected in order across batches.
    """
    columns = [c for c in ("video_id", "frame_number", "timestamp", "extracted_text", "thumb", "pixel_pct") if c in frames.columns]
    kind = frames.schema["video_id"].dataType.simpleString()

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, latest = Gate(), float("-inf")
        if state.exists:
            text, time, thumb, recent, due, latest = state.get
            own = Gate(text, time, thumb, list(recent), due)
        rows = []
        group = pd.concat(list(batches)).sort_values(["timestamp", "frame_number"])
        for frame in group.to_dict("records"):
            if frame["timestamp"] < latest:
                continue
            latest = float(frame["timestamp"])
            if (said := own.decide(frame, settings)) is not None:
                rows.append(said)
        state.update((own.text, own.time, own.thumb, own.recent, own.due, latest))
        yield pd.DataFrame(rows, columns=["video_id", "frame_number", "timestamp", "decision", "change_type", "score", "reason", "accepted"])

    return frames.select(*columns).groupBy("video_id").applyInPandasWithState(decide, DECISIONS.format(kind=kind), STATE, "append", GroupStateTimeout.NoTimeout)


NAMES = ["video_id", "frame_number", "timestamp", "decision", "change_type", "score", "reason", "accepted"]
#: What the gate needs of frames that wait, and when they happened in microseconds; videos that share a key have their frames packed together.
WAITING = pa.schema([("us", pa.int64()), ("frame_number", pa.int64()), ("timestamp", pa.float64()), ("extracted_text", pa.string()), ("thumb", pa.binary()), ("pixel_pct", pa.float64())])
#: A video's gate and its sampler's clock.
HELD = pa.schema([("text", pa.string()), ("time", pa.float64()), ("thumb", pa.binary()), ("recent", pa.list_(pa.string())), ("due", pa.float64()), ("last", pa.float64()), ("n", pa.int64())])


def _packed(table: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


class LateGate(StatefulProcessor):
    """Waiting frames and gates of the videos that share a key: each call to the state store stands for all of these videos.

    One timer a key: the end of the earliest slot in which a frame waits. When the watermark has passed the end of a slot
    no more frames of it can come, so all frames up to there are decided. The sampler's clock runs ahead of the gate's
    texts and pixels: frames that aren't due leave without being looked at.
    """

    def __init__(self, settings: Settings, slot_ms: int) -> None:
        self.settings, self.slot = settings, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "pack binary")
        self.held = handle.getValueState("gates", "pack binary")
        self.timer = handle.getValueState("timer", "ms bigint")
        self.counts = handle.getMapState("counts", "decision string", "n bigint")

    def _wait_until(self, ms: int) -> None:
        """Sets the key's timer, if none is due sooner."""
        if self.timer.exists():
            (now,) = self.timer.get()
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def _end_of_slot(self, us: int) -> int:
        return (us // 1000 // self.slot + 1) * self.slot

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                video = pa.array(part["video_id"], from_pandas=True)
                self.waiting.appendList([_packed(pa.table({"video_id": video} | {f.name: pa.array(part[f.name], f.type, from_pandas=True) for f in WAITING}))])
                earliest = int(part["us"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wait_until(self._end_of_slot(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        upto = timerValues.getCurrentWatermarkInMs() // self.slot * self.slot * 1000  # in microseconds: slots that have ended
        packs = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        if not packs:
            return iter(())
        every = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packs], promote_options="permissive")
        ended = pa.compute.less(every["us"], upto)
        rest = every.filter(pa.compute.invert(ended))
        if len(rest):
            self.waiting.put([_packed(rest)])
            self._wait_until(self._end_of_slot(pa.compute.min(rest["us"]).as_py()))
        else:
            self.waiting.clear()
        said = self._decided(every.filter(ended).sort_by([(c, "ascending") for c in ("video_id", "timestamp", "frame_number")]))
        return iter([pd.DataFrame(said, columns=NAMES)] if said else [])

    def _decided(self, ready: pa.Table) -> list[dict]:
        if not len(ready):
            return []
        held = {}
        if self.held.exists():
            had = pa.ipc.open_stream(self.held.get()[0]).read_all().to_pydict()
            held = dict(zip(had["video_id"], zip(*(had[c] for c in HELD.names), strict=True), strict=True))
        said, times = [], ready["timestamp"].to_numpy()
        numbers, texts, thumbs, shares = (ready[c].to_pylist() for c in ("frame_number", "extracted_text", "thumb", "pixel_pct"))
        at = 0
        for video, run in itertools.groupby(ready["video_id"].to_pylist()):
            first, at = at, at + sum(1 for _ in run)
            own, clock = Gate(), checks(self.settings.sample_interval)
            if video in held:
                text, time, thumb, recent, due, clock.last, clock.n = held[video]
                own = Gate(text, time, thumb, list(recent), due)
            for i in clock.kept(times[first:at]):
                k = first + int(i)
                one = own.decide({"video_id": video, "frame_number": numbers[k], "timestamp": float(times[k]), "extracted_text": texts[k], "thumb": thumbs[k], "pixel_pct": shares[k]}, self.settings)
                if one is not None:
                    said.append(one)
            held[video] = (own.text, own.time, own.thumb, own.recent, own.due, clock.last, clock.n)
        columns = {f.name: pa.array([x[k] for x in held.values()], f.type) for k, f in enumerate(HELD)}
        self.held.update(_packed(pa.table({"video_id": pa.array(list(held))} | columns)))
        for decision, n in Counter(x["decision"] for x in said).items():
            had = self.counts.getValue((decision,)) if self.counts.containsKey((decision,)) else (0,)
            self.counts.updateValue((decision,), (had[0] + n,))
        return said


def late_gate(frames: DataFrame, delay: str, event_time: str = "event_time", slot: float = 10.0, settings: Settings = DEFAULTS, keys: int = 192) -> DataFrame:
    """Decisions on a streaming DataFrame of frames that come in any order, but no later than `delay`.

    event_time: when a frame happened; within a video it grows with `timestamp`. Frames are decided by slots of `slot`
    seconds, so a decision comes at most delay + slot after its frame. Frames without a time or a video are left out. The
    query needs the RocksDB state store (`session.session` names it).

    keys: videos share as many keys of the state store, dealt by hash. What waits of a key's videos is in memory when its
    timer is due, so more videos need more keys; a checkpoint keeps its number.
    """
    own = frames.where(F.col("timestamp").isNotNull() & F.col(event_time).isNotNull() & F.col("video_id").isNotNull())
    optional = [F.col(c) if c in frames.columns else F.lit(None).cast(t).alias(c) for c, t in (("extracted_text", "string"), ("thumb", "binary"), ("pixel_pct", "double"))]
    own = own.select("video_id", F.col(event_time).cast("timestamp").alias("__at"), F.col("frame_number").cast("bigint").alias("frame_number"), F.col("timestamp").cast("double").alias("timestamp"), *optional)
    own = own.withWatermark("__at", delay).withColumn("us", F.unix_micros("__at"))
    kind = frames.schema["video_id"].dataType.simpleString()
    own = own.withColumn("key", F.pmod(F.xxhash64("video_id"), F.lit(keys)).cast("int"))
    return own.groupBy("key").transformWithStateInPandas(LateGate(settings, max(1, int(slot * 1000))), DECISIONS.format(kind=kind), "Append", "EventTime")
