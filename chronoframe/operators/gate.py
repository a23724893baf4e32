"""The keyframe gate: which sampled frames become keyframes.

The decision depends on the last keyframe that was accepted, so it is a recurrence; each video's samples are decided in
time order by one state machine, which the batch and the streaming form share. Native windows give the parts that are
not recurrent (`flicker_exact`, `text_changes`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.image import changed_share
from ..functions.text import alike, normalized, ratio
from .sampling import by_video, checks, in_order

DECIDED = [pa.field("frame_number", pa.int64()), pa.field("timestamp", pa.float64()), *(pa.field(x, pa.string()) for x in ("decision", "change_type")), pa.field("score", pa.float64()), pa.field("reason", pa.string()), pa.field("accepted", pa.bool_())]
DECISIONS = "video_id {kind}, frame_number bigint, timestamp double, decision string, change_type string, score double, reason string, accepted boolean"


def _folded(text: str) -> str:
    return " ".join(text.lower().split())


@dataclass
class Gate:
    """One video's state: what the last keyframe held, recent texts, and when the next check is due."""

    text: str | None = None
    time: float = 0.0
    thumb: bytes | None = None
    recent: list[str] = field(default_factory=list)
    due: float | None = None

    def decide(self, frame: dict[str, Any], s: Settings = DEFAULTS) -> dict[str, Any] | None:
        """The decision on one frame, or None if no check is due."""
        text, now = frame.get("extracted_text") or "", float(frame["timestamp"])
        if self.text is None:
            self._take(text, 0.0, frame)
            self.recent, self.due = [text], s.sample_interval
            return self._said(frame, "initial", "initial", 1.0, "Initial frame", True)
        if now < self.due:
            return None
        self.due = now + s.sample_interval
        before = self.recent[-s.flicker_reach :]
        self.recent = [*self.recent, text][-5:]
        folded, last = _folded(text), _folded(self.text)
        if folded and any(p and alike(folded, p, s.flicker_similarity) for p in map(_folded, before)):
            return self._said(frame, "flicker")
        if folded and last:
            same = 1.0 if folded == last else ratio(folded, last)
            differs = same < s.text_similarity
        else:
            same, differs = (1.0, False) if folded == last else (0.0, True)
        if differs:
            kind = "text_appeared" if text and not self.text else "text_disappeared" if self.text and not text else "text_changed"
            reason = {"text_appeared": "Text appeared", "text_disappeared": "Text disappeared"}.get(kind, f"Text changed (sim: {same:.2f})")
            return self._offer(frame, text, kind, 1.0 - same, reason, s)
        if text or self.text:
            return self._said(frame, "same_text")
        share = self._changed(frame, s)
        if share < s.pixel_change:
            return self._said(frame, "low_pixel", score=share)
        return self._offer(frame, text, "visual_change", share, f"{share * 100:.1f}% pixels changed", s)

    def _changed(self, frame: dict[str, Any], s: Settings) -> float:
        if frame.get("thumb") is not None and self.thumb is not None:
            return changed_share(self.thumb, frame["thumb"], s.pixel_delta)
        share = frame.get("pixel_pct")
        return 0.0 if share is None or share != share else float(share)

    def _offer(self, frame: dict[str, Any], text: str, kind: str, score: float, reason: str, s: Settings) -> dict[str, Any]:
        if float(frame["timestamp"]) - self.time < s.min_keyframe_gap:
            return self._said(frame, "too_close", kind, score, reason)
        self._take(text, float(frame["timestamp"]), frame)
        return self._said(frame, kind, kind, score, reason, True)

    def _take(self, text: str, time: float, frame: dict[str, Any]) -> None:
        self.text, self.time, self.thumb = text, time, frame.get("thumb")

    @staticmethod
    def _said(frame: dict[str, Any], decision: str, kind: str | None = None, score: float | None = None, reason: str | None = None, accepted: bool = False) -> dict[str, Any]:
        return {"video_id": frame["video_id"], "frame_number": frame["frame_number"], "timestamp": float(frame["timestamp"]), "decision": decision, "change_type": kind, "score": score, "reason": reason, "accepted": accepted}

    def saved(self) -> dict[str, Any]:
        return asdict(self)


def decisions_of(frames: Iterable[dict[str, Any]], settings: Settings = DEFAULTS, gate: Gate | None = None) -> Iterator[dict[str, Any]]:
    """Decisions on frames that come in time order."""
    gate = gate or Gate()
    for frame in frames:
        if (said := gate.decide(frame, settings)) is not None:
            yield said


def gate(frames: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """A row for each checked frame: decision, what it would be a keyframe for, and whether it became one.

    frames: video_id, frame_number, timestamp, extracted_text, and thumb or pixel_pct. Frames without a time are left out.
    A video's sorted frames come to one task in Arrow batches, of which only frames that are due are looked at; from batch
    to batch the gate's state is carried, so memory is that of a batch however long a video is.
    """
    columns = [c for c in ("extracted_text", "thumb", "pixel_pct") if c in frames.columns]
    sorted_ = in_order(frames, *columns)
    schema = DECISIONS.format(kind=sorted_.schema["video_id"].dataType.simpleString())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, clock = Gate(), checks(settings.sample_interval)
        for starts, part in by_video(batches):
            if starts:
                own, clock = Gate(), checks(settings.sample_interval)
            # what isn't due never becomes Python objects, its pixels least of all
            due = part.take(pa.array(clock.kept(part.column(2).to_numpy()), pa.int64()))
            rows = [said for frame in due.to_pylist() if (said := own.decide(frame, settings)) is not None]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([due.schema.field("video_id"), *DECIDED]))

    return sorted_.mapInArrow(decide, schema)


def keyframes(decisions: DataFrame) -> DataFrame:
    """Accepted decisions as keyframes."""
    return decisions.where("accepted").select("video_id", "frame_number", "timestamp", F.col("score").alias("scene_change_score"), "change_type", F.array("reason").alias("detection_reasons"))


def counters(decisions: DataFrame) -> DataFrame:
    """One row: frames checked and why. Text and visual changes count before the spacing rule."""
    late = F.col("decision") != "initial"
    text = F.col("change_type").isin("text_appeared", "text_disappeared", "text_changed")
    return decisions.agg(
        F.count_if(late).alias("frames_checked"),
        F.count_if(late & F.coalesce(text, F.lit(False))).alias("text_changed"),
        F.count_if(F.coalesce(F.col("change_type") == "visual_change", F.lit(False))).alias("visual_keyframes"),
        F.count_if(F.col("decision") == "same_text").alias("skipped_text_same"),
        F.count_if(F.col("decision") == "flicker").alias("skipped_flicker"),
        F.count_if(F.col("decision") == "low_pixel").alias("skipped_pixels_low"),
        F.count_if("accepted").alias("keyframes"),
    )


def in_time() -> Window:
    return Window.partitionBy("video_id").orderBy("timestamp", "frame_number")


def flicker_exact(frames: DataFrame, reach: int = 3) -> DataFrame:
    """Adds `flicker`: the folded text isn't empty and equals one of the last `reach` texts."""
    now = normalized(F.col("extracted_text"))
    w = in_time()
    found = F.lit(False)
    for k in range(1, reach + 1):
        found = found | F.coalesce(F.lag(now, k).over(w) == now, F.lit(False))
    return frames.withColumn("flicker", (F.coalesce(now, F.lit("")) != "") & found)


def text_changes(frames: DataFrame, pixel_change: float = DEFAULTS.pixel_change) -> DataFrame:
    """Adds `change_type` against the previous frame, by exact texts; null where nothing changed."""
    w = in_time()
    prior = F.lag("extracted_text").over(w)
    now = F.col("extracted_text")
    kind = (
        F.when(prior.isNull(), "initial")
        .when((prior == "") & (now != ""), "text_appeared")
        .when((prior != "") & (now == ""), "text_disappeared")
        .when((prior != "") & (normalized(now) != normalized(prior)), "text_changed")
        .when((prior == "") & (now == "") & (F.col("pixel_pct") >= pixel_change), "visual_change")
    )
    return frames.withColumn("change_type", kind)
