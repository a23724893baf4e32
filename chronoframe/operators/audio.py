"""Speech next to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped, word_count


def with_audio(keyframes: DataFrame, segments: DataFrame, half_window: float = 5.0) -> DataFrame:
    """Adds `audio_text`: texts of segments that touch [t - w, t + w], both ends included, in segment order.

    Both sides are dealt out by video and time slot, so long videos need no comparison of all frames with all segments:
    a segment is copied to each slot that it touches, a frame to the slots that its window touches, and the first slot
    that both touch keeps the pair.
    """
    wide = 2 * half_window if half_window > 0 else 1.0
    slot = lambda x: F.floor(x / wide).cast("bigint")
    frame = keyframes.select("video_id", "frame_number", "timestamp").distinct()
    frame = frame.withColumn("lo", F.col("timestamp") - half_window).withColumn("hi", F.col("timestamp") + half_window)
    frame = frame.withColumn("slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    spoken = segments.where("start <= end").select("video_id", "start", "end", "text").withColumn("slot", F.explode(F.sequence(slot(F.col("start")), slot(F.col("end")))))
    met = frame.join(spoken, ["video_id", "slot"]).where("start <= hi AND end >= lo").where(F.col("slot") == F.greatest(slot(F.col("lo")), slot(F.col("start"))))
    texts = met.groupBy("video_id", "frame_number", "timestamp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "text"))), lambda s: s["text"]), " ").alias("audio_text"))
    return keyframes.join(texts, ["video_id", "frame_number", "timestamp"], "left").withColumn("audio_text", F.coalesce("audio_text", F.lit("")))


def transcript_stats(segments: DataFrame) -> DataFrame:
    """(video_id, segments, words)."""
    return segments.groupBy("video_id").agg(F.count("*").alias("segments"), F.sum(word_count(F.col("text")).cast("bigint")).alias("words"))


def full_text(segments: DataFrame) -> DataFrame:
    """(video_id, full_text): trimmed texts in order of time."""
    ordered = F.sort_array(F.collect_list(F.struct("start", "end", stripped(F.col("text")).alias("text"))))
    return segments.groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("full_text"))
