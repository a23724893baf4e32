"""Speech next to frames over two streams, with the batch form's rows.

Frames and segments come in any order within a delay. A frame waits for the segments that can touch its window, a segment
for the frames that can look at it; the watermark tells when neither can come any more, so state holds the delay, a window
and a part of a segment, however long the streams run.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_audio(frames: DataFrame, segments: DataFrame, delay: str, half_window: float = 5.0, longest: float = 60.0, event_time: str = "event_time") -> DataFrame:
    """(video_id, frame_number, timestamp, audio_text) of a stream of frames, in append mode.

    frames: video_id, frame_number, timestamp and when a frame happened; unique. segments: video_id, start, end, text and when
    a segment began. Within a video, event times are one start plus `timestamp` or `start`. What comes later than `delay` after
    the latest of its stream is dropped and counted by Spark; for a segment that counts from its start. A segment of over
    `longest` seconds is held in parts; the part in which a frame's window meets it first keeps the pair, so parts change
    nothing but how long state is kept. Rows without a video or a time are left out, frames without speech have ''.
    """
    seconds = lambda x: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x.cast("decimal(18,6)"))
    w = F.lit(float(half_window))
    left = frames.where(F.col("video_id").isNotNull() & F.col("timestamp").isNotNull() & F.col(event_time).isNotNull())
    left = left.select("video_id", "frame_number", F.col("timestamp").cast("double").alias("timestamp"), F.col(event_time).cast("timestamp").alias("at")).withWatermark("at", delay)
    right = segments.where((F.col("start") <= F.col("end")) & F.col("video_id").isNotNull() & F.col(event_time).isNotNull())
    last = F.floor((F.col("end") - F.col("start")) / longest).cast("int")
    right = right.select(F.col("video_id").alias("of"), "start", "end", "text", F.col(event_time).cast("timestamp").alias("began"), last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    right = right.withColumn("part_start", F.col("start") + F.col("part") * longest).withColumn("part_at", F.col("began") + seconds(F.col("part") * F.lit(longest)))
    right = right.withWatermark("part_at", delay)
    # times may differ from seconds by rounding, so their condition, which bounds the state, is a second wider
    touches = (F.col("start") <= F.col("timestamp") + w) & (F.col("end") >= F.col("timestamp") - w)
    meets = F.greatest(F.col("start"), F.col("timestamp") - w)
    first = ((F.col("part") == 0) | (F.col("part_start") <= meets)) & ((F.col("part") == F.col("last")) | (meets < F.col("start") + (F.col("part") + 1) * longest))
    ahead, behind = (F.lit(datetime.timedelta(seconds=half_window + 1 + x)) for x in (0.0, longest))
    near = (F.col("part_at") <= F.col("at") + ahead) & (F.col("part_at") >= F.col("at") - behind)
    both = left.join(right, (F.col("video_id") == F.col("of")) & near & touches & first, "leftOuter")
    said = F.collect_list(F.when(F.col("of").isNotNull(), F.struct("start", "end", "text")))
    texts = F.array_join(F.transform(F.sort_array(said), lambda s: s["text"]), " ")
    return both.groupBy("video_id", "frame_number", "timestamp", "at").agg(texts.alias("audio_text")).drop("at")
