"""Speech recognition as a table function: from clips of audio to rows of segments.

A clip is a stretch of a video's audio that begins at `offset` seconds. `spoken` takes a table of clips as a table argument,
dealt out by video and in order of time; `lateral` is the same for one clip a call, for LATERAL joins. Texts are stripped. A
clip whose recognition fails, a null clip and a switched-off recognizer give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Transcribe = Callable[[bytes], Iterable[tuple[float, float, str]]]


def _heard(transcribe: Transcribe, offset: float | None, content: bytes | None) -> list[tuple[float, float, str]]:
    if content is None or offset is None:
        return []
    try:
        return [(offset + float(a), offset + float(b), t.strip()) for a, b, t in transcribe(bytes(content))]
    except Exception:  # a provider's failure is an empty transcript
        return []


def spoken(clips: DataFrame, transcribe: Transcribe, enabled: bool = True) -> DataFrame:
    """(video_id, number, start, end, text) of clips (video_id, offset, content); segments are numbered from 0 in each video."""
    kind = clips.schema["video_id"].dataType.simpleString()

    class Speech:
        def __init__(self) -> None:
            self.n = 0

        def eval(self, clip) -> Iterator[tuple]:  # noqa: ANN001
            for start, end, text in _heard(transcribe, clip["offset"], clip["content"]) if enabled else []:
                yield clip["video_id"], self.n, start, end, text
                self.n += 1

    function = F.udtf(Speech, returnType=f"video_id {kind}, number bigint, start double, end double, text string")
    own = clips.select("video_id", F.col("offset").cast("double").alias("offset"), F.col("content").cast("binary").alias("content"))
    return function(own.asTable().partitionBy("video_id").orderBy("offset"))


def _of_clip(transcribe: Transcribe) -> type:
    class Speech:
        def eval(self, offset: float, content: bytes) -> Iterator[tuple]:
            yield from _heard(transcribe, offset, content)

    return Speech


def lateral(clips: DataFrame, transcribe: Transcribe) -> DataFrame:
    """`clips` (offset, content, ...) with a row for each segment, by a LATERAL join: start, end, text are added."""
    function = F.udtf(_of_clip(transcribe), returnType="start double, end double, text string")
    return clips.lateralJoin(function(F.col("offset").cast("double").outer(), F.col("content").outer()))


def register(spark: SparkSession, name: str, transcribe: Transcribe) -> None:
    """Makes the function known to SQL: SELECT ... FROM clips, LATERAL name(clips.offset, clips.content)."""
    spark.udtf.register(name, F.udtf(_of_clip(transcribe), returnType="start double, end double, text string"))
