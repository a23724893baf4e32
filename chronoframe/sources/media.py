"""Media files: uploads, still images and a video data source.

Decoders are optional. Videos are read by a Python data source, one partition a file, if `cv2` can be imported.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.image import thumb
from ..functions.text import video_id

#: File types that are taken in.
FORMATS = ("mp4", "avi", "mov", "mkv", "webm")


def accepted(path_column: str = "path"):
    """Whether a path has one of the accepted types."""
    return F.lower(F.element_at(F.split(path_column, r"\."), -1)).isin(*FORMATS)


def land(name: str, content: bytes, folder: str) -> str:
    """Writes an upload; one of the same name is overwritten."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, os.path.basename(name))
    with open(path, "wb") as f:
        f.write(content)
    return path


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, video_id, video_name) of accepted files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(accepted("path")).select("path", "length", video_id(F.col("path")).alias("video_id"), F.element_at(F.split("path", "/"), -1).alias("video_name"))


def path_of(files: DataFrame, video: str) -> DataFrame:
    """The first file, by path, whose derived id is `video`; no row if there is none."""
    return files.where(F.col("video_id") == video).orderBy("path").limit(1)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Still images as frames: BGR bytes from the built-in image source, numbered by path within their folder."""
    own = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")
    return own.select(F.col("origin").alias("path"), "width", "height", "nChannels", "data")


def image_thumbs(frames: DataFrame, size: tuple[int, int] = (320, 240)) -> DataFrame:
    """Adds `thumb`, the gray downscaled bytes that frames are compared by."""

    def f(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["thumb"] = [thumb(np.frombuffer(d, np.uint8).reshape(h, w, c)[..., :3], size) if c >= 3 else None for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"], strict=True)]
            yield pdf.drop(columns=["data"])

    return frames.mapInPandas(f, "path string, width int, height int, nChannels int, thumb binary")


class _Video(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _VideoReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_Video]:
        return [_Video(p) for p in self.paths]

    def read(self, partition: _Video) -> Iterator[tuple]:
        import cv2

        capture = cv2.VideoCapture(partition.path)
        if not capture.isOpened():
            raise OSError(f"can't open {partition.path}")
        own = hashlib.md5(os.path.basename(partition.path).encode()).hexdigest()[:8]
        number = 0
        try:
            while True:
                ok, pixels = capture.read()
                if not ok:
                    if not number:
                        raise OSError(f"no first frame in {partition.path}")
                    return
                yield own, number, float(capture.get(cv2.CAP_PROP_POS_MSEC)) / 1000 if number else 0.0, pixels.shape[1], pixels.shape[0], thumb(pixels)
                number += 1
        finally:
            capture.release()


class VideoFrames(DataSource):
    """spark.read.format('video_frames').option('paths', 'a.mp4,b.mp4'): every frame in order with its gray thumb."""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return "video_id string, frame_number bigint, timestamp double, width int, height int, thumb binary"

    def reader(self, schema) -> DataSourceReader:
        return _VideoReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


def probe(path: str) -> dict[str, object]:
    """fps, total_frames and duration of a video (0 without a rate); raises if it can't be opened."""
    import cv2

    capture = cv2.VideoCapture(path)
    if not capture.isOpened():
        raise OSError(f"can't open {path}")
    try:
        fps, total = float(capture.get(cv2.CAP_PROP_FPS)), int(capture.get(cv2.CAP_PROP_FRAME_COUNT))
    finally:
        capture.release()
    return {"path": path, "video_name": os.path.basename(path), "fps": fps, "total_frames": total, "duration": total / fps if fps > 0 else 0.0}


def extract_audio(video: str, wav: str, rate: int = 16_000) -> bool:
    """A mono WAV of a video's sound by ffmpeg; False if that isn't there or fails."""
    if not shutil.which("ffmpeg"):
        return False
    done = subprocess.run(["ffmpeg", "-y", "-i", video, "-vn", "-ac", "1", "-ar", str(rate), wav], capture_output=True, check=False)
    return done.returncode == 0 and os.path.exists(wav)


def cut_chunk(video: str, start: float, end: float, out: str) -> str | None:
    """A clip of a video, kept if it is already there; None if it can't be made."""
    if os.path.exists(out):
        return out
    if not shutil.which("ffmpeg"):
        return None
    done = subprocess.run(["ffmpeg", "-y", "-ss", str(start), "-i", video, "-t", str(end - start), out], capture_output=True, check=False)
    return out if done.returncode == 0 else None


def frames_between(frames: DataFrame, start: float, end: float) -> DataFrame:
    """A clip's frames: from start on, before end."""
    return frames.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
