"""Model calls as providers: protocols, how a failure is covered, and deterministic offline ones.

Real models are plug-ins that implement these protocols; nothing here imports a client.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.responses import ocr_record
from ..functions.text import OCR_REFUSALS


class Ocr(Protocol):
    def __call__(self, image: bytes) -> str: ...


class Describe(Protocol):
    def __call__(self, image: bytes) -> str: ...


class Features(Protocol):
    dims: int

    def __call__(self, images: list[bytes]) -> np.ndarray: ...


class Transcribe(Protocol):
    def __call__(self, audio: bytes) -> Iterable[tuple[float, float, str]]: ...


class Embed(Protocol):
    dims: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors from hashed words: equal texts have equal vectors, and shared words bring texts closer."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                row[h % self.dims] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)


def recognized(frames: DataFrame, ocr: Callable[[bytes], str], image: str = "data") -> DataFrame:
    """Adds `extracted_text`; refusals, NONE and any failure give ''."""

    @F.pandas_udf("string")
    def read(images: pd.Series) -> pd.Series:
        def one(data: bytes) -> str:
            try:
                text = (ocr(data) or "").strip()
            except Exception:  # a provider's failure is no text
                return ""
            folded = text.lower()
            return "" if folded == "none" or any(w in folded for w in OCR_REFUSALS) else text

        return images.map(one)

    return frames.withColumn("extracted_text", read(F.col(image)))


def texts_read(frames: DataFrame, ocr: Callable[[bytes], str], image: str = "data", enabled: bool = True) -> DataFrame:
    """Adds `ocr`, the standalone recognizer's record; NO_TEXT, nothing, a failure or a switched-off recognizer give the empty one."""

    @F.pandas_udf("string")
    def read(images: pd.Series) -> pd.Series:
        def one(data: bytes) -> str:
            try:
                return (ocr(data) or "").strip()
            except Exception:  # a provider's failure is no text
                return ""

        return images.map(one)

    return frames.withColumn("ocr", ocr_record(read(F.col(image)) if enabled else F.lit("")))


def featured(frames: DataFrame, model: Callable[[], Features], image: str = "data") -> DataFrame:
    """Adds `features`, unit vectors of images. `model` makes the extractor, once a task; its failures aren't covered."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = model()
        for images in batches:
            found = np.asarray(extract(images.tolist()), np.float64).reshape(len(images), -1)
            yield pd.Series(list(found / (np.linalg.norm(found, axis=1, keepdims=True) + 1e-8)))

    return frames.withColumn("features", run(F.col(image)))


def described(frames: DataFrame, describe: Callable[[bytes], str], image: str = "data") -> DataFrame:
    """Adds `content`, a model's raw answer; a failure gives null, which parses to the fallback record."""

    @F.pandas_udf("string")
    def ask(images: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            try:
                return describe(data)
            except Exception:  # a provider's failure is no answer
                return None

        return images.map(one)

    return frames.withColumn("content", ask(F.col(image)))


def embedded(rows: DataFrame, embed: Embed, text: str = "prompt") -> DataFrame:
    """Adds `embedding`; a failed batch gets zero vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                found = np.asarray(embed(texts.fillna("").tolist()), np.float32)
            except Exception:  # a provider's failure is a batch of zeros
                found = np.zeros((len(texts), embed.dims), np.float32)
            yield pd.Series(list(found))

    return rows.withColumn("embedding", run(F.col(text)))


def transcribed(media: DataFrame, transcribe: Callable[[bytes], Iterable[tuple[float, float, str]]], audio: str = "content") -> DataFrame:
    """(video_id, start, end, text) of every file's speech, texts stripped; a failure gives no rows."""
    kind = media.schema["video_id"].dataType.simpleString()

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for video, data in zip(pdf["video_id"], pdf[audio], strict=True):
                try:
                    rows += [(video, float(a), float(b), t.strip()) for a, b, t in transcribe(data)]
                except Exception:  # a provider's failure is an empty transcript
                    continue
            yield pd.DataFrame(rows, columns=["video_id", "start", "end", "text"])

    return media.select("video_id", audio).mapInPandas(f, f"video_id {kind}, start double, end double, text string")
