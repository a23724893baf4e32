"""Pixel functions in numpy over BGR or gray bytes; Arrow functions where a column form is needed."""

from __future__ import annotations

import base64
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(bgr: np.ndarray) -> np.ndarray:
    """ITU-R 601 luma, rounded."""
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299).astype(np.uint8)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = image.shape[:2]
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1), np.clip(x - x0, 0, 1)
    extra = (1,) * (image.ndim - 2)
    fy, fx = fy.reshape(-1, 1, *extra), fx.reshape(1, -1, *extra)
    a = image.astype(np.float64)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def thumb(bgr: np.ndarray, size: tuple[int, int] = (320, 240)) -> bytes:
    return gray(resized(bgr, *size)).tobytes()


def changed_share(a: bytes, b: bytes, delta: int = 15) -> float:
    """Share of pixels of two gray thumbs that differ by more than `delta`."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int16), np.frombuffer(b, np.uint8).astype(np.int16)
    return float((np.abs(x - y) > delta).mean()) if len(x) == len(y) and len(x) else 1.0


def _changed(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else changed_share(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def pixel_change(a: Column, b: Column) -> Column:
    """`changed_share` of two columns of thumbs."""
    return F.pandas_udf(_changed, "double")(a, b)


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue in [0, 180), saturation and value in [0, 256)."""
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    safe = np.where(span == 0, 1, span)
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    hue = np.where(span == 0, 0, hue * 30) % 180
    return np.stack([np.rint(hue) % 180, np.rint(np.where(top == 0, 0, span * 255 / np.where(top == 0, 1, top))), top], axis=-1)


def histogram(bgr: np.ndarray, bins: int = 8) -> np.ndarray:
    """bins ** 3 counts over hue, saturation and value."""
    h = hsv(bgr).reshape(-1, 3)
    at = np.minimum((h / np.array([180, 256, 256]) * bins).astype(int), bins - 1)
    return np.bincount(at[:, 0] * bins * bins + at[:, 1] * bins + at[:, 2], minlength=bins**3)


def histogram_dissimilarity(a: np.ndarray, b: np.ndarray) -> float:
    """max(0, 1 - correlation)."""
    x, y = a - a.mean(), b - b.mean()
    below = np.sqrt((x * x).sum() * (y * y).sum())
    return max(0.0, 1.0 - (float((x * y).sum() / below) if below else 1.0))


def tabular_bin(h: Column, s: Column, v: Column, bins: int = 8) -> Column:
    """The histogram bin of a pixel held in columns."""
    part = lambda x, most: F.least(F.floor(x / most * bins), F.lit(bins - 1))
    return part(h, 180) * bins * bins + part(s, 256) * bins + part(v, 256)


def gradient_hash(bgr: np.ndarray, size: int = 8) -> int:
    """size * size bits, row by row: is a pixel brighter than its left neighbour; as a signed 64-bit number."""
    g = resized(gray(bgr), size + 1, size).astype(np.int16)
    bits = (g[:, 1:] > g[:, :-1]).ravel()
    value = int("".join("1" if x else "0" for x in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def data_uri(bgr: np.ndarray, longest: int | None = None, quality: int = 85) -> str:
    """A JPEG data URI, downscaled to `longest` if given; needs the optional Pillow."""
    from PIL import Image

    image = Image.fromarray(np.ascontiguousarray(bgr[..., ::-1]))
    if longest and max(image.size) > longest:
        scale = longest / max(image.size)
        image = image.resize((int(image.width * scale), int(image.height * scale)), Image.LANCZOS)
    out = io.BytesIO()
    image.save(out, "JPEG", quality=quality)
    return "data:image/jpeg;base64," + base64.b64encode(out.getvalue()).decode()
