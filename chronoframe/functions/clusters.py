"""Centres of vectors, fitted to a bounded sample, and the nearest one of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample for each centre; rounds of fitting.
PER_CENTRE, ROUNDS = 16, 8


def fitted(rows: DataFrame, cells: int) -> np.ndarray:
    """At most `cells` centres of rows (id, embedding of one length), fitted to `PER_CENTRE` rows for each, the first by a hash of the id."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(cells * PER_CENTRE).select("embedding").toArrow().column(0).combine_chunks()
    sizes = sample.value_lengths().to_numpy() if len(sample) else np.zeros(0, np.int64)
    x = matrix(sample, int(sizes[0]))[1] if len(sizes) else np.zeros((0, 1))
    return _rounds(x, min(cells, len(x))) if len(x) else np.zeros((1, x.shape[1]))


def _rounds(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows; a centre that loses all its rows stays where it was."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = assigned(sample, centres)[0]
        total, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(total, own, sample)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def assigned(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it."""
    own = np.concatenate([np.argmin((centres**2).sum(1) - 2 * part @ centres.T, 1) for part in (x[i : i + rows] for i in range(0, len(x), rows))] or [np.zeros(0, np.int64)])
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are vectors of `dims` finite numbers, and these vectors."""
    size = column.value_lengths().fill_null(-1).to_numpy()
    good = np.flatnonzero(size == dims)
    x = column.take(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(x).all(1)  # nulls inside a vector are NaN here
    return good[fine], x[fine]
