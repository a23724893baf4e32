"""Nearest neighbours by randomly rotated one-bit codes (after Gao and Long, "RaBitQ", 2024).

Index: vectors go to the nearest of a few centres. What is left of a unit vector beyond its centre is rotated at random
and coded by its signs, one bit a dimension (padded to whole words), with correction scalars: the length of the rest, its
product with the centre, and its product with its own code. Estimate: a query's rest beyond the same centre is rotated
and cut to `PLANES` bits, so that its product with a code comes from packed bits by counting those they share; over the
correction scalar it estimates the inner product, and the same scalar bounds the error.

1. Each query asks its nearest cells. The k-th best score that it gets is a floor that its neighbours must reach.
2. Each query asks every other cell whose hyperplanes lie near enough for a vector at the floor.

Where a query meets a cell, the best by estimate are reranked first, on the original vectors in double precision, which
may raise the floor; then those whose upper bound reaches the floor. What leaves the task is the k best of the cell, so
pairs never become rows. Cells are split into blocks of vectors and their queries into blocks of queries, so no task sees
a whole hot cell, and blocks are cut by bytes, whatever the width. Of equal vectors only the k + 1 with the smallest ids
can be among a query's k nearest, so only these are indexed.

There is a cell for every `CELL` vectors. Up to one for every 16 sampled vectors these are the regions of coarse centres;
beyond, each region is parted by what is left of its vectors, with fine centres that all regions share, so that cells grow
with the table up to the product of both (512 x 512 at the full sample: a billion vectors). Centres are fitted to at most
`SAMPLE` vectors and `SAMPLE_BYTES` bytes.

Recall: a neighbour is lost where its estimate falls short by more than `DEVIATIONS` standard errors (0.6 % of cases at
2.5) or where it lies beyond a hyperplane `REACH` deviations away in a random direction (0.1 % at 3).

Defined results: vectors that are null, zero, not finite somewhere, or shorter than the longest of rows and queries take
no part, as queries or candidates; ties go to the smaller id; fewer candidates than k give fewer rows; ids must be unique;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn, map_batches, written
from .embeddings import cell_distances, codebook
from .vectors import length_of, matrix, taking_part, unit

#: Vectors that centres are fitted to, vectors a cell, cells that round 1 asks, vectors of a block that are reranked first.
SAMPLE, CELL, FIRST_CELLS, FIRST = 8_192, 4_096, 2, 32
#: Bytes of the sample as doubles, and of a block of vectors or queries.
SAMPLE_BYTES, BLOCK_BYTES = 64 << 20, 32 << 20
#: Bits of a query's components; standard errors that bounds allow for, and deviations that cells may be away.
PLANES, DEVIATIONS, REACH = 4, 2.5, 3.0
#: Vectors in a block of a cell and in a block of its queries, at most.
CODES, QUERIES = 32_768, 4_096


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """Whole words of bits x dims, with orthonormal columns."""
    wide = 64 * max(1, -(-dims // 64))
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, dims)))[0]


def codes(rest: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (64-bit words) of rotated rests, and for each its factor, error and product with its centre.

    A query's product with the vector is its product with the centre, plus the last scalar, plus the factor times the
    sum of the query's rotated rest over the code's signs; it is off by the error times the length of that rest.
    """
    y = rest @ turn.T
    wide, length = y.shape[1], np.linalg.norm(y, axis=1)
    own = np.abs(y).sum(axis=1) / math.sqrt(wide) / np.where(length > 0, length, 1)  # the code's product with the unit rest
    own = np.where(length > 0, own, 1)
    factor = length / (own * math.sqrt(wide))
    error = length * np.sqrt(np.maximum(1 - own**2, 0)) / own / math.sqrt(max(wide - 1, 1))
    return np.packbits(y > 0, axis=1, bitorder="little").view("<u8"), np.stack([factor, error, (rest * centre).sum(axis=1)], axis=1).astype(np.float32)


def planes(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (query, plane, word) of rotated rests, and for each its least value, step and sum."""
    y = rest @ turn.T
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
    cut = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
    bits = [np.packbits(cut >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(PLANES)]
    return np.stack(bits, axis=1), low, step, low * y.shape[1] + step * cut.sum(axis=1)


def estimates(queries: np.ndarray, centre: np.ndarray, packed: np.ndarray, scalars: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of unit queries (rows) with codes of one cell (columns), and their standard errors."""
    rest = queries - centre
    bits, low, step, total = planes(rest, turn)
    shared = np.zeros((len(queries), len(packed)), np.float32)
    for j in range(PLANES):
        for w in range(packed.shape[1]):
            shared += np.bitwise_count(bits[:, j, w, None] & packed[None, :, w]) * np.float32(1 << j)
    ones = np.bitwise_count(packed).sum(axis=1).astype(np.float32)
    signed = 2 * (low[:, None] * ones + step[:, None] * shared) - total[:, None]
    about = (queries @ centre)[:, None] + scalars[:, 2] + scalars[:, 0] * signed
    return about, np.linalg.norm(rest, axis=1)[:, None] * scalars[:, 1]


class Cells:
    """Coarse centres, and fine ones that part each coarse region by what is left of its vectors.

    Cell i * len(fine) + j holds the vectors whose nearest coarse centre is i and whose rest is nearest to fine centre j.
    """

    def __init__(self, rows: np.ndarray, wanted: int) -> None:
        most = max(1, len(rows) // 16)
        self.coarse = codebook(rows, int(np.clip(wanted, 1, most)))
        rest = rows - self.coarse[self._nearest(rows, self.coarse)]
        parts = -(-wanted // len(self.coarse))
        self.fine = codebook(rest, min(parts, most)) if parts > 1 else np.zeros((1, rows.shape[1]))

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (np.square(centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)

    def centre(self, cell: int | np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def of(self, rows: np.ndarray) -> np.ndarray:
        i = self._nearest(rows, self.coarse)
        return i * len(self.fine) + self._nearest(rows - self.coarse[i], self.fine)

    def asked(self, rows: np.ndarray, most: np.ndarray | None = None, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells whose squared distance is at most a row's `most`, or without it of a row's `first` nearest.

        A cell is as far as the farther of its coarse and its fine hyperplanes.
        """
        away = cell_distances(rows, self.coarse)[1]
        near = away <= most[:, None] if most is not None else np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1) < first
        row, i = np.nonzero(near)
        if len(self.fine) == 1:
            return row, i
        out = [(row[:0], i[:0], np.zeros(0))]
        step = max(1, (1 << 22) // (len(self.fine) + rows.shape[1]))
        for a in range(0, len(row), step):
            r, c = row[a : a + step], i[a : a + step]
            far = np.maximum(cell_distances(rows[r] - self.coarse[c], self.fine)[1], away[r, c, None])
            at, j = np.nonzero(far <= most[r, None] if most is not None else np.argsort(np.argsort(far, axis=1), axis=1) < first)
            out.append((r[at], c[at] * len(self.fine) + j, far[at, j]))
        row, cell, far = map(np.concatenate, zip(*out, strict=True))
        if most is not None:
            return row, cell
        order = np.lexsort((far, row))
        row, cell = row[order], cell[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < first], cell[rank < first]


def best_of(queries: np.ndarray, qids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, centre: np.ndarray, packed: np.ndarray, scalars: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of each query's k best in a block, of those that reach its floor (NaN: none)."""
    out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    lengths, units = np.sqrt((vectors * vectors).sum(axis=1)), unit(queries)

    def score(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (q * vectors[at]).sum(axis=1) / (np.sqrt((q * q).sum()) * lengths[at])

    for a in range(0, len(qids), 64):
        about, error = estimates(units[a : a + 64], centre, packed, scalars, turn)
        about[qids[a : a + 64, None] == ids] = -np.inf
        high = about + DEVIATIONS * error
        for i in range(len(about)):
            q, floor = queries[a + i], floors[a + i]
            top = np.argpartition(-about[i], FIRST)[:FIRST] if len(ids) > FIRST else np.arange(len(ids))
            first = np.sort(score(q, top[np.isfinite(about[i, top])]))
            floor = np.fmax(floor, first[-k] if len(first) >= k else -np.inf)
            at = np.flatnonzero((high[i] >= floor) & np.isfinite(about[i]))
            at = np.union1d(at, top[np.isfinite(about[i, top])])
            s = score(q, at)
            best = np.lexsort((ids[at], -s))[:k]
            out_q.append(np.full(len(best), qids[a + i]))
            out_v.append(ids[at[best]])
            out_s.append(s[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `df` with the largest cosine for each row of `queries`, itself excepted."""
    dims = max(length_of(df, vector_col), length_of(queries, vector_col))
    own, asked = (taking_part(x, id_col, vector_col, dims=dims) for x in (df, queries))
    turn = rotation(dims)
    kind = own.schema["v"].dataType.simpleString()
    same = Window.partitionBy("v").orderBy("id")
    index = written(own.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r"), "index")
    total = index.count()
    in_bytes = lambda n: max(1, n // (8 * max(dims, 1)))
    some = drawn(index, "id", min(SAMPLE, in_bytes(SAMPLE_BYTES)), total).select("v").toPandas()["v"]  # `SAMPLE` rows at most
    rows = unit(np.array(some.tolist(), np.float64)) if len(some) else np.ones((1, max(dims, 1)))
    cells = Cells(rows, -(-total // cell))
    in_block, queries_in_block = min(CODES, in_bytes(BLOCK_BYTES)), min(QUERIES, in_bytes(BLOCK_BYTES))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = unit(matrix(batch.column(1)))
        at = cells.of(v)
        centres = cells.centre(at)
        packed, scalars = codes(v - centres, centres, turn)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary()), *(pa.array(x) for x in scalars.T)], ["id", "v", "cell", "code", "factor", "error", "product"])

    coded = written(map_batches(index, place, f"id bigint, v {kind}, cell int, code binary, factor float, error float, product float"), "codes")
    sizes = written(coded.groupBy("cell").agg(F.ceil(F.count("*") / in_block).alias("xs")), "sizes")  # a row a cell

    def visits(floors: DataFrame) -> DataFrame:
        """(id, v, floor, cell): the nearest cells where there is no floor yet, else the others that may hold a neighbour."""

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            v, floor = unit(matrix(batch.column(1))), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            q, c = cells.asked(v, first=FIRST_CELLS)
            if not np.isnan(floor).all():  # round 2: those of round 1 are known
                known = q * len(cells) + c
                q, c = cells.asked(v, 2 * (1 - floor) / max(dims, 1) * REACH**2)  # infinite without a floor after round 1
                other = ~np.isin(q * len(cells) + c, known)
                q, c = q[other], c[other]
            return pa.RecordBatch.from_arrays([*(x.take(pa.array(q)) for x in batch.columns), pa.array(c, pa.int32())], ["id", "v", "floor", "cell"])

        return map_batches(floors, f, f"id bigint, v {kind}, floor double, cell int")

    def met(floors: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the k best of each block of each cell that a query asks."""
        of = visits(floors)
        asks = of.groupBy("cell").agg(F.ceil(F.count("*") / queries_in_block).alias("ys")).join(sizes, "cell")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        salt = F.xxhash64("id")
        left = coded.join(asks, "cell").withColumn("x", F.pmod(salt, "xs")).withColumn("y", upto("ys"))
        right = of.join(asks, "cell").withColumn("y", F.pmod(salt, "ys")).withColumn("x", upto("xs"))

        def meet(one: pa.Table, two: pa.Table) -> pa.Table:
            q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if len(one) and len(two):
                scalars = np.stack([one.column(c).to_numpy() for c in ("factor", "error", "product")], axis=1)
                packed = np.frombuffer(b"".join(one.column("code").to_pylist()), "<u8").reshape(len(one), -1)
                q, v, s = best_of(matrix(two.column("v")), two.column("id").to_numpy(), two.column("floor").to_numpy(), matrix(one.column("v")), one.column("id").to_numpy(), cells.centre(one.column("cell")[0].as_py()), packed, scalars, turn, k)
            return pa.table({"query_id": q, "vec_id": v, "score": s})

        keys = ["cell", "x", "y"]
        left, right = left.select(*keys, "id", "v", "code", "factor", "error", "product"), right.select(*keys, "id", "v", "floor")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")

    def ranked(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    first = written(ranked(met(asked.withColumn("floor", F.lit(None).cast("double")))), "first")
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    # a query with fewer than k candidates so far has no floor and asks all cells
    floors = asked.join(floors, asked["id"] == floors["query_id"], "left").select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return ranked(first.drop("rank").unionByName(met(floors))).select("query_id", "rank", "vec_id", "score")
