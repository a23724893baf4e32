"""Helpers that the training-data operators share: table access, shared storage, Arrow maps, components."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every word-based operator: space and \t \n \v \f \r.
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from wherever `sf_dir` is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """`name`, longer by underscores until `df` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names, or in local mode a fresh one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if (known := sc._jsc.sc().getCheckpointDir()).isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, so that lost executors never force it to be computed again.

    `chronoframe.session.drop_tables` deletes an application's tables.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "tables", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes as one array and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, rows_bytes: int = 1 << 20) -> DataFrame:
    """`f` over Arrow batches of `df`, gathered up to about `rows_bytes` bytes; a batch is never less than one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, rows_bytes):
            out = f(batch)
            if out is None:
                continue
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers wait for their next task with little in hand."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Larger batches of the same rows in the same order, and smaller ones where the input's exceed `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield _one(held)
                held, size = [], 0
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole.to_batches()[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer over a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes of a word that are hashed in blocks of eight; what lies beyond goes to xxh3.
BLOCK_BYTES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def blocks_of(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of `body` on, as one number; zeros stand behind its end."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    return np.ndarray(len(body) + 1, "<u8", padded, strides=(1,))


def hashes_of(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: a finalizer after every block of eight bytes, so no two blocks cancel out."""
    size = ends - starts
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
    if not len(size):
        return out
    blocks, live = blocks_of(body), np.arange(len(size))
    for done in range(0, BLOCK_BYTES, 8):
        left = size[live] - done
        block = blocks[starts[live] + done] & _MASKS[np.minimum(left, 8)]
        with np.errstate(over="ignore"):
            out[live] = mix64((out[live] ^ block) * np.uint64(0x5851F42D4C957F2D) + np.uint64(0x14057B7EF767814F))
        live = live[left > 8]
        if not len(live):
            return out
    for i in live.tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(body[starts[i] + BLOCK_BYTES : ends[i]].tobytes(), int(out[i])))
    return out


def unlike(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Spans whose bytes differ from those of the span that stands for them."""
    size = ends - starts
    differ = size != size[lead]
    blocks = blocks_of(body)
    live = np.flatnonzero(~differ & (lead != np.arange(len(lead))))
    done = 0
    while len(live):
        left = size[live] - done
        x = (blocks[starts[live] + done] ^ blocks[starts[lead[live]] + done]) << ((8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8))
        differ[live[x != 0]] = True
        live = live[(x == 0) & (left > 8)]
        done += 8
    return np.flatnonzero(differ)


def in_parts(
    encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], body: np.ndarray, offsets: np.ndarray, safe: Callable[[np.ndarray], np.ndarray], most: int
) -> tuple[np.ndarray, np.ndarray]:
    """`encode` of rows, which gives values of all rows and where rows begin and end, over parts of about `most` bytes.

    Longer rows are cut where that changes nothing: `safe` tells where, of bytes with one more on either side. So memory
    doesn't grow with the longest text by more than its values.
    """
    if len(body) <= 2 * most:
        return encode(body, offsets)
    edges, starts = [], []  # of parts, and which part each row starts with
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        starts.append(len(edges))
        edges.append(a)
        while b - a > 2 * most:
            look = np.flatnonzero(safe(body[a + most - 1 : min(a + 2 * most, b)]))
            a += most + (int(look[0]) if len(look) else 0)
            if len(look):
                edges.append(a)
    every = np.array([*edges, len(body)], np.int64)
    values, upto, first = [], [np.zeros(1, np.int64)], 0
    while first < len(edges):
        last = max(first + 1, int(np.searchsorted(every, every[first] + most, "right")) - 1)
        own, at = encode(body[every[first] : every[last]], every[first : last + 1] - every[first])
        values.append(own)
        upto.append(upto[-1][-1] + at[1:])
        first = last
    return np.concatenate(values), np.concatenate(upto)[[*starts, len(edges)]]


class HashTable:
    """Numbers by key, not negative both, looked up an array at a time; -1 where a key isn't there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            some = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[some]], self.values[slot[some]] = keys[some], values[some]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, out = self.keys[slot], self.values[slot]
        other = found != keys
        out[other] = -1
        left = np.flatnonzero(other & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def words_of(body: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: 64-bit hashes, starts, ends (byte positions) and, for each row, its first word's number.

    Words are maximal runs of bytes other than `WORD_SEPARATORS`; a row's end always ends a word.
    `lower` folds A-Z only.
    """
    rows = len(offsets) - 1
    if not len(body):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(rows + 1, np.int64)
    inside = np.ones(256, bool)
    inside[list(WORD_SEPARATORS)] = False
    word = inside[body]
    before = np.empty(len(body), bool)
    before[0] = False
    before[1:] = word[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(body)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(body), bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[cuts[(cuts > 0)] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return hashes_of(_LOWER[body] if lower else body, starts, ends), starts, ends, np.searchsorted(starts, offsets, "left")


def windows_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` values from each position that has as many after it, by doubling of window lengths."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        have, power, out, done, rest = hashes, 1, None, 0, length
        while rest:
            if rest & 1:
                part = have[done:]
                out = part.copy() if out is None else mix64(out[: len(part)] * np.uint64(0xD6E8FEB86659FD93) + part[: len(out)])
                done += power
            rest >>= 1
            if rest:
                have = mix64(have[:-power] * np.uint64(0xA0761D6478BD642F) + have[power:])
                power *= 2
        return out[:n]


def drawn(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """At most `most` of `total` rows, the first by a hash of `key`; hardly more than these leave their tasks."""
    spread = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return df.where(spread < int(min(1.0, 1.5 * most / max(total, 1)) * (1 << 30))).orderBy(spread, key).limit(most)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of an id's decimal text, modulo `buckets`."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(buckets))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as (id, component) with the smallest id of each; by large and small stars.

    Each round links every vertex to its smallest neighbour, first larger neighbours then smaller ones
    (Kiveris et al., 2014). Only per-vertex minima are grouped, so hubs are pre-aggregated; edges stay in tables.
    Vertices without edges don't appear. Null ids and self links are ignored. Minima are written before edges meet them,
    so that AQE can split a hub's edges. The result is a written table.
    """
    now = written(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "minima")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "edges")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("u", "v").cast("long"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return written(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()), "components")
