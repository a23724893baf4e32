"""Best-fit packing of tokenized documents with swap-based local search.

How pieces fit depends on their lengths alone, and there are at most `capacity` of these. So the plan is made on the
driver from the number of pieces of each length, over *kinds* of bins: what lengths a bin holds, and how many such bins
there are. At first each bin holds one piece. Local search then moves pieces, swaps one for one and two for one between
underfull bins: the fullest gains what fits it best from emptier ones, so that the sum of squared fills grows, until bins
empty, the lower bound is met or no step improves any two bins; no limit ends it earlier. A step acts on as many bins of
the two kinds as there are pairs of them.

A piece's rank among those of its length tells its bin and offset. Ranks are made from counts of salted groups, so no
task sees all pieces of one length.

Defined results: null and empty texts are one piece holding the closing id; longer documents than a bin are cut into
full pieces and a rest; equal lengths are told apart by rank in (doc_id, piece) order; ids may repeat; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, text_bytes, written
from .wordpieces import word_tokenizer

CLOSING_ID = 0


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece of every whole text."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        body, at = word_tokenizer(vocabulary).encode_all(*text_bytes(batch.column(1)))
        size = np.diff(at) + 1
        every = np.insert(body, at[1:], CLOSING_ID)
        n = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start, base = piece * capacity, (np.cumsum(size) - size)[row]
        length = np.minimum(size[row] - start, capacity)
        raw = memoryview(every.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((base + start).tolist(), (base + start + length).tolist(), strict=True)]
        out = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        if ids:  # pieces follow one another without gaps
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(every.astype(np.int32))))
        return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), f, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


Kind = tuple[tuple[int, int], ...]  # (length, how many), longest first


def _kind(counts: dict[int, int]) -> Kind:
    return tuple(sorted(((k, n) for k, n in counts.items() if n), reverse=True))


def _fill(kind: Kind) -> int:
    return sum(k * n for k, n in kind)


def _changed(kind: Kind, gives: list[int], takes: list[int]) -> Kind:
    counts = defaultdict(int, dict(kind))
    for x in gives:
        counts[x] -= 1
    for x in takes:
        counts[x] += 1
    return _kind(counts)


def first_bins(histogram: dict[int, int], capacity: int) -> dict[Kind, int]:
    """Kinds of bins and their numbers with one piece in each bin; local search does the packing."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    return {((length, 1),): n for length, n in histogram.items() if n}


class _Holders:
    """For each size, the kinds that can give it and have room, in order of their room."""

    def __init__(self, most: int) -> None:
        self.kinds: list[list[tuple[int, Kind]]] = [[] for _ in range(most + 1)]
        self.room = np.full(most + 1, -1, np.int64)  # of the roomiest

    def add(self, size: int, room: int, kind: Kind) -> None:
        insort(self.kinds[size], (room, kind))
        self.room[size] = self.kinds[size][-1][0]

    def remove(self, size: int, room: int, kind: Kind) -> None:
        own = self.kinds[size]
        del own[bisect_left(own, (room, kind))]
        self.room[size] = own[-1][0] if own else -1

    def largest(self, upto: int, b: Kind, room: int, alone: bool) -> tuple[int, Kind] | None:
        """The largest size up to `upto` that a bin at most as full as `b` can give, and the emptiest such kind."""
        sizes = np.flatnonzero(self.room[: max(0, upto) + 1] >= room)
        for size in sizes[::-1].tolist():
            for have, kind in reversed(self.kinds[size]):
                if have < room:
                    break
                if kind != b or not alone:
                    return size, kind
        return None


def _pairs(kind: Kind) -> dict[int, tuple[int, int]]:
    """Sums of two pieces of a bin, and which two."""
    return {x + z: (x, z) for i, (x, n) in enumerate(kind) for z in [x] * (n > 1) + [k for k, _ in kind[i + 1 :]]}


class _Search:
    """Bins by kind; underfull kinds in order of their room, and by what they can give."""

    def __init__(self, bins: dict[Kind, int], capacity: int) -> None:
        self.capacity = capacity
        self.bins: dict[Kind, int] = {}
        self.underfull: list[tuple[int, Kind]] = []  # (room, kind), the fullest first
        self.ones, self.twos = _Holders(capacity), _Holders(2 * capacity)
        for kind, n in bins.items():
            self.add(kind, n)

    def add(self, kind: Kind, n: int) -> None:
        have = self.bins.get(kind, 0)
        self.bins[kind] = have + n
        room = self.capacity - _fill(kind)
        if not have and room:
            insort(self.underfull, (room, kind))
            for x, _ in kind:
                self.ones.add(x, room, kind)
            for s in _pairs(kind):
                self.twos.add(s, room, kind)

    def remove(self, kind: Kind, n: int) -> None:
        self.bins[kind] -= n
        if self.bins[kind]:
            return
        del self.bins[kind]
        room = self.capacity - _fill(kind)
        if room:
            del self.underfull[bisect_left(self.underfull, (room, kind))]
            for x, _ in kind:
                self.ones.remove(x, room, kind)
            for s in _pairs(kind):
                self.twos.remove(s, room, kind)

    def step(self, b: Kind) -> tuple[Kind, list[int], list[int]] | None:
        """A bin at most as full as `b`, what it gives and what it takes, so that `b` gains most; or None."""
        room, alone = self.capacity - _fill(b), self.bins[b] == 1
        best, most = None, 0
        if found := self.ones.largest(room, b, room, alone):  # a move
            best, most = (found[1], [found[0]], []), found[0]
        for holders in (self.ones, self.twos):  # one for one, two for one
            for y, _ in b:
                if most == room:
                    return best
                if (found := holders.largest(room + y, b, room, alone)) and found[0] - y > most:
                    size, a = found
                    best, most = (a, [size] if holders is self.ones else list(_pairs(a)[size]), [y]), size - y
        return best


def local_search(bins: dict[Kind, int], capacity: int, counts: dict[str, int] | None = None) -> dict[Kind, int]:
    """Fewer bins, or as many: the fullest underfull bin gains from emptier ones while the sum of squared fills grows.

    Ends where bins meet the lower bound, or no move, one for one or two for one improves any two bins. Every step adds
    at least 2 to that sum, so it does end. counts: how many steps of each sort were taken.
    """
    at = _Search(bins, capacity)
    bound, left = -(-sum(_fill(k) * n for k, n in bins.items()) // capacity), sum(bins.values())
    looked, improved = 0, False  # fullest underfull kinds without a step, and whether any step was made since the first
    while left > bound:
        if looked >= len(at.underfull):
            if not improved:
                break
            looked, improved = 0, False
            continue
        b = at.underfull[looked][1]
        found = at.step(b)
        if not found:
            looked += 1
            continue
        a, gives, takes = found
        if counts is not None:
            counts[f"{len(gives)}:{len(takes)}"] = counts.get(f"{len(gives)}:{len(takes)}", 0) + 1
        improved = improved or looked > 0
        times = at.bins[a] // 2 if a == b else min(at.bins[a], at.bins[b])
        new_a, new_b = _changed(a, gives, takes), _changed(b, takes, gives)
        at.remove(a, times)
        at.remove(b, times)
        if new_a:
            at.add(new_a, times)
        else:
            left -= times
        at.add(new_b, times)
    return at.bins


class Plan:
    """Where the pieces of each length go, by rank: arrays to look ranks up in."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        bins = local_search(first_bins(histogram, capacity), capacity)
        self.bins = sum(bins.values())
        used: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for kind in sorted(bins, reverse=True):
            offset = 0
            for length, each in kind:
                rows.append(((length << 50) + used[length], first, each, offset))
                used[length] += bins[kind] * each
                offset += length * each
            first += bins[kind]
        if used != {k: n for k, n in histogram.items() if n}:
            raise AssertionError("the plan must place every piece once")
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.keys, self.first, self.each, self.offset = table.T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the pieces with these ranks, from 0, among those of their length."""
        at = np.searchsorted(self.keys, (length << 50) + rank, "right") - 1
        q = (length << 50) + rank - self.keys[at]
        return self.first[at] + q // self.each[at], self.offset[at] + q % self.each[at] * length


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece with its place."""
    own = written(pieces(docs, vocabulary, capacity), "pieces")
    histogram = {r[0]: r[1] for r in own.groupBy("length").count().collect()}  # `capacity` rows at most
    plan = Plan(histogram, capacity)
    salts = max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(sizes, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r")).alias("rank"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, offset = plan.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_batches(ranked, f, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
