"""The keyframe graph: semantic edges between similar vectors, temporal edges between neighbours, and their merger."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import clusters, vector
from . import packed
from .pagerank import written

#: Rows of vectors in one block of the comparison.
BLOCK = 1_024
#: Sides that blocks are dealt to: a block goes to as many tasks as there are sides, so what is shuffled grows with the
#: vectors. Bytes of vectors on a side at most; beyond `SIDES` times that there are more sides.
SIDES, SIDE_BYTES = 16, 64 << 20
#: Edges that a task holds before it packs them.
HELD = 2_000_000


PACKS = "b int, pack binary"


def _packed(group: pa.Table) -> pa.Table:
    """A block's vectors and all that goes with them, as one row."""
    sink = pa.BufferOutputStream()
    own = group.drop_columns(["b"]).sort_by("ord").combine_chunks()
    with pa.ipc.new_stream(sink, own.schema) as out:
        out.write_table(own)
    return pa.table({"b": group.column("b").slice(0, 1), "pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


class _Side:
    """Blocks of one side, one after another: their columns, vectors as they are, lengths, unit vectors in single precision."""

    def __init__(self, packs: list[bytes], side: int) -> None:
        self.side = side
        parts = [pa.ipc.open_stream(p).read_all() for p in packs]
        self.cuts = np.cumsum([0, *map(len, parts)])
        self.columns = pa.concat_tables(parts).combine_chunks()
        self.ord = self.columns.column("ord").to_numpy()
        new = np.diff(self.ord, prepend=self.ord[0] - 1) != 0  # rows of one `ord` are one vertex and lie together
        self.vertex, self.n = np.cumsum(new) - 1, int(new.sum())
        self.starts = np.append(self.vertex[self.cuts[:-1]], self.n)
        embedding = self.columns.column("embedding").combine_chunks()
        self.embedding = embedding.chunk(0) if isinstance(embedding, pa.ChunkedArray) else embedding
        self.dims = max(self.embedding.value_lengths().fill_null(0).to_numpy().max(initial=0), 0)

    def measured(self, dims: int) -> _Side:
        self.x = np.full((len(self.ord), dims), np.nan)  # null, unlike and non-finite vectors are near none
        good, x = clusters.matrix(self.embedding, dims)
        self.x[good] = x
        self.length = np.linalg.norm(self.x, axis=1)
        self.unit = (self.x / np.where(self.length == 0, 1.0, self.length)[:, None]).astype(np.float32)
        return self


def _cosines(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of a with rows j of b, 0 where one has no length; NaN where one is no vector."""
    dots = np.concatenate([np.einsum("ij,ij->i", a.x[i[k : k + 16_384]], b.x[j[k : k + 16_384]]) for k in range(0, max(1, len(i)), 16_384)])
    lengths = a.length[i] * b.length[j]
    return np.where(lengths == 0, 0.0, dots / np.where(lengths == 0, 1.0, lengths))


def _met(batches: Iterator[pa.RecordBatch], threshold: float, following: bool) -> Iterator[tuple[_Side, _Side, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Similar pairs between two sides, or within one, block by block: both sides, rows in them and cosines.

    With `following` first vectors and the next of their videos, with which of these are similar pairs (else None).
    """

    def semantic(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray):
        keep = a.ord[i] < b.ord[j]
        if following:  # these are made once, below
            keep &= a.columns.column("next").fill_null(-1).to_numpy()[i] != b.ord[j]
        i, j = i[keep], j[keep]
        cos = _cosines(a, b, i, j)
        keep = cos >= threshold
        if keep.any():
            yield a, b, i[keep], j[keep], cos[keep], None

    def temporal(a: _Side, b: _Side):
        after, order = a.columns.column("next"), np.argsort(b.ord)
        i = np.flatnonzero(after.is_valid().to_numpy())
        place = np.searchsorted(b.ord[order], want := after.fill_null(-1).to_numpy()[i])
        j = order[np.minimum(place, len(order) - 1)]
        i, j = i[b.ord[j] == want], j[b.ord[j] == want]
        cos = _cosines(a, b, i, j)
        if len(i):
            yield a, b, i, j, cos, (cos >= threshold) & (a.ord[i] < b.ord[j])

    group = pa.Table.from_batches(batches).sort_by([("side", "ascending"), ("b", "ascending")])
    x, y, side = group.column("x")[0].as_py(), group.column("y")[0].as_py(), group.column("side").to_numpy()
    if x != y and len(set(side.tolist())) < 2:
        return
    sides = [_Side(group.filter(pa.array(side == s)).column("pack").to_pylist(), s) for s in sorted({x, y})]
    dims = int(max(s.dims for s in sides))
    a, b = (s.measured(dims) for s in (sides[0], sides[-1]))
    meet = np.ones((len(a.cuts) - 1, len(b.cuts) - 1), bool)
    if "angle" in group.column_names:
        centre, angle = np.array(group.column("centre").to_pylist(), np.float64), group.column("angle").to_numpy()
        meet = _may_meet(centre[side == x], angle[side == x], centre[side == y], angle[side == y], threshold)
    if following:
        yield from temporal(a, b)
        if a is not b:
            yield from temporal(b, a)
    least = threshold - (dims + 4) * 1.2e-7  # single precision is off by less than that
    for p, q in zip(*np.nonzero(np.triu(meet) if a is b else meet), strict=True):
        one, two = a.cuts[p], b.cuts[q]
        i, j = np.nonzero(a.unit[one : a.cuts[p + 1]] @ b.unit[two : b.cuts[q + 1]].T >= least)
        i, j = i + one, j + two
        yield from semantic(a, b, i, j)
        if a is not b or p != q:  # a block with itself has each pair both ways
            yield from semantic(b, a, j, i)


def _compared(threshold: float, ends: list[str], following: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Similar pairs as rows; with `following` also vectors and the next of their videos."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, i, j, cos, alike in _met(batches, threshold, following):
            out = [side.columns.column(c).take(pa.array(at)).combine_chunks() for side, at in ((a, i), (b, j)) for c in ends]
            out = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out]
            cos, follows = pa.array(cos, mask=None if alike is None else ~alike), pa.array(np.full(len(i), alike is not None))
            yield pa.RecordBatch.from_arrays([*out, cos, follows], [*(f"s_{c}" for c in ends), *(f"t_{c}" for c in ends), "similarity", "follows"])

    return compare


def _packs(threshold: float, decay: float, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The weights of merged edges, packed by the source's block and the target's side."""

    def weights(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> np.ndarray:
        video, other = (side.columns.column("video_id").take(pa.array(at)) for side, at in ((a, i), (b, j)))
        at = np.flatnonzero(pa.compute.equal(video, other).fill_null(False).to_numpy())
        number, its = (side.columns.column("frame_number").cast(pa.float64()).take(pa.array(k[at])).to_numpy() for side, k in ((a, i), (b, j)))
        apart = np.abs(number - its)
        near = apart <= reach
        cos = cos.copy()
        cos[at[near]] *= decay ** (apart[near] / reach)
        return cos

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in packed.EDGES.split(", ")]
        waiting: dict[tuple[int, int], list] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (_, p), parts in sorted(waiting.items()):
                a, b = parts[0][:2]
                first, last = (int(a.starts[k]) for k in (p, p + 1))
                i, j, w = (np.concatenate([x[k] for x in parts]) for k in (2, 3, 4))
                gaps, w = packed.packed(i - first, j, w, b.n)
                values = [*((v, pa.int32()) for v in (a.side, a.n, b.side, b.n, first, last - first)), (gaps, pa.binary()), (w, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names)
            waiting.clear()

        held = 0
        for a, b, i, j, cos, alike in _met(batches, threshold, True):
            w = np.ones(len(i)) if alike is not None else weights(a, b, i, j, cos)
            block = np.searchsorted(a.cuts, i, "right") - 1  # blocks are never empty
            for p in np.unique(block):
                own = block == p
                waiting.setdefault((a.side, int(p)), []).append((a, b, a.vertex[i[own]], b.vertex[j[own]], w[own]))
            held += len(i)
            if held >= HELD:
                yield from rows()
                held = 0
        yield from rows()

    return compare


def _own(vectors: DataFrame, ends: list[str], following: bool) -> DataFrame:
    """What blocks hold of the vectors: id, ord, embedding and what links are to tell of their ends."""
    own = vectors.where(F.col("id").isNotNull() & F.col("ord").isNotNull())
    extra = []
    if following:
        extra = [F.lead(F.col("ord").cast("bigint")).over(Window.partitionBy("video_id").orderBy("frame_number")).alias("next")]
    return own.select(F.col("id").cast("string").alias("id"), F.col("ord").cast("bigint").alias("ord"), vector.doubles(F.col("embedding")).alias("embedding"), *(c for c in ends if c not in ("id", "ord")), *extra)


def _schema(own: DataFrame, ends: list[str]) -> str:
    kinds = dict(own.dtypes)
    return ", ".join([*(f"{p}_{c} {kinds[c]}" for p in "st" for c in ends), "similarity double", "follows boolean"])


def links(vectors: DataFrame, threshold: float, ends: list[str], following: bool = False, block: int = BLOCK, new: Column | None = None, pruned: bool = False) -> DataFrame:
    """All pairs with cosine >= threshold: the columns `ends` of both, as s_... and t_..., `similarity`, and `follows` (false).

    The source comes before the target by `ord`, which tells vectors apart. Every pair has to be compared, within and
    across videos. Vectors are packed into blocks and blocks dealt to sides; each pair of sides meets once, by an equality
    join on the pair, and a pair of blocks is one matrix product; only pairs that pass become rows, with all that is asked
    of their ends, so no join of links with vectors has to follow.

    following: then also each vector and the next of its video (`follows`), in one row with their similarity if they are
    a similar pair; vectors have `video_id` and `frame_number`, and are then ones of which all are compared with all.
    new: which vectors are new; then only pairs with a new one are compared, new x all instead of all x all.
    pruned: blocks are balls of near directions, and only balls that can hold a pair meet.
    """
    if following and new is not None:
        raise ValueError("all vectors meet their next ones only where all are compared")
    if pruned and threshold > 0 and not following:
        return _pruned(vectors, threshold, ends, block)
    added = F.lit(True) if new is None else F.coalesce(new, F.lit(False))
    *sizes, dims = vectors.agg(F.count_if(added), F.count_if(~added), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    n_new, n_old = (-(-n // block) for n in sizes)
    n_new = max(1, n_new)
    salt = F.xxhash64(F.col("id").cast("string"))
    # new blocks come first; they meet all blocks, the others only new ones
    at = F.when(added, F.pmod(salt, F.lit(n_new))).otherwise(n_new + F.pmod(salt, F.lit(max(1, n_old)))).cast("int")
    per = _per_side(n_new + n_old, block, dims)
    first = -(-n_new // per)  # sides of new blocks
    last = F.when(F.col("side") < first, first + -(-n_old // per) - 1).otherwise(first - 1)

    own = _own(vectors.withColumn("b", at), [*ends, "b"], following)
    packs = own.groupBy("b").applyInArrow(_packed, PACKS)
    side = F.when(F.col("b") < n_new, F.floor(F.col("b") / per)).otherwise(first + F.floor((F.col("b") - n_new) / per)).cast("int")
    meet = packs.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "b", "pack")

    return meet.groupBy("x", "y").applyInArrow(_compared(threshold, ends, following), _schema(own, ends))


def packed_edges(vectors: DataFrame, threshold: float = DEFAULTS.edge_similarity, decay: float = DEFAULTS.temporal_decay, reach: int = DEFAULTS.max_temporal_distance, block: int = BLOCK) -> packed.Graph:
    """The graph of `edges` with `ord` as ids, packed where the vectors meet: no edge becomes a row."""
    own = _own(vectors, ["video_id", "frame_number"], True).drop("id")
    size, dims = own.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    n = max(1, -(-size // block))
    per = _per_side(n, block, dims)
    own = own.withColumn("b", F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int"))
    side = F.floor(F.col("b") / per).cast("int")

    def placed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("b", "ascending"), ("ord", "ascending")])
        ids = group.column("ord").to_numpy()
        return pa.table({"side": group.column("side").slice(0, 1), "ids": pa.array([ids[np.diff(ids, prepend=ids[0] - 1) != 0].tobytes()], pa.binary())})

    vertices = own.select(side.alias("side"), "b", "ord").groupBy("side").applyInArrow(placed, "side int, ids binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(-(-n // per) - 1)))
    meet = own.groupBy("b").applyInArrow(_packed, PACKS).withColumn("side", side).withColumn("other", other)
    meet = meet.select(F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "b", "pack")
    return packed.graph_of(meet.groupBy("x", "y").applyInArrow(_packs(threshold, decay, reach), packed.EDGES), vertices)


def _per_side(blocks: int, block: int, dims: int) -> int:
    return max(1, min(-(-blocks // SIDES), SIDE_BYTES // (8 * block * max(1, dims))))


def similar_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK, new: Column | None = None) -> DataFrame:
    """(source, target, similarity) of all pairs with cosine >= threshold, source before target by `ord`; see `links`."""
    return links(vectors, threshold, ["id"], block=block, new=new).select(F.col("s_id").alias("source"), F.col("t_id").alias("target"), "similarity")


def balls(vectors: DataFrame, block: int = BLOCK, ends: list[str] | None = None) -> DataFrame:
    """Blocks of vectors that point the same way, written: what `links` packs, and each block's centre and angle.

    Directions are fitted to a sample; their number and the sample grow by the root of the vectors. A direction with more
    than `block` vectors is several blocks. Vectors that are null or zero are in none.
    """
    own = _own(vectors, ends or [], False).where(F.exists("embedding", lambda x: x != 0))
    n = own.count()
    centres = clusters.fitted(own.select("id", vector.unit(F.col("embedding")).alias("embedding")), max(1, round(math.sqrt(n) / 2)))

    def directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            cell = clusters.assigned(x / np.linalg.norm(x, axis=1, keepdims=True), centres)[0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    placed = written(own.mapInArrow(directed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", cell int"))
    # blocks are numbered by direction and part; a direction is a row here
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    first = {r["cell"]: r for r in parts.orderBy("cell").collect()}
    starts = np.cumsum([0, *(first[c]["parts"] for c in sorted(first))])
    numbers = vectors.sparkSession.createDataFrame([(c, int(starts[k]), first[c]["parts"]) for k, c in enumerate(sorted(first))], "cell int, first int, parts int")
    numbered = placed.join(F.broadcast(numbers), "cell").withColumn("b", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))

    def ball(group: pa.Table) -> pa.Table:
        x = np.array(group.column("embedding").to_pylist(), np.float64).reshape(group.num_rows, -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        centre = x.mean(0)
        length = np.linalg.norm(centre)
        centre = centre / length if length > 0 else x[0]
        angle = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        return _packed(group).append_column("centre", pa.array([centre.tolist()], pa.list_(pa.float64()))).append_column("angle", pa.array([angle]))

    return written(numbered.select(*own.columns, "b").groupBy("b").applyInArrow(ball, f"{PACKS}, centre array<double>, angle double"))


def _may_meet(x: np.ndarray, angle_x: np.ndarray, y: np.ndarray, angle_y: np.ndarray, threshold: float) -> np.ndarray:
    """Which balls of two lists may hold a similar pair: their centres are no further apart than both angles and the threshold's."""
    most = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    return np.arccos(np.clip(x @ y.T, -1, 1)) <= angle_x[:, None] + angle_y[None, :] + most


def meeting_balls(blocks: DataFrame, threshold: float, together: int = BLOCK) -> DataFrame:
    """(x, y) of blocks, x <= y, that may hold a similar pair.

    Centres meet as vectors do, packed, a matrix product for each two packs; a pack stands for about a million vectors.
    """
    n = max(1, -(-blocks.count() // together))
    packs = blocks.select("b", "centre", "angle", F.pmod(F.xxhash64("b"), F.lit(n)).cast("int").alias("p"))
    met = packs.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("p", "o").alias("m"), F.greatest("p", "o").alias("q"), "p", "b", "centre", "angle")

    def near(group: pa.Table) -> pa.Table:
        pack, b, angle = (group.column(c).to_numpy() for c in ("p", "b", "angle"))
        x = np.array(group.column("centre").to_pylist(), np.float64)
        one, two = (np.flatnonzero(pack == group.column(c)[0].as_py()) for c in ("m", "q"))
        i, j = np.nonzero(_may_meet(x[one], angle[one], x[two], angle[two], threshold))
        u, v = b[one][i], b[two][j]
        keep = (u <= v) | (group.column("m")[0].as_py() != group.column("q")[0].as_py())
        return pa.table({"x": pa.array(np.minimum(u, v)[keep], pa.int32()), "y": pa.array(np.maximum(u, v)[keep], pa.int32())})

    return met.groupBy("m", "q").applyInArrow(near, "x int, y int")


def _pruned(vectors: DataFrame, threshold: float, ends: list[str], block: int) -> DataFrame:
    """`links` over balls. Sides meet if any two of their balls may; within a pair of sides, balls are told apart again."""
    blocks = balls(vectors, block, ends)
    n = blocks.count()
    dims = blocks.agg(F.coalesce(F.max(F.size("centre")), F.lit(1))).first()[0]
    side = lambda c: F.floor(F.col(c) / _per_side(n, block, dims)).cast("int")
    pairs = written(meeting_balls(blocks, threshold).select(side("x").alias("x"), side("y").alias("y")).distinct())
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("side"))
    # a row a pair of sides: a few hundred, or as many as sides of their most bytes make
    meet = blocks.withColumn("side", side("b")).join(F.broadcast(sides), "side").select("x", "y", "side", "b", "pack", "centre", "angle")
    return meet.groupBy("x", "y").applyInArrow(_compared(threshold, ends, False), _schema(_own(vectors, ends, False), ends))


def similar_pairs_pruned(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """`similar_pairs`, exact, where blocks are balls of near directions, and only balls that can hold a pair meet.

    It pays where vectors lie in groups and thresholds are high; without structure nearly all balls meet. A threshold of
    0 or less is met by nearly all pairs and left to `similar_pairs`.
    """
    return links(vectors, threshold, ["id"], block=block, pruned=True).select(F.col("s_id").alias("source"), F.col("t_id").alias("target"), "similarity")


def similar_pairs_approximately(vectors: DataFrame, threshold: float, tables: int = 4, width: float = 2.0, seed: int = 5) -> DataFrame:
    """`similar_pairs` by random projections: only vectors that share a bucket in one of `tables` tables are compared.

    Buckets are `width` times as wide as vectors at the threshold are apart. A pair at the threshold shares one with
    probability 0.61 a table at a width of 2, so 97.7 % of such pairs are found with 4 tables, and more of closer ones;
    what is returned is exact. It pays for high thresholds; near 0 almost all vectors share buckets. Zero vectors are in
    no pair. threshold: over 0 and under 1.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, y: a + y * y))
    own = vectors.select(F.col("id").cast("string").alias("id"), F.col("ord").cast("bigint").alias("ord"), vector.doubles(F.col("embedding")).alias("e"))
    own = own.withColumn("length", F.greatest(length, F.lit(1e-300))).where(F.exists("e", lambda x: x != 0))
    own = own.select("id", "ord", array_to_vector(F.transform("e", lambda x: x / F.col("length"))).alias("v"))
    apart = math.sqrt(2 - 2 * threshold)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="buckets", bucketLength=width * apart, numHashTables=tables, seed=seed).fit(own)
    pairs = model.approxSimilarityJoin(own, own, apart + 1e-9, "d").where("datasetA.ord < datasetB.ord")
    found = pairs.select(F.col("datasetA.id").alias("source"), F.col("datasetB.id").alias("target"), (1 - F.col("d") * F.col("d") / 2).alias("similarity"))
    return found.where(F.col("similarity") >= threshold)


def semantic_edges(vectors: DataFrame, threshold: float = DEFAULTS.edge_similarity, decay: float = DEFAULTS.temporal_decay, reach: int = DEFAULTS.max_temporal_distance, distance_unit: str = "frame", new: Column | None = None, pruned: bool = False) -> DataFrame:
    """Edges of similar vectors; the weight decays with the distance between a video's frames.

    new: which vectors are new; then only edges with a new end are made. pruned: by `similar_pairs_pruned`, for all.

    distance_unit: 'frame' counts raw frame numbers, 'ordinal' positions among the video's keyframes.
    """
    if distance_unit == "ordinal":
        vectors = vectors.withColumn("frame_number", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number")))
    elif distance_unit != "frame":
        raise ValueError("distance_unit is 'frame' or 'ordinal'")
    both = links(vectors, threshold, ["id", "video_id", "frame_number"], new=new, pruned=pruned)
    return _weighed(both, decay, reach).select(F.col("s_id").alias("source"), F.col("t_id").alias("target"), "weight", F.lit("semantic").alias("edge_type"), "same_video", "similarity", "temporal_distance")


def _weighed(both: DataFrame, decay: float, reach: int) -> DataFrame:
    """Links with same_video, temporal_distance and the weight of similar ones."""
    both = both.withColumn("same_video", F.col("s_video_id") == F.col("t_video_id"))
    both = both.withColumn("temporal_distance", F.when(F.col("same_video") & F.col("similarity").isNotNull(), F.abs(F.col("s_frame_number") - F.col("t_frame_number")).cast("bigint")))
    return both.withColumn("weight", vector.decayed(F.col("similarity"), F.col("same_video"), F.col("temporal_distance"), decay, reach))


def edges(vectors: DataFrame, threshold: float = DEFAULTS.edge_similarity, decay: float = DEFAULTS.temporal_decay, reach: int = DEFAULTS.max_temporal_distance, key: str = "id", ends: tuple[str, ...] = ()) -> DataFrame:
    """`merged_edges` of `semantic_edges` and `temporal_edges`, made where the vectors meet: no edge is shuffled.

    vectors: id, ord, video_id, frame_number, timestamp, embedding. key: the column that `source` and `target` give.
    ends: columns that edges have from both ends besides, as s_... and t_....
    """
    both = _weighed(links(vectors, threshold, list(dict.fromkeys([key, "video_id", "frame_number", "timestamp", *ends])), following=True), decay, reach)
    next_one = F.col("follows")
    return both.select(
        F.col(f"s_{key}").alias("source"),
        F.col(f"t_{key}").alias("target"),
        F.when(next_one, F.lit(1.0)).otherwise(F.col("weight")).alias("weight"),
        F.when(next_one, F.lit("temporal")).otherwise(F.lit("semantic")).alias("edge_type"),
        F.when(next_one, F.lit(True)).otherwise(F.col("same_video")).alias("same_video"),
        "similarity",
        "temporal_distance",
        F.when(next_one, F.col("t_timestamp") - F.col("s_timestamp")).alias("time_gap"),
        *(f"{p}_{c}" for p in "st" for c in ends),
    )


def temporal_edges(nodes: DataFrame) -> DataFrame:
    """An edge of weight 1 from each keyframe to the next of its video."""
    w = Window.partitionBy("video_id").orderBy("frame_number")
    after = nodes.select(F.col("id").cast("string").alias("source"), F.lead(F.col("id").cast("string")).over(w).alias("target"), (F.lead("timestamp").over(w) - F.col("timestamp")).alias("time_gap"))
    return after.where("target IS NOT NULL").select("source", "target", F.lit(1.0).alias("weight"), F.lit("temporal").alias("edge_type"), F.lit(True).alias("same_video"), "time_gap")


def merged_edges(semantic: DataFrame, temporal: DataFrame) -> DataFrame:
    """One edge a (source, target): temporal attributes win, semantic ones that have no counterpart stay."""
    s, t = semantic.alias("s"), temporal.alias("t")
    both = s.join(t, ["source", "target"], "full")
    first = lambda c: F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c)
    return both.select("source", "target", first("weight"), first("edge_type"), first("same_video"), F.col("s.similarity").alias("similarity"), F.col("s.temporal_distance").alias("temporal_distance"), F.col("t.time_gap").alias("time_gap"))


def all_edges(semantic: DataFrame, temporal: DataFrame) -> DataFrame:
    """Both kinds side by side, before they are merged."""
    return semantic.unionByName(temporal, allowMissingColumns=True)


def context(nodes: DataFrame, window: int = DEFAULTS.context_window) -> DataFrame:
    """(id, neighbour, frame_number): a video's other keyframes within `window` frame numbers, by a range window."""
    w = Window.partitionBy("video_id").orderBy("frame_number").rangeBetween(-window, window)
    near = nodes.select("id", F.collect_list(F.struct("frame_number", "id")).over(w).alias("near"))
    others = F.filter("near", lambda x: x["id"] != F.col("id"))
    return near.select("id", F.explode(others).alias("x")).select("id", F.col("x.id").alias("neighbour"), F.col("x.frame_number").alias("frame_number"))


def subgraph(nodes: DataFrame, edges: DataFrame, video) -> tuple[DataFrame, DataFrame]:
    """One video's nodes, and the edges with both ends among them; empty for an unknown video."""
    own = nodes.where(F.col("video_id") == F.lit(video))
    ids = own.select(F.col("id").cast("string").alias("__id"))
    return own, edges.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")


def drawn_edges(edges: DataFrame, nodes: DataFrame, default_importance: float = 0.5) -> DataFrame:
    """Edges with the coordinates of both ends: time and importance."""
    at = nodes.select(F.col("id").cast("string").alias("id"), "timestamp", F.coalesce("importance", F.lit(default_importance)).alias("importance"))
    return edges.join(at.toDF("source", "x0", "y0"), "source").join(at.toDF("target", "x1", "y1"), "target")


def video_stats(nodes: DataFrame) -> DataFrame:
    """(video_id, keyframe_count, first_id, avg_importance) from distinct nodes."""
    each = nodes.dropDuplicates(["id"])
    return each.groupBy("video_id").agg(F.count("*").alias("keyframe_count"), F.min_by("id", "frame_number").alias("first_id"), F.coalesce(F.avg("importance"), F.lit(0.0)).alias("avg_importance"))


def export(nodes: DataFrame, edges: DataFrame, video=None) -> dict[str, DataFrame]:
    """Node rows, edge rows and statistics of the whole graph or of one video; importance is the whole graph's."""
    stats = video_stats(nodes)
    if video is not None:
        nodes, edges = subgraph(nodes, edges, video)
        stats = stats.where(F.col("video_id") == F.lit(video))
    return {"nodes": nodes, "edges": edges, "stats": stats}


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row: temporal, semantic and within-video semantic edges."""
    semantic = F.col("edge_type") == "semantic"
    return edges.agg(F.count_if(F.col("edge_type") == "temporal").alias("temporal_edges"), F.count_if(semantic).alias("semantic_edges"), F.count_if(semantic & F.col("same_video")).alias("within_video_edges"))
