"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are halved; each half has its own codebook, and pairs of codewords are the cells of a product grid
(Babenko and Lempitsky, 2012). A vector visits cells in the order of their distance from it, by the multi-sequence
traversal, until the target recall is reached: a cell's distance is that to the hyperplanes beyond which its vectors
lie, and a link at the threshold, in a random direction, crosses hyperplanes farther than `deviations` standard
deviations of its own length so seldom that what remains unvisited falls under 1 - recall. Every vector of a visited
cell is verified in double precision. A pair is a link if either side's visit finds it.

Each label has the grid that its own size asks for, of 1, 2, 4, ... codewords a half, so cells hold about `CELL` vectors
whatever other labels hold. Codebooks are fitted to 16 vectors a codeword, 8,192 at least and `sample` at most; the
largest grid has a 16th of `sample` codewords a half (4,096, so that cells grow only from 8.6 billion vectors a label
on). Equal vectors of a label are one point with a weight. Large cells are verified block against block, and a block
returns counts and a forest of links, never all pairs.

Defined results: vectors that are null, zero, not finite somewhere, or shorter than the longest, and those with a null
label, have no links and stay; ids must be unique; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drawn, map_batches, written
from .vectors import matrix, taking_part, unit

#: Vectors in a cell on average, in a block of members, and in a block of visitors.
CELL, MEMBERS, VISITORS = 512, 2_048, 4_096


def codebook(rows: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k centres by Lloyd's rounds; fewer where there are fewer rows."""
    rng = np.random.default_rng(seed)
    centres = rows[np.sort(rng.permutation(len(rows))[:k])].copy()
    for _ in range(rounds if k > 1 else 1):
        own = np.concatenate([(np.square(centres).sum(1) - 2 * rows[a : a + 4_096] @ centres.T).argmin(axis=1) for a in range(0, len(rows), 4_096)])
        order = np.argsort(own, kind="stable")
        some, first, n = np.unique(own[order], return_index=True, return_counts=True)
        centres[some] = np.add.reduceat(rows[order], first, axis=0) / n[:, None]
    return centres


def cell_distances(rows: np.ndarray, centres: np.ndarray, against: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword, and squared distance to the farthest hyperplane that parts a row from each codeword's region.

    Hyperplanes between a codeword and the `against` nearest ones count; others hardly ever lie farther.
    """
    d = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)
    apart = np.sqrt(np.maximum((centres**2).sum(1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(1), 1e-12))
    best, every = np.zeros_like(d), np.arange(len(rows))
    near = np.argpartition(d, min(against, d.shape[1]) - 1, axis=1)[:, :against] if len(rows) else np.zeros((0, 1), np.int64)
    for j in range(near.shape[1]):
        np.maximum(best, (d - d[every, near[:, j]][:, None]) / (2 * apart[near[:, j]]), out=best)
    return d.argmin(axis=1), best**2


def multi_sequence(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by rising first[i] + second[j], up to `most`; the frontier moves along both sorted sequences."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[one[0]] + second[two[0]], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        yield int(one[i]), int(two[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(one) and y < len(two) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[one[x]] + second[two[y]], x, y))


def _forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the boolean matrix joins: all if few, else each vertex's to the smallest id it reaches."""
    i, j = np.nonzero(links)
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    top_a, top_b = a.copy(), b.copy()
    most = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(top_a, np.where(links, top_b, most).min(axis=1))
        new_b = np.minimum(top_b, np.where(links, new_a[:, None], most).min(axis=0))
        if (new_a == top_a).all() and (new_b == top_b).all():
            return np.concatenate([a, b]), np.concatenate([top_a, top_b])
        top_a, top_b = new_a, new_b


def near_duplicates(
    df: DataFrame, threshold: float = 0.93, deviations: float = 3.5, sample: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; only rows with equal labels are compared."""
    part = taking_part(df.where(F.col(label_col).isNotNull()), id_col, vector_col, F.col(label_col).alias("label"))
    points = written(part.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "points")
    grids = written(points.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")), "grids")
    total, most_of_one, dims = grids.agg(F.sum("n"), F.max("n"), F.max("dims")).first()
    every = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    # codewords a half are 2**level; vectors of one dimension have no halves and link by sign, in one cell
    top = max(0, round(math.log2(max(1.0, (most_of_one or 0) / cell)) / 2)) if (dims or 0) > 1 else 0
    top = min(top, int(math.log2(max(1, sample // 16))))
    level = F.least(F.lit(top), F.greatest(F.lit(0), F.round(F.log2(F.col("n") / cell) / 2))).cast("int")
    half = max(1, (dims or 2) // 2)
    some = drawn(points, "id", min(sample, max(8_192, 16 << top)), total or 0).select("v").toPandas()["v"]  # `sample` rows at most
    rows = unit(np.array(some.tolist(), np.float64)) if len(some) else np.ones((1, 2))
    books = [(codebook(rows[:, :half], 1 << t), codebook(rows[:, half:], 1 << t) if (dims or 2) > 1 else np.zeros((1, 0))) for t in range(top + 1)]
    most = 2 * (1 - threshold) / (dims or 2) * deviations**2
    kind = points.schema["label"].dataType.simpleString()

    def traverse(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, own = unit(matrix(batch.column(1))), batch.column(4).to_numpy()
        cells, visits = np.zeros(len(v), np.int64), [[0]] * len(v)
        for t in np.unique(own):
            at, (one, two) = np.flatnonzero(own == t), books[t]
            (c1, d1), (c2, d2) = cell_distances(v[at, :half], one), cell_distances(v[at, half:], two)
            cells[at] = c1 * len(two) + c2
            for i, x, y in zip(at.tolist(), d1, d2, strict=True):
                visits[i] = [a * len(two) + b for a, b in multi_sequence(x, y, most)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cells), pa.array(visits, pa.list_(pa.int64()))], [*batch.schema.names[:4], "cell", "visits"])

    leveled = points.join(grids.select("label", level.alias("level")), "label").select("label", "v", "id", "n", "level")
    placed = written(map_batches(leveled, traverse, f"label {kind}, v {points.schema['v'].dataType.simpleString()}, id bigint, n bigint, cell bigint, visits array<bigint>"), "placed")
    visitors = placed.select("label", F.explode("visits").alias("at"), "id", "n", "v", "cell", F.lit(None).cast("array<bigint>").alias("visits"))
    members = placed.select("label", F.col("cell").alias("at"), "id", "n", "v", "cell", "visits")
    sizes = members.groupBy("label", "at").agg(F.ceil(F.count("*") / MEMBERS).alias("xs")).join(visitors.groupBy("label", "at").agg(F.ceil(F.count("*") / VISITORS).alias("ys")), ["label", "at"])
    sizes = written(sizes, "sizes")  # a plain side, so that AQE can split a hot cell on the other one
    salt = F.xxhash64("id")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    sides = members.join(sizes, ["label", "at"]).withColumn("x", F.pmod(salt, "xs")).withColumn("y", upto("ys")).withColumn("member", F.lit(True))
    sides = sides.unionByName(visitors.join(sizes, ["label", "at"]).withColumn("y", F.pmod(salt, "ys")).withColumn("x", upto("xs")).withColumn("member", F.lit(False)))

    def verify(group: pa.Table) -> pa.Table:
        member = group.column("member").to_numpy()
        ids, n, cell = (group.column(c).to_numpy() for c in ("id", "n", "cell"))
        v = unit(matrix(group.column("v")))
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        links = v[q] @ v[m].T >= threshold
        links &= ids[q][:, None] != ids[m][None, :]
        found_q = links @ n[m]
        # links that the member's own visit to the visitor's cell doesn't find
        cells, of = np.unique(cell[q], return_inverse=True)
        lists = group.column("visits").combine_chunks().take(pa.array(m))
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(m)), lists.value_lengths().fill_null(0).to_numpy())
        place = np.minimum(np.searchsorted(cells, flat), max(len(cells) - 1, 0))
        hit = cells[place] == flat if len(cells) else np.zeros(len(flat), bool)
        seen = np.zeros((len(cells), len(m)), bool)
        seen[place[hit], owner[hit]] = True
        found_m = n[q] @ (links & ~seen[of])
        a, b = _forest(links, ids[q], ids[m])
        keep = a != b
        some_q, some_m = found_q > 0, found_m > 0
        return pa.table({
            "id": np.concatenate([ids[q][some_q], ids[m][some_m], a[keep]]),
            "links": np.concatenate([found_q[some_q], found_m[some_m], np.zeros(keep.sum(), np.int64)]).astype(np.int64),
            "b": pa.array(np.concatenate([np.full(some_q.sum() + some_m.sum(), -1), b[keep]]).astype(np.int64), mask=np.concatenate([np.ones(some_q.sum() + some_m.sum(), bool), np.zeros(keep.sum(), bool)])),
        })

    keys = ["label", "at", "x", "y"]
    found = written(sides.select(*keys, "id", "n", "v", "cell", "visits", "member").groupBy(*keys).applyInArrow(verify, "id bigint, links bigint, b bigint"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.where("b IS NOT NULL").select(F.col("id").alias("a"), "b")).toDF("id", "component")
    each = points.join(counts, "id", "left").join(classes, "id", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = every.join(each, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
