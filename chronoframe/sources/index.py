"""A durable index of vectors: nearest neighbours without reading the vectors themselves, but for a few.

Vectors lie in cells around centres. Beside each vector stands a code of one byte a dimension (of its difference from the
centre), with the exact length of what the code leaves out. So every distance is known from the code to within that
length, on either side (a vector-approximation file). A search reads the codes of the cells nearest to the query, which
bounds the k-th distance; then those of the cells that can hold something nearer by their radius; and at last the
vectors of candidates whose lower bound doesn't exceed the k-th upper bound. Results are exact, ties included; only the
bytes read depend on how the vectors lie.

The table has a folder for each append and cell, sorted by id, so that codes, which are columns of their own, are read
without the vectors, and a candidate's vector costs a page. An append counts from the moment that its row of totals is
there; one that failed before leaves files that nothing reads.

The number of cells is about the root of the rows at creation, and the sample that centres are fitted to has
`clusters.PER_CENTRE` rows for each: both grow by the root of the table. An index that has grown a lot is best created anew.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clusters, vector

#: Queries that meet a code at once, and candidates up to which their ids are sent with the plan; more are joined.
MOST_QUERIES, MOST_IDS = 1_000, 5_000
#: Distances are compared with this much room for rounding.
ROOM = 1e-9


class VectorIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        #: Of the last search: cells there are, cells read, candidates.
        self.last: dict[str, int] = {}
        self._centres: np.ndarray | None = None

    def create(self, rows: DataFrame) -> VectorIndex:
        """Fits centres to `rows` (id, embedding) and indexes them."""
        own = rows.select("id", "embedding").where("embedding IS NOT NULL")
        n, dims = own.agg(F.count("*"), F.mode(F.size("embedding"))).first()
        cells = max(1, round(math.sqrt(n) / 2))
        centres = clusters.fitted(own.where(F.size("embedding") == dims), cells) if n else np.zeros((1, dims or 1))
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        kind = rows.schema["embedding"].dataType.simpleString()
        self.spark.createDataFrame([], f"id string, embedding {kind}").write.parquet(f"{self.path}/kind")
        self.append(rows)
        return self

    def centres(self) -> np.ndarray:
        if self._centres is None:
            found = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
            self._centres = np.array([r["centre"] for r in found])
        return self._centres

    def _schema(self) -> str:
        kind = self.spark.read.parquet(f"{self.path}/kind").schema["embedding"].dataType.simpleString()
        return f"id string, code binary, scale double, error double, away double, embedding {kind}"

    def append(self, rows: DataFrame) -> None:
        """Indexes more rows. Their ids must be new; vectors that are null, of other lengths or not finite are left out."""
        centres, schema = self.centres(), self._schema()
        dims = centres.shape[1]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, x = clusters.matrix(batch.column(1), dims)
                own, away = clusters.assigned(x, centres)
                rest = x - centres[own]
                scale = np.maximum(np.abs(rest).max(1, initial=0.0) / 127, 1e-300)
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                error = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(1))
                kept = batch.take(pa.array(good))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([kept.column(0), codes, pa.array(scale), pa.array(error), pa.array(away), kept.column(1), pa.array(own.astype(np.int32))], names)

        names = ["id", "code", "scale", "error", "away", "embedding", "cell"]
        kind = schema.rsplit("embedding ", 1)[1]
        coded = rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast(kind).alias("embedding")).mapInArrow(encode, f"{schema}, cell int")
        batch = f"b{uuid.uuid4().hex}"
        # a cell that holds much of an append is split over tasks
        spread = coded.hint("rebalance", "cell").sortWithinPartitions("cell", "id")
        spread.write.option("parquet.page.row.count.limit", "64").option("parquet.block.size", str(8 << 20)).partitionBy("cell").parquet(f"{self.path}/vectors/batch={batch}")
        done = self.spark.read.schema(f"{schema}, cell int").parquet(f"{self.path}/vectors/batch={batch}")
        done = done.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("batch", F.lit(batch))
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/appends")

    def totals(self) -> DataFrame:
        """(cell, n, radius, batch) of each append."""
        return self.spark.read.schema("cell int, n bigint, radius double, batch string").parquet(f"{self.path}/appends")

    def _rows(self, batches: list[str], cells: list[int]) -> DataFrame:
        every = self.spark.read.schema(f"{self._schema()}, batch string, cell int").option("basePath", f"{self.path}/vectors").parquet(*(f"{self.path}/vectors/batch={b}" for b in batches))
        return every.where(F.col("cell").isin(cells))

    def _candidates(self, rows: DataFrame, queries: np.ndarray, k: int, asked: dict[int, np.ndarray]) -> DataFrame:
        """(q, id, batch, cell, lower, upper) from codes; a task drops what its own k-th upper bound rules out. asked: queries by cell."""
        centres = self.centres()

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((len(queries), k), np.inf)  # the k smallest upper bounds so far
            for batch in batches:
                cell = batch.column(5).to_numpy()
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
                scale, error = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                out = []
                for c in np.unique(cell).tolist():
                    at, who = np.flatnonzero(cell == c), asked[c]
                    near = centres[c] + code[at] * scale[at, None]
                    for lo in range(0, len(at), 2048):
                        part = at[lo : lo + 2048]
                        x = near[lo : lo + 2048]
                        gap = np.sqrt(np.stack([((x - queries[q]) ** 2).sum(1) for q in who]))
                        lower, upper = np.maximum(gap - error[part], 0) - ROOM, gap + error[part] + ROOM
                        best[who] = np.sort(np.concatenate([best[who], upper], 1), 1)[:, :k]
                        i, j = np.nonzero(lower <= best[who, -1:])
                        out.append((who[i], part[j], lower[i, j], upper[i, j]))
                q, row, lower, upper = (np.concatenate(x) for x in zip(*out, strict=True))
                stay = lower <= best[q, -1]
                row = pa.array(row[stay])
                yield pa.RecordBatch.from_arrays([pa.array(q[stay].astype(np.int32)), batch.column(0).take(row), batch.column(4).take(row), batch.column(5).take(row), pa.array(lower[stay]), pa.array(upper[stay])], ["q", "id", "batch", "cell", "lower", "upper"])

        return rows.select("id", "code", "scale", "error", "batch", "cell").mapInArrow(bounds, "q int, id string, batch string, cell int, lower double, upper double")

    @staticmethod
    def _kth(found: DataFrame, k: int) -> DataFrame:
        """(q, most) the k-th smallest upper bound of each query; the limit is applied before rows are shuffled."""
        first = found.select("q", "upper").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("upper"))).where(F.col("r") <= k)
        return first.groupBy("q").agg(F.when(F.count("*") == k, F.max("upper")).otherwise(float("inf")).alias("most"))

    def nearest_each(self, queries: list[list[float]], k: int) -> DataFrame:
        """(q, id, distance): the k nearest rows of each query by squared distance, ties by id; q numbers the queries."""
        if len(queries) > MOST_QUERIES:  # a task holds k bounds of each query
            parts = [self.nearest_each(queries[i : i + MOST_QUERIES], k).withColumn("q", F.col("q") + i) for i in range(0, len(queries), MOST_QUERIES)]
            return reduce(DataFrame.unionByName, parts)
        totals = self.totals().collect()
        batches = sorted({r["batch"] for r in totals})
        radius: dict[int, float] = {}
        size: dict[int, int] = {}
        for r in totals:
            radius[r["cell"]], size[r["cell"]] = max(radius.get(r["cell"], 0.0), r["radius"]), size.get(r["cell"], 0) + r["n"]
        kind = "q int, id string, distance double"
        if not totals or not queries:
            self.last = {"cells": len(radius), "cells_read": 0, "candidates": 0}
            return self.spark.createDataFrame([], kind)
        x, cells = np.array(queries, np.float64), np.array(sorted(radius))
        away = np.sqrt(((x[:, None, :] - self.centres()[cells][None]) ** 2).sum(2))
        least = np.maximum(away - np.array([radius[c] for c in cells.tolist()]), 0) - ROOM
        order, n = np.argsort(away, 1), np.array([size[c] for c in cells.tolist()])
        # the nearest cells with 4 k rows bound the k-th distance
        until = (np.cumsum(n[order], 1) < 4 * k).sum(1)
        first = [order[i, : until[i] + 1] for i in range(len(x))]
        asked = self._by_cell(cells, first)
        most = np.full(len(x), np.inf)
        for r in self._kth(self._candidates(self._rows(batches, sorted(asked)), x, k, asked), k).collect():
            most[r["q"]] = r["most"]
        asked = self._by_cell(cells, [np.flatnonzero(least[i] <= most[i]) for i in range(len(x))])
        found = self._candidates(self._rows(batches, sorted(asked)), x, k, asked)
        limits = self._kth(found, k)
        left = found.join(F.broadcast(limits), "q").where(F.col("lower") <= F.col("most")).select("q", "id", "batch", "cell")
        few = left.limit(MOST_IDS + 1).collect()
        self.last = {"cells": len(cells), "cells_read": len(asked), "candidates": len(few)}
        if len(few) <= MOST_IDS:
            rows = self._rows(sorted({r["batch"] for r in few}), sorted({r["cell"] for r in few})).where(F.col("id").isin(sorted({r["id"] for r in few})))
            left = F.broadcast(self.spark.createDataFrame([(r["q"], r["id"], r["batch"], r["cell"]) for r in few], "q int, id string, batch string, cell int"))
        else:
            rows = self._rows(batches, sorted(asked))
        vectors = self.spark.createDataFrame(list(enumerate(x.tolist())), "q int, query array<double>")
        both = rows.select("id", "batch", "cell", "embedding").join(left, ["id", "batch", "cell"]).join(F.broadcast(vectors), "q")
        ranked = both.select("q", "id", vector.squared_distance(vector.doubles(F.col("embedding")), F.col("query")).alias("distance"))
        return ranked.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("r") <= k).drop("r")

    @staticmethod
    def _by_cell(cells: np.ndarray, chosen: list[np.ndarray]) -> dict[int, np.ndarray]:
        asked: dict[int, list[int]] = {}
        for q, places in enumerate(chosen):
            for c in cells[places].tolist():
                asked.setdefault(c, []).append(q)
        return {c: np.array(q) for c, q in asked.items()}

    def nearest(self, query: list[float], k: int) -> DataFrame:
        """(id, distance) of the k nearest rows; ties by id."""
        return self.nearest_each([query], k).drop("q").orderBy("distance", "id")
