"""Weighted PageRank of a directed graph.

r' = d * (sum of r(u) * w(u, v) / W(u) + D / N) + (1 - d) / N, with D the ranks of vertices without outgoing weight.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Edges and vertices up to which one task iterates in memory (about 100 MB of ids); a larger graph iterates as tables.
SMALL = 200_000
#: Vertices up to which a round's ranks go to all edges (about 40 bytes each); beyond, edges are shuffled every round.
FEW = 2_000_000


def written(df: DataFrame) -> DataFrame:
    """`df` written to the folder that the cluster names for checkpoints, to cut its lineage."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "tables", spark.sparkContext.applicationId, f"ranks-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def iterate(source: np.ndarray, target: np.ndarray, weight: np.ndarray, n: int, damping: float, rounds: int, tolerance: float | None, start: np.ndarray | None = None, took: list[int] | None = None) -> np.ndarray:
    """Ranks of vertices 0..n-1; stops early once the change is under n * tolerance, and raises if it never is.

    start: ranks to begin with instead of even ones; took: gets the number of rounds.
    """
    out = np.bincount(source, weight, n)
    share = weight / np.where(out[source] == 0, 1, out[source])
    hanging = out == 0
    rank = np.full(n, 1 / n) if start is None else start
    for k in range(rounds):
        new = damping * (np.bincount(target, rank[source] * share, n) + rank[hanging].sum() / n) + (1 - damping) / n
        done = tolerance is not None and np.abs(new - rank).sum() < n * tolerance
        rank = new
        if took is not None:
            took[:] = [k + 1]
        if done:
            return rank
    if tolerance is not None:
        raise ArithmeticError(f"no convergence in {rounds} rounds")
    return rank


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, small: int = SMALL, start: DataFrame | None = None, took: list[int] | None = None, ready: bool = False) -> DataFrame:
    """(id, importance). tolerance: None runs exactly `rounds` rounds. Ids are strings, or numbers where nodes and edges have numbers.

    start: (id, importance) of an earlier run. Where a graph has grown by a little, most ranks are nearly right already and
    fewer rounds are left; what they settle to doesn't depend on where they begin. Vertices that it lacks begin evenly.
    took: gets the number of rounds of a graph that iterates as tables. ready: the edges are a written table, of which no
    other copy is needed.
    """
    kind = "bigint" if (dict(nodes.dtypes)["id"], dict(edges.dtypes)["source"]) == ("bigint", "bigint") else "string"
    ids = nodes.select(F.col("id").cast(kind).alias("id")).distinct()
    links = edges.select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target"), F.col("weight").cast("double").alias("weight"))
    if not ready:
        links = written(links)  # making edges may be costly; they are counted first and read again
    size = ids.count()
    if size == 0:
        return ids.select("id", F.lit(0.0).alias("importance"))
    begun = None
    if start is not None:
        known = start.select(F.col("id").cast(kind).alias("id"), F.col("importance").cast("double").alias("known")).dropDuplicates(["id"])
        had = known.count()
        begun = ids.join(known, "id", "left").select("id", F.coalesce(F.col("known") * (had / size), F.lit(1.0 / size)).alias("begun"))
    if size <= small and links.limit(small + 1).count() <= small:
        first = ids.withColumn("begun", F.lit(1.0 / size)) if begun is None else begun
        rows = first.select("id", F.col("id").alias("target"), F.col("begun").alias("weight"), F.lit(True).alias("vertex")).unionByName(links.withColumnRenamed("source", "id").withColumn("vertex", F.lit(False)))
        as_ = np.int64 if kind == "bigint" else object

        def f(group: pd.DataFrame) -> pd.DataFrame:
            vertices = group[group["vertex"]].sort_values("id")
            own, first = vertices["id"].to_numpy(as_), vertices["weight"].to_numpy(float)
            edge = group[~group["vertex"]].sort_values(["id", "target"])
            s, t = np.searchsorted(own, edge["id"].to_numpy(as_)), np.searchsorted(own, edge["target"].to_numpy(as_))
            return pd.DataFrame({"id": own, "importance": iterate(s, t, edge["weight"].to_numpy(float), len(own), damping, rounds, tolerance, first)})

        return rows.withColumn("whole", F.lit(1)).groupBy("whole").applyInPandas(f, f"id {kind}, importance double")
    return _iterated(ids, links, size, damping, rounds, tolerance, begun, took)


def _iterated(ids: DataFrame, links: DataFrame, n: int, damping: float, rounds: int, tolerance: float | None, begun: DataFrame | None = None, took: list[int] | None = None) -> DataFrame:
    """The same recurrence as joins and sums; each round's ranks are written before the next reads them.

    A vertex sends its rank by weight. What a unit of weight gets is known for each vertex, so edges stay as they were
    written and meet these numbers where they lie: a round shuffles sums by target, not edges.
    """
    out = written(links.groupBy("source").agg(F.sum("weight").alias("out")).where("out > 0"))
    rank = written(ids.select("id", F.lit(1.0 / n).alias("r")) if begun is None else begun.withColumnRenamed("begun", "r"))
    for k in range(rounds):
        sent = rank.join(out.withColumnRenamed("source", "id"), "id", "left")
        hanging = sent.where("out IS NULL").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        unit = sent.where("out IS NOT NULL").select(F.col("id").alias("source"), (F.col("r") / F.col("out")).alias("unit"))
        got = links.join(F.broadcast(unit) if n <= FEW else unit, "source").groupBy("target").agg(F.sum(F.col("weight") * F.col("unit")).alias("got"))
        new = rank.join(got.withColumnRenamed("target", "id"), "id", "left").select("id", (damping * (F.coalesce("got", F.lit(0.0)) + hanging / n) + (1 - damping) / n).alias("new"), "r")
        new = written(new)
        rank = new.select("id", F.col("new").alias("r"))
        if took is not None:
            took[:] = [k + 1]
        if tolerance is not None and new.agg(F.sum(F.abs(F.col("new") - F.col("r")))).first()[0] < n * tolerance:
            break
    else:
        if tolerance is not None:
            raise ArithmeticError(f"no convergence in {rounds} rounds")
    return rank.select("id", F.col("r").alias("importance"))
