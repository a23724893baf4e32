"""Similarity search over keyframe vectors, rescored by importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import vector
from .graph import context

METRICS = ("l2sq", "cosine")


def distance(embedding: Column, query: list[float], metric: str = "l2sq") -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    if metric == "l2sq":
        return vector.squared_distance(embedding, q)
    if metric == "cosine":
        return 1 - vector.cosine(embedding, q)
    raise ValueError(f"metric is one of {METRICS}")


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "l2sq") -> DataFrame:
    """The k nearest rows with their `distance`; ties by id."""
    return vectors.withColumn("distance", distance(vector.doubles(F.col("embedding")), query, metric)).orderBy("distance", "id").limit(k)


def rescored(hits: DataFrame, importance: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds similarity, importance (a default where it is unknown) and the hybrid score."""
    known = importance.select(F.col("id").alias("__id"), F.col("importance").alias("__importance"))
    both = hits.join(known, F.col("id") == F.col("__id"), "left").drop("__id")
    both = both.withColumn("similarity", 1 - F.col("distance")).withColumn("importance", F.coalesce("__importance", F.lit(settings.default_importance))).drop("__importance")
    return both.withColumn("score", settings.similarity_weight * F.col("similarity") + settings.importance_weight * F.col("importance"))


def with_chunk(hits: DataFrame, buffer: float = DEFAULTS.chunk_buffer) -> DataFrame:
    """Adds clip bounds around `timestamp`; the start isn't below 0, the end isn't cut to the video's."""
    start, end = F.greatest(F.lit(0.0), F.col("timestamp") - buffer), F.col("timestamp") + buffer
    return hits.withColumn("chunk_start", start).withColumn("chunk_end", end).withColumn("chunk_duration", end - start)


def search(vectors: DataFrame, nodes: DataFrame, query: list[float], k: int = 5, metric: str = "l2sq", include_context: bool = False, settings: Settings = DEFAULTS) -> DataFrame:
    """The k best of over_fetch * k nearest vectors by hybrid score; 1 <= k <= 10."""
    if not 1 <= k <= 10:
        raise ValueError("k is from 1 to 10")
    hits = with_chunk(rescored(nearest(vectors, query, settings.over_fetch * k, metric), nodes, settings), settings.chunk_buffer)
    best = hits.orderBy(F.desc("score"), "distance", "id").limit(k)
    if not include_context:
        return best
    around = context(nodes, settings.retrieval_context_window).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_number", "neighbour"))), lambda x: x["neighbour"]).alias("context_nodes"))
    empty = F.array().cast("array<string>")
    return best.join(around, "id", "left").withColumn("context_nodes", F.coalesce("context_nodes", empty))
