"""Differences between a video's successive embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector


def differential(vectors: DataFrame) -> DataFrame:
    """Adds `differential` (zeros for a video's first row) and `differential_norm`."""
    w = Window.partitionBy("video_id").orderBy("frame_number")
    before = F.lag("embedding").over(w)
    return vectors.withColumn("differential", vector.difference(F.col("embedding"), before)).withColumn("differential_norm", vector.norm(F.col("differential")))
