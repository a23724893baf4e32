"""The two whole flows: frames to a searchable store and graph, and a question to ranked moments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import providers
from ..config import DEFAULTS, Settings
from ..functions.text import frame_file, video_id
from ..operators import annotate, audio, embed, gate, graph, pagerank, report, retrieve
from ..sources.index import VectorIndex
from ..sources.store import SessionReports, VectorStore, vector_records


def records(frames: DataFrame, segments: DataFrame, embedder: providers.Embed, describe: Callable[[bytes], str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Keyframe records with audio, description, prompt, embedding and differential.

    frames: video_id, frame_number, timestamp, extracted_text, thumb or pixel_pct, and `content` (a model's answer) or,
    with `describe`, `data` (the image that it is asked about).
    """
    answer = "data" if describe else "content"
    keys = gate.keyframes(gate.gate(frames, settings)).join(frames.select("video_id", "frame_number", "extracted_text", answer), ["video_id", "frame_number"])
    keys = audio.with_audio(keys, segments, settings.audio_half_window)
    if describe:
        keys = providers.described(keys, describe)
    keys = annotate.prompted(annotate.annotated(keys), settings)
    keys = keys.withColumn("frame_path", frame_file(F.col("video_id"), F.col("timestamp")))
    keys = annotate.records(providers.embedded(keys, embedder))
    return embed.differential(keys.withColumn("embedding", F.col("embedding").cast("array<double>")))


def ingest(frames: DataFrame, segments: DataFrame, store: VectorStore, embedder: providers.Embed, describe: Callable[[bytes], str] | None = None, settings: Settings = DEFAULTS) -> int:
    """Takes videos into the store; ones that are there already add nothing. Returns the number of new keyframes."""
    return store.append(vector_records(records(frames, segments, embedder, describe, settings), settings.compat_audio))


def _placed(store: VectorStore) -> DataFrame:
    """What a graph needs of the store's rows; order is by video and frame."""
    rows = store.scan(None, "id", "video_id", "frame_number", "timestamp", "embedding", "scene_change_score")
    first = rows.groupBy("video_id").agg(F.count("*").alias("n"))
    # places of videos one after another: a row a video, so one task orders them
    base = first.select("video_id", F.coalesce(F.sum("n").over(Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number"))
    return rows.withColumn("own", own).join(base, "video_id").withColumn("ord", F.col("base") + F.col("own")).drop("own", "base")


def _ranked(rows: DataFrame, semantic: DataFrame, settings: Settings, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    nodes, edges = rows.drop("embedding"), pagerank.written(graph.merged_edges(semantic, graph.temporal_edges(rows)))
    return nodes.join(pagerank.pagerank(nodes, edges, settings.damping, start=start), "id"), edges


def built_graph(store: VectorStore, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Nodes with importance, and edges, of everything in the store."""
    rows = _placed(store)
    return _ranked(rows, graph.semantic_edges(rows, settings.edge_similarity, settings.temporal_decay, settings.max_temporal_distance), settings)


def extended_graph(store: VectorStore, known: DataFrame, semantic: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and semantic edges once the store has grown: only new vectors are compared, with all others.

    known: ids that the graph had before, with `importance` if ranks are to go on from there; semantic: its semantic edges (`graph.semantic_edges`, unmerged).
    """
    rows = _placed(store)
    had = known.select(F.col("id").alias("__id"), F.lit(True).alias("__had")).distinct()
    flagged = rows.join(had, F.col("id") == F.col("__id"), "left").drop("__id")
    fresh = graph.semantic_edges(flagged, settings.edge_similarity, settings.temporal_decay, settings.max_temporal_distance, new=F.col("__had").isNull())
    semantic = pagerank.written(semantic.unionByName(fresh))
    return *_ranked(rows, semantic, settings, known if "importance" in known.columns else None), semantic


def ask(store: VectorStore, nodes: DataFrame, question: str, embedder: providers.Embed, k: int = 5, settings: Settings = DEFAULTS, index: VectorIndex | None = None) -> DataFrame:
    """The k best moments for a question, with context; none if the question can't be embedded.

    With an index of the store's vectors only the rows that it finds are read, else all.
    """
    vectors = store.scan()
    try:
        query = [float(x) for x in embedder([question])[0]]
    except Exception:  # a provider's failure is an empty result
        query, vectors = [0.0] * embedder.dims, vectors.where("false")
    else:
        if index is not None:
            near = [r["id"] for r in index.nearest(query, settings.over_fetch * k).collect()]
            vectors = vectors.where(F.col("id").isin(near) & F.col("video_id").isin(sorted({i.rpartition("_")[0] for i in near})))
    return retrieve.search(vectors, nodes, query, k, include_context=True, settings=settings)


def video_report(keyframes: DataFrame, semantic: DataFrame, compat: bool = False) -> DataFrame:
    """One row a video: keyframes, how they were found, and frames with people, text and actions."""
    found = report.detection_summary(keyframes, "video_id", compat=compat).select("video_id", "keyframes", F.col("text_count").alias("text_based_count"), F.col("visual_count").alias("visual_based_count"))
    return found.join(report.semantic_counts(semantic, "video_id"), "video_id", "left")


def reported(reports: SessionReports, keyframes: DataFrame, semantic: DataFrame, videos: DataFrame, compat: bool = False) -> int:
    """Appends the reports of processed videos to the session's; videos: video_id, video_name. Returns how many."""
    named = video_report(keyframes, semantic, compat).join(videos.select("video_id", F.col("video_name").alias("name")), "video_id")
    return reports.append(named)


def choices(videos: DataFrame) -> DataFrame:
    """(label, video_id): all videos first (null), then each by name."""
    every = videos.sparkSession.sql("SELECT 'All videos' AS label, CAST(NULL AS STRING) AS video_id")
    return every.unionByName(videos.select(F.col("video_name").alias("label"), video_id(F.col("video_name")).alias("video_id")).distinct())
