"""The whole flows, from frames to ranked moments."""

import os
import types
import urllib.parse

import pytest
from pyspark.sql import functions as F

from chronoframe import providers
from chronoframe.functions import responses
from chronoframe.operators import graph, pagerank
from chronoframe.plans import timeline
from chronoframe.session import drop_tables, shared_folder
from chronoframe.sources.store import SessionReports, VectorStore

from .test_operators import random_frames


def test_ingest_and_ask(spark, tmp_path):
    frames = spark.createDataFrame(random_frames(5), "video_id string, frame_number bigint, timestamp double, extracted_text string, pixel_pct double")
    frames = frames.withColumn("content", F.concat(F.lit('{"main_subject": "'), "extracted_text", F.lit('", "extracted_text": "'), "extracted_text", F.lit('"}')))
    segments = spark.createDataFrame([("v0", 0.0, 3.0, "hello there")], "video_id string, start double, end double, text string")
    store, embedder = VectorStore(spark, str(tmp_path / "vectors")), providers.HashEmbedder(32)
    n = timeline.ingest(frames, segments, store, embedder)
    assert n == store.scan().count() > 8 and timeline.ingest(frames, segments, store, embedder) == 0
    assert "hello there" in store.scan("v0").orderBy("frame_number").first().document
    nodes, edges = timeline.built_graph(store)
    assert abs(nodes.agg(F.sum("importance")).first()[0] - 1) < 1e-6
    assert edges.where("edge_type = 'temporal'").count() == n - 4
    assert edges.groupBy("source", "target").count().where("count > 1").count() == 0
    hits = timeline.ask(store, nodes, "agenda item one", embedder, 3).collect()
    assert len(hits) == 3 and any("agenda" in r.document for r in hits)

    class Down:
        dims = 32

        def __call__(self, texts):
            raise RuntimeError("down")

    assert timeline.ask(store, nodes, "x", Down()).count() == 0


def test_an_extended_graph_is_the_built_one(spark, tmp_path):
    frames = spark.createDataFrame(random_frames(6), "video_id string, frame_number bigint, timestamp double, extracted_text string, pixel_pct double")
    frames = frames.withColumn("content", F.concat(F.lit('{"main_subject": "'), "extracted_text", F.lit('"}')))
    segments = spark.createDataFrame([], "video_id string, start double, end double, text string")
    store, embedder = VectorStore(spark, str(tmp_path / "vectors")), providers.HashEmbedder(32)
    known, semantic, seen = spark.createDataFrame([], "id string"), None, 0
    for video in ("v2", "v0", "v3"):  # arrivals don't follow the order of videos
        assert timeline.ingest(frames.where(F.col("video_id") == video), segments, store, embedder) > 0
        if semantic is None:
            semantic = graph.semantic_edges(timeline._placed(store).where("false"))
        nodes, edges, semantic = timeline.extended_graph(store, known, semantic)
        known = store.scan(None, "id")
        want_nodes, want_edges = timeline.built_graph(store)
        key = lambda rows: sorted(tuple(r) for r in rows)
        got, want = (key(e.select("source", "target", "edge_type", F.round("weight", 9)).collect()) for e in (edges, want_edges))
        assert got == want and len(got) > seen
        seen = len(got)
        got, want = (key(n.select("id", F.round("importance", 6)).collect()) for n in (nodes, want_nodes))
        assert got == want


def test_session_reports(spark, tmp_path):
    reports = SessionReports(spark, str(tmp_path / "reports"))
    assert reports.scan().count() == 0
    keyframes = spark.createDataFrame([("v", 0, "initial"), ("v", 1, "text_changed"), ("w", 0, "initial")], "video_id string, frame_number bigint, change_type string")
    semantic = spark.createDataFrame([("v", "{}"), ("w", None)], "video_id string, content string").withColumn("semantic", responses.record(F.col("content"), F.lit(0.0)))
    videos = spark.createDataFrame([("v", "v.mp4"), ("w", "w.mp4")], "video_id string, video_name string")
    assert timeline.reported(reports, keyframes.where("video_id = 'v'"), semantic, videos) == 1
    assert timeline.reported(reports, keyframes.where("video_id = 'w'"), semantic, videos) == 1
    rows = {r.name: (r.keyframes, r.text_based_count, r.frames_with_people) for r in reports.scan().collect()}
    assert rows == {"v.mp4": (2, 1, 0), "w.mp4": (1, 0, 1)}
    reports.reset()
    assert reports.scan().count() == 0


def test_choices(spark):
    rows = timeline.choices(spark.createDataFrame([("lecture.mp4",)], "video_name string")).collect()
    assert [(r.label, r.video_id) for r in rows] == [("All videos", None), ("lecture.mp4", "646ee630")]


def test_written_tables_can_be_dropped(spark):
    table = pagerank.written(spark.range(3))
    path = urllib.parse.urlparse(table.inputFiles()[0]).path
    assert table.count() == 3 and os.path.exists(path)
    drop_tables(spark)
    assert not os.path.exists(path)
    drop_tables(spark)  # nothing there is no error


class Cluster:
    """A session on a cluster that names no shared folder."""

    def __init__(self):
        self.sparkContext = types.SimpleNamespace(master="spark://x:7077", getConf=dict)
        self.conf = {}


def test_a_cluster_has_to_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())
