"""Gate sequences, the four-node graph, retrieval, joins, the vector table and streams."""

import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe import providers
from chronoframe.config import Settings
from chronoframe.operators import annotate, audio, embed, gate, graph, packed, pagerank, retrieve, sampling
from chronoframe.sources import media
from chronoframe.sources.store import VectorStore, vector_records
from chronoframe.streaming import gate as gate_stream
from chronoframe.streaming import ingest

FRAMES = "video_id string, frame_number bigint, timestamp double, extracted_text string, pixel_pct double"


def decided(texts, pixels=None, times=None, **settings):
    rows = [{"video_id": "v", "frame_number": i, "timestamp": (times or range(99))[i], "extracted_text": t, "pixel_pct": (pixels or {}).get(i, 0.0)} for i, t in enumerate(texts)]
    return list(gate.decisions_of(rows, Settings(**settings)))


@pytest.mark.parametrize(
    ("texts", "pixels", "want"),
    [
        (["intro slide", "agenda"], {}, ["initial", "text_changed"]),
        (["", "agenda"], {}, ["initial", "text_appeared"]),
        (["agenda", ""], {}, ["initial", "text_disappeared"]),
        (["", "", ""], {1: 0.79, 2: 0.80}, ["initial", "low_pixel", "visual_change"]),
        (["intro slide", "agenda", "intro slide", "intro slide"], {}, ["initial", "text_changed", "flicker", "flicker"]),
        (["abcdefgh", "abcdefgX"], {}, ["initial", "same_text"]),
        (["abcdefghij", "abcdefghiX"], {}, ["initial", "flicker"]),
        (["intro slide", "", "", "intro slide"], {2: 0.1}, ["initial", "text_disappeared", "low_pixel", "flicker"]),
        (["intro slide", "", "", "", "intro slide"], {2: 0.1, 3: 0.1}, ["initial", "text_disappeared", "low_pixel", "low_pixel", "text_appeared"]),
    ],
)
def test_gate(texts, pixels, want):
    assert [x["decision"] for x in decided(texts, pixels)] == want


def test_gate_scores_and_gap():
    found = decided(["intro slide", "agenda"])
    assert round(found[1]["score"], 6) == 0.882353 and found[1]["reason"] == "Text changed (sim: 0.12)"
    assert decided(["", "", ""], {2: 0.8})[2]["reason"] == "80.0% pixels changed"
    close = decided(["intro slide", "agenda", "agenda"], min_keyframe_gap=1.5)
    assert [(x["decision"], x["change_type"], x["accepted"]) for x in close[1:]] == [("too_close", "text_changed", False), ("flicker", None, False)]


TIMES = [0, 0.5, 1.0, 1.4, 2.0, 2.5, 3.4, 4.3, 4.5]


def test_sampler(spark):
    frames = spark.createDataFrame([("v", i, float(t)) for i, t in enumerate(TIMES)], "video_id string, frame_number bigint, timestamp double")
    assert [r.timestamp for r in sampling.sampled(frames, 1.0).orderBy("timestamp").collect()] == [0.0, 1.0, 2.0, 3.4, 4.5]
    assert [x["timestamp"] for x in decided([""] * 9, times=TIMES)] == [0.0, 1.0, 2.0, 3.4, 4.5]
    assert [r.timestamp for r in sampling.spaced(frames, 1.0).orderBy("timestamp").collect()] == [0.0, 1.0, 2.0, 3.4, 4.5][:3] + [3.4, 4.5]


def random_frames(seed, videos=4, n=60):
    rng = random.Random(seed)
    texts = ["", "", "intro slide", "intro slidx", "agenda", "agenda item one", "thanks"]
    return [(f"v{v}", i, i * 0.6 + rng.random() * 0.3, rng.choice(texts), round(rng.random(), 3)) for v in range(videos) for i in range(n)]


def test_stream_gate_is_batch_gate(spark, tmp_path):
    rows = random_frames(1)
    df = spark.createDataFrame(rows, FRAMES)
    batch = gate.gate(df)
    assert batch.where("accepted").count() == gate.keyframes(batch).count() > 4
    totals = gate.counters(batch).first()
    assert totals.frames_checked + 4 == batch.count() and totals.keyframes == batch.where("accepted").count()
    source = str(tmp_path / "frames")
    for k in range(3):
        part = [r for r in rows if 20 * k <= r[1] < 20 * (k + 1)]
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = gate_stream.gate(stream).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((r.video_id, r.frame_number, r.decision, r.accepted) for r in df.collect())
    assert key(spark.table("decided")) == key(batch)


def four(spark):
    rows = [("A0", "A", 0, [1.0, 0.0], 0), ("A5", "A", 5, [0.8, 0.6], 1), ("A20", "A", 20, [0.0, 1.0], 2), ("B0", "B", 0, [0.6, 0.8], 3)]
    return spark.createDataFrame([(i, v, f, f / 10, e, o) for i, v, f, e, o in rows], "id string, video_id string, frame_number bigint, timestamp double, embedding array<double>, ord bigint")


@pytest.mark.parametrize("block", [1024, 1])
def test_similar_pairs(spark, block):
    found = {(r.source, r.target): round(r.similarity, 6) for r in graph.similar_pairs(four(spark), 0.5, block).collect()}
    assert found == {("A0", "A5"): 0.8, ("A0", "B0"): 0.6, ("A5", "A20"): 0.6, ("A5", "B0"): 0.96, ("A20", "B0"): 0.8}


def test_pruned_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(12, 24))[rng.integers(0, 12, 900)] + rng.normal(size=(900, 24)) * 0.15
    m[:200] = m[0]  # one block's direction holds many copies
    rows = [(f"n{i}", i, v.tolist()) for i, v in enumerate(m)] + [("zero", 9999, [0.0] * 24), ("none", 9998, None)]
    vectors = spark.createDataFrame(rows, "id string, ord bigint, embedding array<double>").repartition(3)
    skipped = {}
    for threshold in (0.5, 0.9):
        exact = {(r.source, r.target): round(r.similarity, 9) for r in graph.similar_pairs(vectors.where("id <> 'none'"), threshold).collect()}
        found = graph.similar_pairs_pruned(vectors, threshold, block=64).collect()
        assert {(r.source, r.target): round(r.similarity, 9) for r in found} == exact and len(found) == len(exact) > 10_000
        blocks = graph.balls(vectors, 64)
        n, met = blocks.count(), graph.meeting_balls(blocks, threshold, together=5)
        assert met.count() == met.distinct().count()
        skipped[threshold] = 1 - met.count() / (n * (n + 1) / 2)
    assert skipped[0.9] > 0.5 and skipped[0.5] > 0.2, skipped  # 0.54 and 0.25: the copies alone are four blocks that all meet
    assert graph.similar_pairs_pruned(vectors.where("false"), 0.5).count() == 0


def test_edges_where_vectors_meet_are_merged_edges(spark, monkeypatch):
    """Few sides of many blocks; vectors that are null, zero or hold NaN have temporal edges only."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(300, 6))
    rows = [(f"n{i}", i, i % 3, 7 * i % 300, float(i), v.tolist()) for i, v in enumerate(m)]
    rows += [("none", 900, 0, 900, 900.0, None), ("zero", 901, 0, 901, 901.0, [0.0] * 6), ("nan", 902, 1, 902, 902.0, [float("nan")] * 6)]
    vectors = spark.createDataFrame(rows, "id string, ord bigint, video_id bigint, frame_number bigint, timestamp double, embedding array<double>").repartition(3)
    want = {}
    norm = np.linalg.norm(m, axis=1)
    cos = (m @ m.T) / norm[:, None] / norm[None, :]
    for i, j in zip(*np.nonzero(np.triu(cos >= 0.5, 1)), strict=True):
        want[f"n{i}", f"n{j}"] = round(float(cos[i, j]), 9)
    monkeypatch.setattr(graph, "SIDES", 3)
    monkeypatch.setattr(graph, "BLOCK", 16)
    assert {(r.source, r.target): round(r.similarity, 9) for r in graph.similar_pairs(vectors, 0.5, 16).collect()} == want
    columns = ["source", "target", "weight", "edge_type", "same_video", "similarity", "temporal_distance", "time_gap"]
    merged = graph.merged_edges(graph.semantic_edges(vectors), graph.temporal_edges(vectors)).select(columns).collect()
    for block in (16, 1024):
        found = graph.links(vectors, 0.5, ["id"], following=True, block=block)
        assert found.where("follows").count() == 300
    assert sorted(map(str, graph.edges(vectors).select(columns).collect())) == sorted(map(str, merged))
    assert not [line for line in graph.edges(vectors)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]


def test_packed_edges_are_the_edges(spark, monkeypatch):
    """Weights, ranks and numbers of edges, over several sides; ten bytes an edge, and no row an edge in a round."""
    monkeypatch.setattr(graph, "SIDES", 3)
    rng = np.random.default_rng(12)
    rows = [(f"n{i}", 10**12 + i, i % 3, 7 * i % 300, float(i), v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))]
    rows += [("none", 900, 0, 900, 900.0, None), ("nan", 902, 1, 902, 902.0, [float("nan")] * 6), ("twin", 903, 2, 903, 903.0, [1.0] * 6), ("twin", 903, 2, 904, 904.0, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "id string, ord bigint, video_id bigint, frame_number bigint, timestamp double, embedding array<double>").repartition(3)
    edges = graph.edges(vectors, 0.3, key="ord").select("source", "target", "weight")
    key = lambda df: sorted((r.source, r.target, round(r.weight, 12)) for r in df.collect())
    made = graph.packed_edges(vectors, 0.3, block=16)
    assert key(packed.unpacked(made)) == key(edges) and made.vertices.count() > 1
    nodes = vectors.select(F.col("ord").alias("id")).unionByName(spark.createDataFrame([(77,)], "id bigint"))
    want = {r.id: r.importance for r in pagerank.pagerank(nodes, edges, rounds=9, tolerance=None).collect()}
    for small in (10**6, 0):
        found = {r.id: r.importance for r in packed.packed_pagerank(nodes, made, rounds=9, tolerance=None, small=small).collect()}
        assert all(abs(found[k] - want[k]) < 1e-12 for k in found) and {r[1] for r in rows} <= found.keys()
    settled = {r.id: r.importance for r in packed.packed_pagerank(nodes, made, tolerance=1e-12, small=0).collect()}
    more = {r.id: r.importance for r in pagerank.pagerank(nodes, edges, tolerance=1e-12).collect()}
    assert all(abs(settled[k] - more[k]) < 1e-8 for k in settled)
    counts = Counter(s for s, _, _ in key(edges))
    assert {r.id: r.out_edges for r in packed.out_edges(made).collect()} == {r[1]: counts[r[1]] for r in rows}
    n, size = made.edges.agg(F.sum(F.length("w") / 8), F.sum(F.length("gaps") + F.length("w"))).first()
    assert n == edges.count() and size == 10 * n
    none = graph.packed_edges(vectors.where("false"))
    assert packed.packed_pagerank(nodes.where("false"), none).count() == packed.out_edges(none).count() == 0


def test_wide_gaps_are_packed_too():
    i, j = np.array([3, 0, 3, 2]), np.array([70_000, 5, 1, 90_000])
    for width in (100_000, 90_001):
        a, b, w = packed.opened(*packed.packed(i, j, np.arange(4.0), width), width)
        assert sorted(zip(a, b, w, strict=True)) == sorted(zip(i, j, np.arange(4.0), strict=True))


def test_what_is_shuffled_grows_with_the_vectors():
    """A block goes to as many tasks as there are sides, and sides hold more blocks as there are more."""
    for blocks in (1, 16, 17, 500, 1000):
        assert -(-blocks // graph._per_side(blocks, graph.BLOCK, 64)) <= graph.SIDES
    assert graph._per_side(10**6, graph.BLOCK, 64) * graph.BLOCK * 64 * 8 <= graph.SIDE_BYTES
    assert graph._per_side(10, graph.BLOCK, 10**6) == 1


def test_ranks_of_numbers_are_ranks_of_strings(spark):
    rng = np.random.default_rng(3)
    big = 2**60  # more than a double tells apart
    pairs = sorted({(int(s), int(t)) for s, t in rng.integers(0, 40, (150, 2)) if s != t})
    nodes = spark.createDataFrame([(big + i,) for i in range(40)], "id bigint")
    edges = spark.createDataFrame([(big + s, big + t, 1.0 + s % 3) for s, t in pairs], "source bigint, target bigint, weight double")
    as_text = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "weight")
    want = {int(r.id): r.importance for r in pagerank.pagerank(nodes.select(F.col("id").cast("string").alias("id")), as_text, rounds=12, tolerance=None).collect()}
    for small in (10**6, 0):
        found = {r.id: r.importance for r in pagerank.pagerank(nodes, edges, rounds=12, tolerance=None, small=small).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_similar_pairs_approximately(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(600, 24))
    m[1::2] = m[::2] + rng.normal(size=(300, 24)) * rng.uniform(0.1, 0.6, (300, 1))
    rows = [(f"n{i}", i, v.tolist()) for i, v in enumerate(m)] + [("zero", 9999, [0.0] * 24)]
    vectors = spark.createDataFrame(rows, "id string, ord bigint, embedding array<double>").repartition(3)
    exact = {(r.source, r.target): r.similarity for r in graph.similar_pairs(vectors, 0.85).collect()}
    found = {(r.source, r.target): r.similarity for r in graph.similar_pairs_approximately(vectors, 0.85).collect()}
    assert len(exact) > 150 and set(found) <= set(exact) and len(found) >= 0.95 * len(exact)
    assert all(abs(exact[p] - s) < 1e-9 for p, s in found.items())


def test_graph(spark):
    nodes = four(spark)
    semantic, temporal = graph.semantic_edges(nodes), graph.temporal_edges(nodes)
    edges = graph.merged_edges(semantic, temporal)
    found = {(r.source, r.target): (round(r.weight, 6), r.edge_type, round(r.similarity, 6), r.temporal_distance, r.time_gap) for r in edges.collect()}
    assert found == {
        ("A0", "A5"): (1.0, "temporal", 0.8, 5, 0.5),
        ("A0", "B0"): (0.6, "semantic", 0.6, None, None),
        ("A5", "A20"): (1.0, "temporal", 0.6, 15, 1.5),
        ("A5", "B0"): (0.96, "semantic", 0.96, None, None),
        ("A20", "B0"): (0.8, "semantic", 0.8, None, None),
    }
    assert (semantic.count(), temporal.count()) == (5, 2)
    want = {"A0": 0.132170, "A5": 0.202385, "A20": 0.219939, "B0": 0.445506}
    for small in (10**6, 0):
        rank = {r.id: r.importance for r in pagerank.pagerank(nodes, edges, rounds=20, tolerance=None, small=small).collect()}
        assert abs(sum(rank.values()) - 1) < 1e-9
        assert all(abs(rank[k] - v) < 1e-6 for k, v in want.items())
    stats = {r.video_id: round(r.avg_importance, 6) for r in graph.video_stats(nodes.join(pagerank.pagerank(nodes, edges, rounds=20, tolerance=None), "id")).collect()}
    assert stats == {"A": 0.184831, "B": 0.445506}
    near = lambda w: [(r.id, r.neighbour) for r in graph.context(nodes, w).where("id = 'A0'").collect()]
    assert near(3) == [] and near(5) == [("A0", "A5")]
    own, kept = graph.subgraph(nodes, edges, "A")
    assert own.count() == 3 and kept.count() == 2 and graph.subgraph(nodes, edges, "zzz")[0].count() == 0
    norms = [round(r.differential_norm, 6) for r in embed.differential(nodes.where("video_id = 'A'")).orderBy("frame_number").collect()]
    assert norms == [0.0, 0.632456, 0.894427]
    ordinal = {(r.source, r.target): r.temporal_distance for r in graph.semantic_edges(nodes, distance_unit="ordinal").collect()}
    assert ordinal["A5", "A20"] == 1


def test_ranks_go_on_from_an_earlier_run(spark):
    """A graph grown by a few edges settles to the same ranks in fewer rounds, as numbers in one task and as tables."""
    rng = np.random.default_rng(3)
    n = 3000
    s, t = rng.integers(0, n, 12_000), rng.integers(0, n, 12_000)
    w = rng.random(12_000) + 0.1
    before, took = pagerank.iterate(s, t, w, n, 0.85, 300, 1e-13), []
    s2, t2, w2 = np.append(s, [1, 2, n]), np.append(t, [7, n, 9]), np.append(w, [1.0, 1.0, 1.0])
    full = pagerank.iterate(s2, t2, w2, n + 1, 0.85, 300, 1e-13, took=took)
    cold = took[0]
    warm = pagerank.iterate(s2, t2, w2, n + 1, 0.85, 300, 1e-13, np.append(before * n / (n + 1), 1 / (n + 1)), took)
    assert np.abs(full - warm).max() < 1e-9 and took[0] < cold  # 28 of 33 at this tolerance
    rounds = []
    for start in (None, np.append(before * n / (n + 1), 1 / (n + 1))):
        pagerank.iterate(s2, t2, w2, n + 1, 0.85, 300, 1e-6, start, took)
        rounds += took
    assert rounds[1] < rounds[0] / 2  # 1 of 9 at the default tolerance
    m = 40
    made = lambda k: spark.createDataFrame([(f"n{i}", f"n{(i * i + 1) % m}", 1.0 + i) for i in range(k)], "source string, target string, weight double")
    nodes = spark.range(m).select(F.concat(F.lit("n"), "id").alias("id"))
    key = lambda df: {r.id: r.importance for r in df.collect()}
    old = pagerank.written(pagerank.pagerank(nodes.where("id <> 'n39'"), made(38), tolerance=1e-13, rounds=300))
    want = key(pagerank.pagerank(nodes, made(m), tolerance=1e-13, rounds=300))
    rounds = []
    for small in (10**6, 0):
        found = key(pagerank.pagerank(nodes, made(m), tolerance=1e-12, rounds=300, small=small, start=old, took=rounds) if small else pagerank.pagerank(nodes, made(m), tolerance=1e-4, rounds=300, small=0, start=spark.createDataFrame(list(want.items()), "id string, importance double"), took=rounds))
        assert max(abs(found[k] - want[k]) for k in want) < 1e-9 and len(found) == m
    assert rounds == [1]  # already settled


def test_convergence_is_checked():
    ring = np.array([0, 1, 2]), np.array([1, 2, 0]), np.ones(3)
    assert np.allclose(pagerank.iterate(*ring, 3, 0.85, 100, 1e-6), 1 / 3)
    with pytest.raises(ArithmeticError):
        pagerank.iterate(np.array([0]), np.array([1]), np.ones(1), 2, 0.85, 1, 1e-12)


def test_search(spark):
    nodes = four(spark)
    rank = nodes.drop("embedding").join(pagerank.pagerank(nodes, graph.merged_edges(graph.semantic_edges(nodes), graph.temporal_edges(nodes)), rounds=20, tolerance=None), "id")
    hits = retrieve.search(nodes, rank, [1.0, 0.0], k=2, include_context=True).orderBy(F.desc("score")).collect()
    assert [(r.id, round(r.distance, 6), round(r.similarity, 6), round(r.score, 6)) for r in hits] == [("A0", 0.0, 1.0, 0.739651), ("A5", 0.4, 0.6, 0.480716)]
    assert [r.context_nodes for r in hits] == [[], []]
    every = retrieve.search(nodes, rank.where("false"), [1.0, 0.0], k=4).orderBy(F.desc("score")).collect()
    assert [r.importance for r in every] == [0.5] * 4
    chunk = retrieve.with_chunk(spark.createDataFrame([(1.0,), (10.0,)], "timestamp double")).collect()
    assert [(r.chunk_start, r.chunk_end, r.chunk_duration) for r in chunk] == [(0.0, 3.5, 3.5), (7.5, 12.5, 5.0)]
    with pytest.raises(ValueError):
        retrieve.search(nodes, rank, [1.0, 0.0], k=11)


def test_audio(spark):
    segments = spark.createDataFrame([("v", 0.0, 4.9, "a"), ("v", 3.0, 5.0, "b"), ("v", 9.0, 11.0, "c"), ("v", 15.0, 20.0, "d"), ("v", 15.1, 18.0, "e"), ("w", 9.0, 11.0, "x")], "video_id string, start double, end double, text string")
    frames = spark.createDataFrame([("v", 1, 10.0), ("u", 1, 10.0)], "video_id string, frame_number bigint, timestamp double")
    assert {r.video_id: r.audio_text for r in audio.with_audio(frames, segments).collect()} == {"v": "b c d", "u": ""}
    rng = random.Random(2)
    spans = [("v", a, a + rng.random() * 30, f"s{i:02d}") for i, a in enumerate(sorted(rng.random() * 100 for _ in range(40)))]
    times = [(("v"), i, rng.random() * 110) for i in range(30)]
    found = {r.frame_number: r.audio_text for r in audio.with_audio(spark.createDataFrame(times, frames.schema), spark.createDataFrame(spans, segments.schema)).collect()}
    assert found == {i: " ".join(t for _, a, b, t in spans if a <= x + 5 and b >= x - 5) for _, i, x in times}


def keyframe_rows(spark):
    rows = spark.createDataFrame([("v", 1, 0.5, '{"main_subject": "s", "extracted_text": "t"}'), ("v", 2, 1.5, "nope"), ("w", 1, 0.5, None)], "video_id string, frame_number bigint, timestamp double, content string")
    rows = annotate.prompted(annotate.annotated(rows).withColumn("audio_text", F.lit("said")))
    rows = providers.embedded(rows, providers.HashEmbedder(8)).withColumn("frame_path", F.lit("p")).withColumn("scene_change_score", F.lit(1.0))
    return vector_records(embed.differential(rows.withColumn("embedding", F.col("embedding").cast("array<double>"))))


def test_store(spark, tmp_path):
    store, rows = VectorStore(spark, str(tmp_path / "vectors")), keyframe_rows(spark)
    assert store.scan().count() == 0
    assert store.append(rows) == 3 and store.append(rows) == 0 and store.append(rows.limit(0)) == 0
    assert [r.id for r in store.scan("v").orderBy("id").collect()] == ["v_000001", "v_000002"]
    assert store.scan("v", "id", "audio_context").first().audio_context == "said"
    assert "PartitionFilters: [isnotnull(video_id" in store.scan("v")._jdf.queryExecution().toString()
    store.clear()
    assert store.scan().count() == 0 and store.append(rows) == 3


def test_appends_at_once_add_each_id_once(spark, tmp_path, monkeypatch):
    schema = "id string, frame_number bigint, video_id string"
    made = lambda a, b, v="v": spark.createDataFrame([(f"{v}_{i}", i, v) for i in range(a, b)], schema)
    store, other = VectorStore(spark, str(tmp_path / "x"), schema), VectorStore(spark, str(tmp_path / "x"), schema)
    assert store.append(made(0, 5)) == 5
    put, turns = store._put, []

    def late(number, listed):  # another writer is always a little faster, twice
        if len(turns) < 2:
            turns.append(other.append(made(4, 8) if not turns else made(20, 22)))
        return put(number, listed)

    monkeypatch.setattr(store, "_put", late)
    assert store.append(made(3, 10)) == 2 and turns == [3, 2]  # 8 and 9 are left
    ids = [r.id for r in store.scan().collect()]
    assert sorted(ids) == sorted(set(ids)) and len(ids) == 12 == other.scan().count()
    before = store.scan()
    store.clear()
    assert other.scan().count() == 0 and before.count() == 12  # a reader of an older version finishes
    assert store.append(made(0, 3)) == 3 and store.vacuum() >= 3 and other.scan().count() == 3


def test_appends_read_only_their_videos_and_replays_read_nothing(spark, tmp_path, monkeypatch):
    schema = "id string, frame_number bigint, video_id string"
    store = VectorStore(spark, str(tmp_path / "x"), schema)
    rows = [(f"v{v}_{i}", i, f"v{v}") for v in range(5) for i in range(20)]
    assert store.append(spark.createDataFrame(rows, schema), batch=("s", 3)) == 100
    had, read = [], store._read

    def seen(folders):
        had.append(read(folders))
        return had[-1]

    monkeypatch.setattr(store, "_read", seen)
    assert store.append(spark.createDataFrame(rows, schema), batch=("s", 3)) == 0 and store.append(spark.createDataFrame(rows, schema), batch=("s", 2)) == 0 and not had
    assert store.append(spark.createDataFrame([("v1_3", 3, "v1"), ("v1_99", 99, "v1"), ("%_1", 1, "a b/%")], schema), batch=("s", 4)) == 2
    assert store.append(spark.createDataFrame([("v2_3", 3, "v2")], schema), batch=("t", 0)) == 0
    assert store.scan().count() == 102 and store.scan("a b/%").count() == 1
    assert store._latest()[1]["streams"] == {"s": 4, "t": 0}


def test_ingest_stream(spark, tmp_path):
    store, source = VectorStore(spark, str(tmp_path / "vectors")), str(tmp_path / "in")
    rows = keyframe_rows(spark)
    rows.write.parquet(source)
    for _ in range(2):
        ingest.into_store(spark.readStream.schema(rows.schema).parquet(source), store, str(tmp_path / "check")).awaitTermination(120)
    assert store.scan().count() == 3


def test_media(spark, tmp_path):
    folder = str(tmp_path / "up")
    media.land("lecture.mp4", b"one", folder)
    media.land("lecture.mp4", b"three", folder)
    media.land("notes.txt", b"x", folder)
    files = media.uploads(spark, folder)
    assert [(r.video_id, r.length) for r in files.collect()] == [("646ee630", 5)]
    assert media.path_of(files, "646ee630").count() == 1 and media.path_of(files, "none").count() == 0
    assert ingest.arriving_files(spark, folder).isStreaming
    spark.dataSource.register(media.VideoFrames)
    assert media.VideoFrames({"paths": "a,b"}).reader(None).paths == ["a", "b"]
    assert media.cut_chunk("none.mp4", 0, 1, os.path.join(folder, "lecture.mp4")).endswith("lecture.mp4")


def test_sampler_over_batches_is_linear(spark):
    """A million kept frames of one video beside others, by plain loops."""
    import time

    rng = np.random.default_rng(3)
    times = np.cumsum(rng.random(60_000) * 2)
    rows = [("long", i, float(t)) for i, t in enumerate(times)] + [(None, 7, 1.0), ("one", 1, 5.0), ("one", 2, None), ("two", 1, 0.5), ("two", 2, 0.9), ("two", 3, 1.4), ("two", 4, 2.4)]
    frames = spark.createDataFrame(rows, "video_id string, frame_number bigint, timestamp double").repartition(3)
    due, kept, last, far = 1.0, [0], times[0], [0]
    for i, t in enumerate(times[1:], 1):
        if t >= due:
            kept.append(i)
            due = t + 1.0
        if t - last >= 1.5:
            far.append(i)
            last = t
    got = sampling.sampled(frames, 1.0).collect()
    assert sorted(r.frame_number for r in got if r.video_id == "long") == kept
    assert [r.frame_number for r in got if r.video_id is None] == [7] and [r.frame_number for r in got if r.video_id == "one"] == [1]
    assert sorted(r.frame_number for r in got if r.video_id == "two") == [1, 3, 4]
    assert sorted(r.frame_number for r in sampling.spaced(frames, 1.5).collect() if r.video_id == "long") == far
    many = spark.range(1_000_000).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_number"), (F.col("id") * 1.0).alias("timestamp"))
    start = time.perf_counter()
    assert sampling.sampled(many, 1.0).count() == 1_000_000
    assert time.perf_counter() - start < 60


def test_append_computes_its_rows_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def ids(x: pd.Series) -> pd.Series:
        calls.add(len(x))
        return x.astype(str)

    rows = spark.range(50).select(ids("id").alias("id"), F.lit("v").alias("video_id"))
    store = VectorStore(spark, str(tmp_path / "once"), "id string, video_id string")
    assert store.append(rows) == 50 and calls.value == 50
    assert store.append(rows) == 0 and store.scan().count() == 50


def test_standalone_recognizer_and_features(spark):
    frames = spark.createDataFrame([(i, t) for i, t in enumerate([b"two words", b"NO_TEXT ", b"", b"boom"])], "i int, data binary")

    def ocr(data):
        if bytes(data) == b"boom":
            raise RuntimeError
        return bytes(data).decode()

    read = [tuple(r.ocr) for r in providers.texts_read(frames, ocr).orderBy("i").collect()]
    assert read == [("two words", 2, 95.0, True), *[("", 0, 0.0, False)] * 3]
    assert {tuple(r.ocr) for r in providers.texts_read(frames, ocr, enabled=False).collect()} == {("", 0, 0.0, False)}

    class Bytes:
        dims = 4

        def __call__(self, images):
            return np.array([np.bincount(np.frombuffer(bytes(x), np.uint8) % 4, minlength=4) for x in images], float)

    found = [r.features for r in providers.featured(frames.coalesce(1), Bytes).orderBy("i").collect()]
    assert abs(np.linalg.norm(found[0]) - 1) < 1e-6 and found[2] == [0.0] * 4


def test_providers(spark):
    frames = spark.createDataFrame([(1, bytearray(b"hello")), (2, bytearray(b"none")), (3, bytearray(b"I am unable")), (4, bytearray(b"bad"))], "i int, data binary")

    def ocr(data):
        if bytes(data) == b"bad":
            raise RuntimeError("down")
        return bytes(data).decode()

    assert [r.extracted_text for r in providers.recognized(frames, ocr).orderBy("i").collect()] == ["hello", "", "", ""]
    assert [r.content for r in providers.described(frames, ocr).orderBy("i").collect()][3] is None

    class Down:
        dims = 4

        def __call__(self, texts):
            raise RuntimeError("down")

    assert providers.embedded(spark.createDataFrame([("a",)], "prompt string"), Down()).first().embedding == [0.0] * 4
    files = spark.createDataFrame([("v", bytearray(b"x")), ("w", bytearray(b"bad"))], "video_id string, content binary")
    said = providers.transcribed(files, lambda data: [(0, 1, " hi ")] if bytes(data) == b"x" else 1 / 0).collect()
    assert [(r.video_id, r.start, r.end, r.text) for r in said] == [("v", 0.0, 1.0, "hi")]
    a = providers.HashEmbedder(16)(["same words", "same words", ""])
    assert np.allclose(a[0], a[1]) and not a[2].any()


def test_plans_have_no_nested_loops(spark):
    nodes = four(spark)
    plans = [graph.context(nodes, 3), graph.similar_pairs(nodes, 0.5), audio.with_audio(nodes, nodes.select("video_id", F.col("timestamp").alias("start"), (F.col("timestamp") + 1).alias("end"), F.col("id").alias("text"))), retrieve.rescored(nodes.withColumn("distance", F.lit(0.0)), nodes.select("id", F.lit(0.1).alias("importance")))]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_empty_frames(spark):
    none = spark.createDataFrame([], FRAMES)
    assert gate.gate(none).count() == 0 and sampling.sampled(none, 1.0).count() == 0
    assert pd.DataFrame(gate.counters(gate.gate(none)).collect()).shape[0] == 1
