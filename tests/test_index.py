"""The vector index gives the same rows as a scan, and reads far fewer bytes."""

import glob
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoframe import providers
from chronoframe.operators import retrieve
from chronoframe.plans import timeline
from chronoframe.sources import index as ix
from chronoframe.sources.index import VectorIndex
from chronoframe.sources.store import VectorStore

ROWS = "id string, embedding array<float>"


def made(spark, x, first=0):
    return spark.createDataFrame([(f"v_{first + i:06d}", v.tolist()) for i, v in enumerate(x.astype(np.float32))], ROWS)


def scan(df, q, k):
    return [(r.id, r.distance) for r in retrieve.nearest(df, q, k).select("id", "distance").orderBy("distance", "id").collect()]


def got(index, q, k):
    return [(r.id, r.distance) for r in index.nearest(q, k).collect()]


def clustered(rng, n, dims=32, groups=40):
    return rng.normal(0, 1, (groups, dims))[rng.integers(0, groups, n)] + rng.normal(0, 0.2, (n, dims))


@pytest.mark.parametrize("kind", ["clusters", "even", "copies"])
def test_index_is_the_scan(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    x = clustered(rng, 1500) if kind == "clusters" else rng.normal(0, 1, (1500, 32))
    if kind == "copies":
        x[::3] = x[0]  # a third of the rows is one vector
    df = made(spark, x)
    index = VectorIndex(spark, str(tmp_path / "index")).create(df.where("id < 'v_001000'"))
    index.append(df.where("id >= 'v_001000'"))
    again = VectorIndex(spark, str(tmp_path / "index"))  # another session finds it
    for q, k in ((x[0], 10), (x[7] + 0.1, 3), (np.zeros(32), 5), (x[1], 2000)):
        assert got(again, q.tolist(), k) == scan(df, q.tolist(), k)
    if kind == "clusters":
        again.nearest(x[5].tolist(), 10)
        assert again.last["cells_read"] < again.last["cells"] / 3 and again.last["candidates"] < 60


def test_many_queries_and_many_candidates(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    x = clustered(rng, 600)
    df = made(spark, x)
    index = VectorIndex(spark, str(tmp_path / "index")).create(df)
    want = {q: scan(df, x[q].tolist(), 5) for q in range(0, 600, 150)}
    for most, together in ((5_000, 1_000), (3, 1_000), (5_000, 3)):  # few are sought by id, more by a join; many queries go in turns
        monkeypatch.setattr(ix, "MOST_IDS", most)
        monkeypatch.setattr(ix, "MOST_QUERIES", together)
        found = index.nearest_each([x[q].tolist() for q in want], 5).orderBy("q", "distance", "id").collect()
        assert [(r.id, r.distance) for r in found] == [y for q in want for y in want[q]]


def test_awkward_rows(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [float("nan"), 1.0]), ("e", [1.0, None]), ("f", [0.0, 0.0]), ("g", [1.0, 0.0]), ("h", [])]
    index = VectorIndex(spark, str(tmp_path / "index")).create(spark.createDataFrame(rows, ROWS))
    assert got(index, [1.0, 0.0], 5) == [("a", 0.0), ("g", 0.0), ("f", 1.0)]
    none = VectorIndex(spark, str(tmp_path / "none")).create(spark.createDataFrame([], ROWS))
    assert none.nearest([1.0], 3).count() == 0


def test_an_append_that_failed_isn_t_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (50, 8))
    index = VectorIndex(spark, str(tmp_path / "index")).create(made(spark, x))
    late = made(spark, x[:5], 100)
    fails = F.udf(lambda v: v if v[0] > 1e9 else 1 / 0, "array<float>")
    with pytest.raises(Exception, match="ZeroDivision"):
        index.append(late.withColumn("embedding", fails("embedding")))
    assert all(i < "v_000050" for i, _ in got(index, x[0].tolist(), 50))


def test_bytes_read(spark, tmp_path):
    """A search reads the codes of cells that matter and pages of candidates, well under the table."""
    rng = np.random.default_rng(4)
    x = clustered(rng, 8000, 64, 80)
    index = VectorIndex(spark, str(tmp_path / "index")).create(made(spark, x).repartition(4))
    sizes = dict.fromkeys(("code", "embedding"), 0)
    for f in glob.glob(f"{tmp_path}/index/vectors/*/*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                name = meta.row_group(g).column(c).path_in_schema.split(".")[0]
                sizes["embedding" if name == "embedding" else "code"] += meta.row_group(g).column(c).total_compressed_size
    found = index.nearest(x[11].tolist(), 10)
    assert [r.id for r in found.collect()] == [i for i, _ in scan(made(spark, x), x[11].tolist(), 10)]
    assert sizes["code"] < 0.4 * sizes["embedding"]
    assert index.last["cells_read"] <= 0.2 * index.last["cells"] and index.last["candidates"] <= 100
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert os.path.isdir(f"{tmp_path}/index/appends")


def test_ask_by_index(spark, tmp_path):
    from .test_operators import keyframe_rows

    store, rows = VectorStore(spark, str(tmp_path / "vectors")), keyframe_rows(spark)
    store.append(rows)
    index = VectorIndex(spark, str(tmp_path / "index")).create(store.scan(None, "id", "embedding"))
    nodes, _ = timeline.built_graph(store)
    embedder = providers.HashEmbedder(8)
    plain = timeline.ask(store, nodes, "s t", embedder, 2).collect()
    assert timeline.ask(store, nodes, "s t", embedder, 2, index=index).collect() == plain and len(plain) == 2
