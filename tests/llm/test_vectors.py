"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import embeddings, nearest

from .helpers import clashing, union_find

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(seed=1, n=300, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    base[40:80] = base[0] + rng.normal(size=(40, dims)) * np.linspace(0.02, 0.5, 40)[:, None]
    base[80:100] = base[80]
    base[100:110] = base[80] * 4
    out = [(i, [float(np.float32(x)) for x in v], int(i % 3 if i >= 110 else 1)) for i, v in enumerate(base)]
    nan, inf = float("nan"), float("inf")
    out += [(1000, None, 1), (1001, [0.0] * dims, 1), (1002, [nan] * dims, 1), (1003, [inf] + [1.0] * (dims - 1), 1), (1004, [1.0, None] + [1.0] * (dims - 2), 1), (1005, [1.0] * 3, 1)]
    out += [(1006, out[80][1], None), (1050, [], 2), (1100, out[3][1], None)]
    return out


def usable(rows):
    fine = [(i, v, k) for i, v, k in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([v for _, v, _ in fine])
    return fine, m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("cell,codes", [(4096, 65_536), (20, 9)])
def test_nearest(spark, cell, codes, monkeypatch):
    monkeypatch.setattr(nearest, "CODES", codes)
    monkeypatch.setattr(nearest, "QUERIES", codes)
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, SCHEMA).drop("id")).repartition(3)
    found = nearest.search(df, df.where(F.col("vec_id") % 50 == 0), k=5, cell=cell).collect()
    fine, m = usable(rows)
    ids = np.array([i for i, *_ in fine])
    hits = total = 0
    for q, unit in zip(ids, m, strict=True):
        if q % 50:
            continue
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in own]
        cos = m @ unit
        assert all(abs(r.score - cos[ids == r.vec_id][0]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        best = [i for i in ids[np.lexsort((ids, -np.round(cos, 12)))] if i != q][:5]
        hits, total = hits + len(set(best) & {r.vec_id for r in own}), total + 5
    assert {r.query_id for r in found} == {i for i in ids if i % 50 == 0}
    assert hits / total >= 0.95


def recall(found, m, asked, k=5):
    best = {int(q): {int(i) for i in np.argsort(-(m @ m[q]), kind="stable")[: k + 1] if i != q} for q in asked}
    return np.mean([len(best[r] & {x.vec_id for x in found if x.query_id == r}) / k for r in best])


@pytest.mark.parametrize("kind", ["even", "clustered", "low rank"])
def test_nearest_recall(spark, kind):
    rng = np.random.default_rng(4)
    n, dims = 20_000, 64
    m = rng.normal(size=(n, dims))
    if kind == "clustered":
        m = rng.normal(size=(100, dims))[rng.integers(0, 100, n)] + 0.4 * m
    if kind == "low rank":
        m = m[:, :8] @ rng.normal(size=(8, dims))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], SCHEMA).repartition(4)
    asked = range(0, n, 100)
    found = nearest.search(df, df.where(F.col("vec_id") % 100 == 0), k=5, cell=1_000).collect()
    assert len(found) == 5 * len(asked)
    m = m.astype(np.float64)
    assert all(abs(r.score - m[r.query_id] @ m[r.vec_id] / np.linalg.norm(m[r.query_id]) / np.linalg.norm(m[r.vec_id])) < 1e-12 for r in found)
    assert recall(found, m / np.linalg.norm(m, axis=1, keepdims=True), asked) >= 0.95


def test_nearest_cells_grow_with_the_table(spark):
    """Over 512 cells: coarse regions are parted by fine centres."""
    rng = np.random.default_rng(9)
    n, dims = 20_000, 32
    m = rng.normal(size=(400, dims))[rng.integers(0, 400, n)] + 0.3 * rng.normal(size=(n, dims))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    rows = m.astype(np.float64)
    cells = nearest.Cells(rows[:8_192], 1_250)
    own = cells.of(rows)
    assert len(cells) > 1_250 and len(np.unique(own)) > 600 and len(cells.coarse) == 512
    # rows lie in a nearest cell, and asking without a bound asks all
    row, cell = cells.asked(rows[:50], np.full(50, np.inf))
    assert len(row) == 50 * len(cells) and len(set(zip(row.tolist(), cell.tolist(), strict=True))) == len(row)
    row, cell = cells.asked(rows[:50], first=2)
    assert row.tolist() == [i for i in range(50) for _ in range(2)] and all(own[i] in cell[row == i] for i in range(50))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], SCHEMA).repartition(4)
    asked = range(0, n, 500)
    found = nearest.search(df, df.where(F.col("vec_id") % 500 == 0), k=5, cell=16).collect()
    assert len(found) == 5 * len(asked)
    assert recall(found, rows / np.linalg.norm(rows, axis=1, keepdims=True), asked) >= 0.95


def test_nearest_of_wide_vectors(spark, monkeypatch):
    """Blocks and the sample are cut by bytes: 3,072 dimensions, a few rows a block."""
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 40 * 3_072 * 8)
    monkeypatch.setattr(nearest, "SAMPLE_BYTES", 64 * 3_072 * 8)
    rng = np.random.default_rng(10)
    m = rng.normal(size=(150, 3_072)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], SCHEMA).repartition(2)
    found = nearest.search(df, df.where("vec_id % 50 = 0"), k=3, cell=75)
    found = found.collect()
    rows = m.astype(np.float64)
    assert len(found) == 9 and recall(found, rows / np.linalg.norm(rows, axis=1, keepdims=True), [0, 50, 100], 3) >= 0.95


def test_nearest_bounds_hold():
    rng = np.random.default_rng(8)
    m = rng.normal(size=(3_000, 50))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    turn, centre = nearest.rotation(50), m[:200].mean(axis=0)
    packed, scalars = nearest.codes(m - centre, centre, turn)
    assert packed.shape == (3_000, 1) and turn.shape == (64, 50)  # one bit a padded dimension
    about, error = nearest.estimates(m[:100], centre, packed, scalars, turn)
    off = np.abs(about - m[:100] @ m.T) / error
    assert np.mean(off > nearest.DEVIATIONS) < 0.03 and np.mean(off > 4) < 1e-3
    # a vector at its centre is known exactly
    packed, scalars = nearest.codes(np.zeros((1, 50)), centre, turn)
    about, error = nearest.estimates(m[:5], centre, packed, scalars, turn)
    assert np.allclose(about[:, 0], m[:5] @ centre, atol=1e-6) and not error.any()


def test_nearest_with_shorter_queries(spark):
    long = spark.createDataFrame([(i, [1.0, float(i), 2.0], 1) for i in range(1, 9)], SCHEMA)
    short = spark.createDataFrame([(50, [1.0, 2.0], 1), (100, None, 1)], SCHEMA)
    assert nearest.search(long, short).count() == 0 and nearest.search(short, long).count() == 0
    assert nearest.search(long, long.where("vec_id = 3")).count() == 5


def test_nearest_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)], SCHEMA)
    found = [(r.query_id, r["rank"], r.vec_id) for r in nearest.search(df, df, k=5).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1), (0, 2, 2), (1, 1, 2), (1, 2, 0), (2, 1, 1), (2, 2, 0)]
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("members", [2048, 7])
def test_near_duplicates(spark, members, monkeypatch):
    monkeypatch.setattr(embeddings, "MEMBERS", members)
    rows = vectors()
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)).collect()}
    fine, m = usable(rows)
    cos = m @ m.T
    pairs = [(fine[i][0], fine[j][0]) for i in range(len(fine)) for j in range(i + 1, len(fine)) if fine[i][2] == fine[j][2] and fine[i][2] is not None and cos[i, j] >= 0.93]
    top = union_find([i for i, *_ in rows], pairs)
    n = {i: 0 for i, *_ in rows}
    for a, b in pairs:
        n[a], n[b] = n[a] + 1, n[b] + 1
    assert found == {i: (n[i], top[i], top[i] == i) for i, *_ in rows}


@pytest.mark.parametrize("kind", ["even", "low rank"])
def test_near_duplicates_over_many_cells(spark, kind):
    rng = np.random.default_rng(6)
    n, dims, cell = 21_000, 64, 256  # 20,000 vectors of one label: a grid of 8 x 8
    m = rng.normal(size=(n, dims))
    if kind == "low rank":
        m = m[:, :10] @ rng.normal(size=(10, dims))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    # every other vector has a partner at a cosine of 0.93 to 0.95
    other = rng.normal(size=(n // 2, dims))
    other -= (other * m[::2]).sum(axis=1, keepdims=True) * m[::2]
    cos = rng.uniform(0.9301, 0.95, (n // 2, 1))
    m[1::2] = cos * m[::2] + np.sqrt(1 - cos**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    label = np.where(np.arange(n) < 20_000, 0, 1 + np.arange(n) // 2 % 50)
    m = m.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(m, label, strict=True))], SCHEMA).repartition(4)
    assert round(np.log2(20_000 / cell) / 2) == 3
    found = {r.vec_id: r for r in embeddings.near_duplicates(df, cell=cell).collect()}
    m = m.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want, pairs = np.zeros(n, np.int64), []
    for a in range(0, n, 1_000):
        i, j = np.nonzero((m[a : a + 1_000] @ m.T >= 0.93) & (label[a : a + 1_000, None] == label))
        keep = i + a != j
        np.add.at(want, i[keep] + a, 1)
        pairs += zip((i[keep] + a).tolist(), j[keep].tolist(), strict=True)
    have = np.array([found[i].n_links for i in range(n)])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum() >= 0.99 * 20_000
    top = union_find(range(n), [(a, b) for a, b in pairs if a < b])
    assert np.mean([found[i].component_id == top[i] for i in range(n)]) >= 0.99


def test_traversal_rises():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    seen = list(embeddings.multi_sequence(a, b, 1.0))
    sums = [a[i] + b[j] for i, j in seen]
    assert sums == sorted(sums) and set(seen) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 1.0}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embeddings.near_duplicates(none).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(5, None, None), (6, [2.0], 1), (7, [1.0], 1)], SCHEMA)).orderBy("vec_id").collect()] == [(5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)]
