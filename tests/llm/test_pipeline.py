"""The pipeline's stages on a small table, each against the operator's own result, and the entry point's guard."""

import os

import corpus_pipeline
import pytest

from chronoframe.llm import queries

from .helpers import clashing
from .test_texts import labelled, shingles


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    some, labels = labelled()
    some += [(400 + i, some[1][1] + " more", "en", "s", None) for i in range(3)] + [(500, some[3][1] + "\nkey token=Zq8Lk2Vb9Xw4", "en", "own/one", None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == columns, name
            rows = {r.doc_id: r.text for r in docs.collect()}
            seen.append(len(rows))
            if name == "quality_filter":
                assert all("!!" not in t for t in rows.values()) and len(rows) > 140
            if name == "near_dedup":
                sets = [shingles(t) for t in rows.values() if shingles(t)]
                assert not any(len(a & b) >= 0.75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
            if name == "secret_scan":
                assert "Zq8Lk2Vb9Xw4" not in " ".join(rows.values())
    assert seen[0] > seen[1] >= seen[2] >= seen[3] == seen[4]
    assert {r.doc_id for r in docs.collect()} == set(rows)


def test_line_dedup_deletes_whole_runs(spark):
    run = " ".join(f"word{k}" for k in range(12)) + "\nall rights reserved"
    docs = spark.createDataFrame([(i, f"own {i}\n{run}\nown {i} too", "en", "s", None) for i in range(3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert kept == {0: f"own 0\n{run}\nown 0 too", 1: "own 1\nown 1 too", 2: "own 2\nown 2 too"}


def test_near_dedup_keeps_rows_without_an_id(spark):
    text = " ".join(f"word{k}" for k in range(30))
    some = [(1, text, "en", "s", None), (2, text + " more", "en", "s", None), (3, None, "en", "s", None), (None, text, "en", "a", None), (None, None, "en", "b", None)]
    docs = spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.source) for r in kept.collect()) == [(0, "a"), (0, "b"), (1, "s"), (3, "s")]


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_with_awkward_tables(spark, sf_dir):
    """Null, empty and repeated rows, clashing names and an empty table through every stage."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "", 0), (None, "free of id token=Zq8Lk2Vb9Xw4 " * 3, "en", "s", None), (None, None, None, None, None), (902, " \n\n ", "en", "s", 4), (902, " \n\n ", "en", "s", 4)], schema)
    for docs in (clashing(base.limit(40).unionByName(odd)), clashing(spark.createDataFrame([], schema))):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name == "pack":
                assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and (out.count() > 0) == (n > 0)
            else:
                assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
                assert out.count() <= n
            if name in ("line_dedup", "secret_scan") and n:  # rows without a text or an id stay
                assert out.where("doc_id = 900").count() == 1 and out.where("doc_id IS NULL").count() == 2


def test_all_ten_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
