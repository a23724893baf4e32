"""Line dedup by a suffix array over line-id sequences.

Documents are sequences of line ids (hashes of lines). Prefix doubling ranks all suffixes by their first 2**k lines:
a suffix's rank is its group's place plus the number of suffixes of the group with a smaller rank 2**k lines further on
(Manber and Myers; Larsson and Sadakane). Suffixes that are alone in their group can't start a repeat and leave.
Ranks are counts, made from counts of classes within slices of each group, so that no task sorts a whole group.

A run counts from `min_words` words on and starts at a line with words. Runs are looked up as windows: two suffixes share
a window if and only if their ranks at the greatest fitting level agree at both ends of it. Such a class is an interval
of the suffix array whose longest common prefix reaches the window. Its earliest member, by (doc_id, line), stays; every
later one is deleted.

By default each line starts one window, the fewest lines that have `min_words` words: the last lines of a repeated run,
from which fewer words follow, stay unless a window from an earlier line reaches them. With `maximal`, each line also
ends one, from the last line from which there are `min_words` words up to it. Any line of a repeated run has enough
words of the run up to it, and lies in the window that it ends, or too few, and lies in the one that the run's first
line starts. So these windows cover the maximal repeated runs, all lines from which on the same ones come earlier in the
corpus, to their last lines.

Defined results: null, empty and blank texts lose nothing; runs don't reach over documents' ends; a document with fewer
words than `min_words` loses nothing; repeats within one document count; ids must be unique, rows with null ids are left
out; extra columns are kept by `deduplicated`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, unused, written

#: Slices of a group are 2 to this power at least.
SLICE_BITS = 12


def sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, pos, line, m, most): each line's id, and how many lines from it on have `min_words` words; 0 if too few do.

    most: up to how many lines it is the last from which there are `min_words` words; never less than m.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at, line, need, upto = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = (text or "").encode().split(b"\n")
            total = np.append(0, np.cumsum([len(x.split()) for x in lines]))
            reach = np.searchsorted(total, total[:-1] + min_words)  # the first end with enough words
            m = np.where(reach < len(total), reach - np.arange(len(lines)), 0)
            # a run starts with words, or blank lines would start runs of their own
            m[np.diff(total) == 0] = 0
            most = np.where(m > 0, np.maximum(m, np.append(reach[1:], len(total)) - 1 - np.arange(len(lines))), 0)
            ids += [doc_id] * len(lines)
            at += range(len(lines))
            line += [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]
            need += m.tolist()
            upto += most.tolist()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(line, pa.int64()), pa.array(need, pa.int32()), pa.array(upto, pa.int32())], ["doc_id", "pos", "line", "m", "most"])

    return map_batches(docs.select("doc_id", "text"), f, "doc_id bigint, pos int, line bigint, m int, most int")


def _ranks(pairs: DataFrame, slice_of: Column) -> DataFrame:
    """(r1, r2, rank) of every pair of ranks that occurs twice: r1 plus the number of its smaller repeated members."""
    classes = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").withColumn("slice", slice_of)
    slices = classes.groupBy("r1", "slice").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("r1").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("r1", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("r1", "slice").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return classes.join(slices, ["r1", "slice"]).select("r1", "r2", (F.col("r1") + F.col("base") + F.col("inner")).alias("rank"))


def _later(keyed: DataFrame, *key: str) -> DataFrame:
    """(doc_id, pos, m) of all but the earliest member of each key.

    The earliest are pre-aggregated and written, so that the join back has two plain sides and AQE can split hot keys.
    """
    first = keyed.groupBy(*key).agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "first")
    return keyed.join(first, list(key)).where(F.struct("doc_id", "pos") != F.col("first")).select("doc_id", "pos", "m")


def repeats(docs: DataFrame, min_words: int = 10, maximal: bool = False) -> DataFrame:
    """(doc_id, pos, m): m lines from line pos on occur earlier in the corpus."""
    rows = written(sequences(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL"), min_words), "lines")
    # as many slices of all lines as lines in a slice, so that neither list grows with the corpus but by its root
    bits = max(SLICE_BITS, math.ceil(math.log2(max(rows.count(), 1)) / 2))
    first = _ranks(rows.select(F.lit(0).cast("bigint").alias("r1"), F.col("line").alias("r2")), F.shiftright("r2", 64 - bits))
    most = F.col("most" if maximal else "m").alias("most")
    now = rows.join(first.select(F.col("r2").alias("line"), "rank"), "line").select("doc_id", "pos", "m", most, "rank")
    found, size = [], 1
    while True:
        now = written(now, "suffixes")
        longest, n = now.agg(F.max("most"), F.count("*")).first()
        here = now.where((F.col("m") > 0) & (F.col("most") >= size) & (F.col("m") < 2 * size))
        here = here.withColumn("m", F.explode(F.sequence(F.greatest("m", F.lit(size)), F.least("most", F.lit(2 * size - 1)))))
        end = now.select("doc_id", F.col("pos").alias("end"), F.col("rank").alias("last"))
        ends = here.withColumn("end", (F.col("pos") + F.col("m") - size).cast("int"))
        keyed = here.withColumn("last", F.col("rank")) if size == 1 else ends.join(end, ["doc_id", "end"])
        found.append(_later(keyed.select("doc_id", "pos", "m", "rank", "last"), "m", "rank", "last"))
        if not n or longest < 2 * size:
            break
        ahead = now.select("doc_id", (F.col("pos") - size).cast("int").alias("pos"), F.col("rank").alias("r2"))
        pairs = now.withColumnRenamed("rank", "r1").join(ahead, ["doc_id", "pos"])
        span = F.greatest(F.lit(1), F.floor(F.lit(n) / (1 << bits))).cast("bigint")
        ranked = _ranks(pairs.select("r1", "r2"), F.floor(F.col("r2") / span))
        now, size = pairs.join(ranked, ["r1", "r2"]).select("doc_id", "pos", "m", "most", "rank"), 2 * size
    return reduce(DataFrame.unionByName, found)


def _kept(text: str | None, pos: list[int] | None, m: list[int] | None) -> tuple[str | None, int, int]:
    """What is left of a text, its number of lines, and how many of these went."""
    if text is None or not pos:
        return text, (text or "").count("\n") + 1, 0
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    np.add.at(gone, pos, 1)
    np.add.at(gone, np.add(pos, m), -1)
    stay = np.cumsum(gone[:-1]) == 0
    return "\n".join(x for x, k in zip(lines, stay, strict=True) if k), len(lines), int((~stay).sum())


def _by_document(docs: DataFrame, min_words: int, maximal: bool) -> DataFrame:
    return repeats(docs, min_words, maximal).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("runs")).select(F.col("doc_id").alias("__id"), F.col("runs.pos").alias("__pos"), F.col("runs.m").alias("__m"))


def digests(docs: DataFrame, min_words: int = 10, maximal: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of every document."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    both = own.join(_by_document(docs, min_words, maximal), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "__pos", "__m")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_kept(*x) for x in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array([hashlib.sha256((x[0] or "").encode()).hexdigest() for x in rows])], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return map_batches(both, f, "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, min_words: int = 10, maximal: bool = False) -> DataFrame:
    """The rows with later copies of lines deleted from `text`; rows that lose all their words that way go.

    Other columns stay as they are, but `n_chars`, where there is one, follows the text.
    """
    runs = _by_document(docs, min_words, maximal)
    both = docs.join(runs, docs["doc_id"].cast("bigint") == runs["__id"], "left").select(*(docs[c] for c in docs.columns), runs["__pos"].alias(unused("__pos", docs)), runs["__m"].alias(unused("__m", docs)))
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    n = len(docs.columns)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        rows = [_kept(*x) for x in zip(texts, batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
        columns = list(batch.columns[:n])
        columns[at] = pa.array([x[0] for x in rows], columns[at].type)
        if size is not None:
            columns[size] = pa.array([len(x[0]) if x[2] else k for x, k in zip(rows, columns[size].to_pylist(), strict=True)], columns[size].type)
        stay = pa.array([not x[2] or bool(x[0].split()) for x in rows], pa.bool_())
        return pa.RecordBatch.from_arrays(columns, batch.schema.names[:n]).filter(stay)

    return map_batches(both, f, docs.schema)
