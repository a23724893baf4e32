"""Repeated passages by level-wise doubling: windows repeated at one length alone are extended to twice that length.

For windows of 20 words the levels are 5, 10 and 20 words (`levels`). A candidate is the start of a full window. At a
lower level it is stood for by its minimizer, the window of the level's length within it with the least hash (leftmost of
equals): equal passages have equal minimizers, so only minimizers are counted over the corpus, and candidates survive
whose minimizer occurs again. All starts are candidates at the first level, the survivors of one level at the next. The
last level hashes survivors at full length; a window is a repeat if its hash starts earlier, by (doc_id, position). With
these the wanted length is reached and no candidates are left to extend.

All levels travel as packed arrays, dealt out by hash to a number of buckets that grows with the corpus, so that a bucket
stays small. Within a batch of documents only the first occurrence of a hash travels there; what a batch knows to be
repeated is spread evenly instead. So one passage in a third of all documents costs its bucket a row a batch.

Windows are told apart by 64-bit hashes of hashes of words, not by the words themselves.

Defined results: null, empty and short texts have no windows; overlapping windows of one document count (the earlier
start is the original); ids must be unique, rows with null ids are left out; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes, windows_of, words_of


def _minimizers(half: np.ndarray, span: int) -> np.ndarray:
    """For each position, the leftmost position of the least of `span` values from there on."""
    n = len(half) - span + 1
    value, at, width = half, np.arange(len(half)), 1
    while width * 2 <= span:
        later = value[width:] < value[: len(value) - width]
        value, at, width = np.where(later, value[width:], value[: len(value) - width]), np.where(later, at[width:], at[: len(at) - width]), width * 2
    shift = span - width
    later = value[shift:][:n] < value[:n]
    return np.where(later, at[shift:][:n], at[:n])


def _valid_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window of `length` words lies within one row, and those rows."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + first[rows], rows


def _first_of(hashes: np.ndarray) -> np.ndarray:
    """Mask of each value's first occurrence in array order."""
    out = np.zeros(len(hashes), bool)
    out[np.unique(hashes, return_index=True)[1]] = True
    return out


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a bucket, with each column's values as bytes."""
    order = np.argsort(bucket, kind="stable")
    keys, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    out = {"bucket": pa.array(keys.astype(np.int32))}
    for name, values in columns.items():
        values = values[order]
        out[name] = pa.array([values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _whole(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _runs(*ids: np.ndarray) -> np.ndarray:
    """Starts of runs in which each array stays equal."""
    if not len(ids[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(ids[0]), bool)
    change[0] = True
    for x in ids:
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def levels(length: int, least: int = 5) -> list[int]:
    """Window lengths by doubling up to `length`, the first of about `least` words."""
    out = [length]
    while out[0] >= 2 * least or len(out) == 1:
        out.insert(0, max(1, -(-out[0] // 2)))
    return out


def n_buckets(total: int) -> int:
    """Buckets for a corpus of `total` bytes: one for 16 MB, from 64 GB of text on ever larger ones up to 128 MB."""
    return max(8, min(-(-total // (16 << 20)), 4_096), -(-total // (128 << 20)))


def _expanded(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of runs of n from p on, and which run each is in."""
    of = np.repeat(np.arange(len(p)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + p[of], of


def repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, starts array<int>, counts array<int>): runs of `counts` windows from `starts` on that occur earlier."""
    if length < 2:
        raise ValueError("length must be 2 or more")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    buckets = n_buckets(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    *lower, _ = levels(length)
    half, span = lower[-1], length - lower[-1] + 1

    def level(size: int) -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids = batch.column(0).to_numpy()
            hashes, _, _, first = words_of(*text_bytes(batch.column(1)))
            if batch.num_columns == 2:
                starts, rows = _valid_starts(first, length)
            else:
                row = np.repeat(np.arange(len(ids)), np.diff(batch.column(2).offsets.to_numpy()))
                starts, of = _expanded(*(batch.column(c).flatten().to_numpy() for c in (2, 3)))
                rows = row[of]
                starts = starts + first[rows]
            if not len(starts):
                return None
            small = windows_of(hashes, size)
            at = _minimizers(small, length - size + 1)[starts]
            run = _runs(rows, at, starts - np.arange(len(starts)))
            n = np.diff(np.append(run, len(starts)))
            key = small[at[run]]
            _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
            again, leads = counts[where] > 1, _first_of(key)
            bucket = np.where(leads, key % np.uint64(buckets), np.arange(len(key), dtype=np.uint64) % np.uint64(buckets))
            # 0: the hash's only occurrence here, 1: its first of several here, 2: a later one, known to be a repeat
            state = np.where(again, np.where(leads, 1, 2), 0).astype(np.uint8)
            row = rows[run]
            return _packed(bucket, {"h": key, "doc": ids[row], "p": (starts[run] - first[row]).astype(np.int32), "n": n.astype(np.int32), "state": state})

        return f

    def survivors(group: pa.Table) -> pa.Table:
        h, doc, p, n, state = (_whole(group.column(k), t) for k, t in (("h", np.uint64), ("doc", np.int64), ("p", np.int32), ("n", np.int32), ("state", np.uint8)))
        keep = state > 0
        here = np.flatnonzero(state < 2)
        _, where, counts = np.unique(h[here], return_inverse=True, return_counts=True)
        keep[here] |= counts[where] > 1
        return pa.table({"doc_id": doc[keep], "p": p[keep], "n": n[keep]})

    by_doc, source = None, texts
    for size in lower:
        found = map_batches(source, level(size), "bucket int, h binary, doc binary, p binary, n binary, state binary")
        candidates = found.groupBy("bucket").applyInArrow(survivors, "doc_id bigint, p int, n int")
        by_doc = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("runs")).select("doc_id", "runs.p", "runs.n")
        source = texts.join(by_doc, "doc_id").select("doc_id", "text", "p", "n")

    def full_length(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column(0).to_numpy()
        hashes, _, _, first = words_of(*text_bytes(batch.column(1)))
        p, n = batch.column(2), batch.column(3)
        row = np.repeat(np.arange(len(ids)), np.diff(p.offsets.to_numpy()))
        p, n = p.flatten().to_numpy(), n.flatten().to_numpy()
        start = first[row] + p
        small = windows_of(hashes, half)
        key = small[_minimizers(small, span)[start]] if len(start) else np.zeros(0, np.uint64)
        step, of = _expanded(np.zeros_like(p), n)
        full = windows_of(hashes, length)[start[of] + step]
        order = np.lexsort((p[of] + step, ids[row[of]]))
        of, step, full = of[order], step[order], full[order]
        lead = _first_of(full)
        run = _runs(of, np.where(lead, 0, 1), step - np.arange(len(step)))
        size = np.diff(np.append(run, len(step)))
        is_lead = lead[run]
        bucket = np.where(is_lead, key[of[run]] % np.uint64(buckets), np.arange(len(run), dtype=np.uint64) % np.uint64(buckets))
        # hashes of runs that are known repeats don't travel
        ends = np.cumsum(size)
        blobs = [full[e - s : e].tobytes() if k else b"" for e, s, k in zip(ends, size, is_lead, strict=True)]
        out = _packed(bucket, {"doc": ids[row[of[run]]], "p": (p[of[run]] + step[run]).astype(np.int32), "n": size.astype(np.int32), "lead": is_lead.astype(np.uint8)})
        by = np.argsort(bucket, kind="stable")
        cuts = np.append(np.unique(bucket[by], return_index=True)[1], len(by))
        full_by = pa.array([b"".join(blobs[i] for i in by[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([*out.columns, full_by], [*out.schema.names, "h"])

    def later(group: pa.Table) -> pa.Table:
        doc, p, n, lead, h = (_whole(group.column(k), t) for k, t in (("doc", np.int64), ("p", np.int32), ("n", np.int32), ("lead", np.uint8), ("h", np.uint64)))
        known = lead == 0
        kd, kp, kn = doc[known], p[known], n[known]
        doc, p, n = doc[~known], p[~known], n[~known]
        at, of = _expanded(p, n)
        d = doc[of]
        order = np.lexsort((at, d, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        d, at = d[again], at[again]
        order = np.lexsort((at, d))
        d, at = d[order], at[order]
        run = _runs(d, at - np.arange(len(at)))
        size = np.diff(np.append(run, len(at)))
        return pa.table({"doc_id": np.concatenate([kd, d[run]]), "p": np.concatenate([kp, at[run]]).astype(np.int32), "n": np.concatenate([kn, size]).astype(np.int32)})

    extended = map_batches(source, full_length, "bucket int, doc binary, p binary, n binary, lead binary, h binary")
    repeated = extended.groupBy("bucket").applyInArrow(later, "doc_id bigint, p int, n int")
    return repeated.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("runs")).select("doc_id", F.col("runs.p").alias("starts"), F.col("runs.n").alias("counts"))


def removed_mask(n_words: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which words are covered by windows of `length` from starts to starts + counts - 1."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, length: int = 20, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, as `kept` or its `kept_sha256`."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    both = texts.join(repeats(docs, length), "doc_id", "left").select("doc_id", "text", "starts", "counts")
    name = "kept_sha256" if digest else "kept"

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, starts, counts in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            gone = 0
            if starts.is_valid:
                mask = removed_mask(len(words), starts.values.to_numpy(), counts.values.to_numpy(), length)
                gone = int(mask.sum())
                words = compress(words, ~mask)
            n_removed.append(gone)
            left = b" ".join(words)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", name])

    return map_batches(both, f, f"doc_id bigint, n_words bigint, n_removed bigint, {name} string")
