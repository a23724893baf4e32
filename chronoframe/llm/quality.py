"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping windows that cover the whole document, the last one ending with
it. Their rectified outputs are max-pooled within chunks of windows, then over the chunks (by maximum and by mean), and
a logistic unit combines what is pooled into one probability.

The network is fitted on the driver to the whole texts of at most `per_class` labelled documents of each class, the first
by a hash of their ids. This bound holds at every size; training and scoring read every byte. Windows are computed
`AT_ONCE` at a time, and gradients only for the windows that made the maxima. Only texts are inputs of a score.

Defined results: null and empty texts are scored as one window of padding; texts count whole; documents without a label
or with a label other than 0 and 1 aren't learned from; without labels of both classes every score is the share of
label 1 (0.5 without any); extra columns are ignored by `score` and kept by `accepted`; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, drawn, map_batches, text_bytes

WIDTH, STRIDE, DEPTH, FILTERS = 12, 4, 8, 16
#: Windows in a chunk, and windows computed at once.
CHUNK, AT_ONCE = 128, 1 << 16
PAD = 256


class Network:
    """Parameters, scores and training."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32)
        self.embedding[PAD] = 0
        self.filters = rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.prior = 0.0  # log odds of label 1 among all labelled documents; training weights both classes alike

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.offset, self.weights, self.bias]

    def _layout(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows' starts, ends of their documents, starts of chunks among windows, first chunk of each document."""
        size = np.diff(offsets)
        n = np.maximum(1, -(-np.maximum(size - WIDTH, 0) // STRIDE) + 1)
        first = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(first, n)
        begin, last = np.repeat(offsets[:-1], n), np.repeat(np.maximum(size - WIDTH, 0), n)
        chunks = -(-n // CHUNK)
        chunk_first = np.cumsum(chunks) - chunks
        step = np.arange(chunks.sum()) - np.repeat(chunk_first, chunks)
        return begin + np.minimum(k * STRIDE, last), np.repeat(offsets[1:], n), np.repeat(first, chunks) + step * CHUNK, chunk_first

    def _codes(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        base = starts[0]  # starts rise, so a stretch of the body holds all windows
        part = np.append(body[base : starts[-1] + WIDTH], np.uint8(0)).astype(np.int16)
        at = starts[:, None] + np.arange(WIDTH)
        codes = part[np.minimum(at - base, len(part) - 1)]
        return np.where(at < ends[:, None], codes, PAD) if (starts + WIDTH > ends).any() else codes

    def _respond(self, codes: np.ndarray) -> np.ndarray:
        return self.embedding[codes].reshape(len(codes), -1) @ self.filters + self.offset

    def pooled(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks' maxima of rectified responses, and each document's first chunk."""
        starts, ends, chunk, first = self._layout(offsets)
        top = np.zeros((len(chunk), FILTERS), np.float32)
        edges = np.append(chunk, len(starts))
        for a, b in self._slices(edges):
            part = slice(edges[a], edges[b])
            top[a:b] = np.maximum.reduceat(self._respond(self._codes(body, starts[part], ends[part])), chunk[a:b] - edges[a], axis=0)
        return np.maximum(top, 0), first

    @staticmethod
    def _slices(edges: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of chunks of about `AT_ONCE` windows; edges: where chunks begin, and the end."""
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + AT_ONCE, "right")) - 1)
            yield a, b
            a = b

    def features(self, top: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(first, len(top)))
        return np.concatenate([np.maximum.reduceat(top, first, axis=0), np.add.reduceat(top, first, axis=0) / n[:, None]], axis=1)

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        z = self.features(*self.pooled(body, offsets)).astype(np.float64) @ self.weights.astype(np.float64) + float(self.bias[0]) + self.prior
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Network:
        """Adam on cross-entropy with both classes weighted alike; gradients reach the windows that made the maxima."""
        rng = np.random.default_rng(seed)
        share = np.array([0.5 / max((labels == c).mean(), 1e-9) for c in (0, 1)])
        m, v, t = [np.zeros_like(p) for p in self.parameters], [np.zeros_like(p) for p in self.parameters], 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                t += 1
                grads = self._gradients([texts[i] for i in own], labels[own], share)
                for i, (p, g) in enumerate(zip(self.parameters, grads, strict=True)):
                    g = g + decay * p
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
                self.embedding[PAD] = 0
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
        body = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.append(0, np.cumsum([len(x) for x in texts]))
        starts, ends, chunk, first = self._layout(offsets)
        edges, at, top = np.append(chunk, len(starts)), np.zeros((len(chunk), FILTERS), np.int64), np.zeros((len(chunk), FILTERS), np.float32)
        for a, b in self._slices(edges):
            part = slice(edges[a], edges[b])
            out = self._respond(self._codes(body, starts[part], ends[part]))
            own = edges[a : b + 1] - edges[a]
            at[a:b] = np.stack([i + out[i:j].argmax(axis=0) for i, j in zip(own, own[1:], strict=False)])
            top[a:b] = np.maximum(np.take_along_axis(out, at[a:b], axis=0), 0)
            at[a:b] += edges[a]
        x = self.features(top, first)
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))
        dz = ((p - labels) * share[labels] / len(labels)).astype(np.float32)
        dx = dz[:, None] * self.weights
        n = np.diff(np.append(first, len(top)))
        doc = np.repeat(np.arange(len(n)), n)
        dtop = (dx[:, FILTERS:] / n[:, None])[doc].copy()
        # of chunks that tie for a document's maximum one gets its gradient
        best = np.stack([a + top[a : a + k].argmax(axis=0) for a, k in zip(first, n, strict=True)])
        np.add.at(dtop, (best, np.arange(FILTERS)), dx[:, :FILTERS])
        dtop *= top > 0
        g_filters, g_embedding = np.zeros_like(self.filters), np.zeros_like(self.embedding)
        for f in range(FILTERS):
            seen = self._codes(body, starts[at[:, f]], ends[at[:, f]])  # chunks follow one another, so these rise
            g_filters[:, f] = dtop[:, f] @ self.embedding[seen].reshape(len(seen), -1)
            np.add.at(g_embedding, seen, dtop[:, f, None, None] * self.filters[:, f].reshape(WIDTH, DEPTH))
        return [g_embedding, g_filters, dtop.sum(axis=0), (dz @ x).astype(np.float32), dz.sum(keepdims=True)]


class Constant(Network):
    """One score for all; stands in where there is nothing to learn from."""

    def __init__(self, score: float) -> None:
        super().__init__()
        self.score = score

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.score)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 600) -> Network:
    """A network fitted to whole texts of a bounded sample of labelled rows, none of them held out (crc32 of the id modulo 4 is 2)."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_bucket(F.col("doc_id"), 4) != 2)).select(F.col("doc_id").cast("bigint").alias("id"), "quality").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}  # two rows
    chosen = None
    for c in (0, 1):
        own = drawn(known.where(F.col("quality") == c), "id", per_class, counts.get(c, 0))
        chosen = own if chosen is None else chosen.unionByName(own)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("body"))
    rows = sample.join(F.broadcast(chosen), "id").orderBy("id").collect()  # per_class rows of a class at most
    quality = np.array([r["quality"] for r in rows], np.int64)
    if len(set(quality.tolist())) < 2:
        return Constant(float(quality.mean()) if len(quality) else 0.5)
    network = Network().fit([bytes(r["body"]) for r in rows], quality)
    network.prior = float(np.log(counts[1] / counts[0]))
    return network


def score(docs: DataFrame, network: Network, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = network.scores(*text_bytes(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), f, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, network: Network, threshold: float = 0.7) -> DataFrame:
    """The rows, with all columns, whose text scores `threshold` or more; nothing is shuffled."""
    at = docs.columns.index("text")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(network.scores(*text_bytes(batch.column(at))) >= threshold))

    return map_batches(docs, f, docs.schema)
