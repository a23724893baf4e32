"""The network against plain loops and finite differences."""

import numpy as np
import pyarrow as pa
import pytest

from chronoframe.llm import quality
from chronoframe.llm.common import text_bytes

TEXTS = ["", "a", "short", "twelve bytes", "thirteen byte", "é" * 9, "The quick brown fox. " * 40, "x" * 700, "mixed \n text 0123 " * 61]


def plain_score(net, text):
    """Windows one by one: embedding, filters, rectifier, maxima of chunks, then their maximum and mean."""
    body = list(text.encode())
    starts = [0]
    while starts[-1] + quality.WIDTH < len(body):
        starts.append(min(starts[-1] + quality.STRIDE, len(body) - quality.WIDTH))
    out = []
    for a in starts:
        codes = body[a : a + quality.WIDTH] + [quality.PAD] * (quality.WIDTH - len(body[a : a + quality.WIDTH]))
        out.append(np.maximum(np.concatenate([net.embedding[c] for c in codes]) @ net.filters + net.offset, 0))
    tops = [np.max(out[i : i + quality.CHUNK], axis=0) for i in range(0, len(out), quality.CHUNK)]
    z = np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)]) @ net.weights + net.bias[0] + net.prior
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("at_once", [1 << 16, 1])
def test_scores_are_plain_loops(monkeypatch, at_once):
    monkeypatch.setattr(quality, "AT_ONCE", at_once)
    net = quality.Network(3)
    net.offset += np.random.default_rng(1).normal(0, 0.1, quality.FILTERS).astype(np.float32)
    net.prior = 0.3
    assert np.allclose(net.scores(*text_bytes(pa.array(TEXTS))), [plain_score(net, t) for t in TEXTS], atol=1e-5)


def test_every_byte_is_in_a_window():
    net = quality.Network(3)
    for n in (1, 11, 12, 13, 15, 16, 17, 500, 5_000):
        starts, ends, _, _ = net._layout(np.array([0, n]))
        seen = np.zeros(n, bool)
        for a, b in zip(starts, ends, strict=True):
            seen[a : min(a + quality.WIDTH, b)] = True
        assert seen.all()


def test_gradients_are_finite_differences():
    net = quality.Network(5)
    texts, labels, share = [t.encode() for t in TEXTS[2:]], np.array([0, 1, 1, 0, 1, 0, 1]), np.array([0.8, 1.2])
    for name in ("embedding", "filters", "offset", "weights", "bias"):  # doubles, or differences drown
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        body, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        starts, ends, chunk, first = net._layout(offsets)
        out = net._respond(net._codes(body, starts, ends))
        top = np.maximum(np.maximum.reduceat(out, chunk, axis=0), 0)
        p = 1 / (1 + np.exp(-(net.features(top, first) @ net.weights + net.bias)))
        return float((-(labels * np.log(p) + (1 - labels) * np.log(1 - p)) * share[labels]).mean())

    rng = np.random.default_rng(2)
    for p, g in zip(net.parameters, net._gradients(texts, labels, share), strict=True):
        used = np.flatnonzero(np.abs(g.ravel()) > 1e-6)
        for i in rng.choice(used, min(12, len(used)), replace=False):
            old, step = p.flat[i], 1e-6
            p.flat[i] = old + step
            up = loss()
            p.flat[i] = old - step
            down = loss()
            p.flat[i] = old
            assert abs((up - down) / (2 * step) - g.flat[i]) < 1e-3 * max(1, abs(g.flat[i])) + 1e-5


def test_gradients_do_not_depend_on_slices(monkeypatch):
    net, texts = quality.Network(5), [t.encode() * 40 for t in TEXTS[2:]]
    labels, share = np.array([0, 1, 1, 0, 1, 0, 1]), np.array([0.8, 1.2])
    want = net._gradients(texts, labels, share)
    monkeypatch.setattr(quality, "AT_ONCE", 150)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(net._gradients(texts, labels, share), want, strict=True))


def test_training_reads_whole_texts(spark):
    """What tells the classes apart stands in one place of long texts only."""
    filler = "the same words in every text of this table and nothing else to be seen "
    texts = [(i, filler * 20 + ("ZZZZ####QQQQ@@@@" if i % 2 else "") + filler * (20 + i % 5)) for i in range(160)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    net = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id bigint, quality int"))
    found = quality.score(docs, net).where("held_out").collect()
    assert len(found) > 20 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in found)


def test_a_very_long_text_takes_linear_time():
    import time

    net, body = quality.Network(3), np.full(8_000_000, 97, np.uint8)
    start = time.perf_counter()
    net.scores(body, np.array([0, len(body)]))
    assert time.perf_counter() - start < 60
