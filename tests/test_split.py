"""Samplers with a video dealt over tasks give the rows of one pass over it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import sampling, split

FRAMES = "video_id string, frame_number bigint, timestamp double"


def plain(rows, step, kind):
    """One loop over each video's sorted frames."""
    by, out = {}, []
    for v, n, t in rows:
        if t is not None and abs(t) < float("inf"):
            by.setdefault(v, []).append((t, n))
    for v, own in by.items():
        last = due = None
        for t, n in sorted(own):
            if last is None or (t >= due if kind == "sampled" else t - last >= step):
                due = step if last is None else t + step
                last = t
                out.append((v, n, t))
    return sorted(out, key=str)


def times(kind, n, rng):
    if kind == "even":
        return [k / 30 for k in range(n)]
    if kind == "tenths":  # sums and differences of these round differently
        return [k * 0.1 for k in range(n)]
    if kind == "gaps":
        return list(np.cumsum([rng.choice([0.0, 0.01, 0.4, 3.0, 90.0]) for _ in range(n)]))
    if kind == "late":  # begins after the first check is due, more than one frame at once
        return [50.0, 50.0, 50.0, *(50 + k * 0.3 for k in range(n))]
    return [-20 + k * 0.7 for k in range(n)] + [-19.3, -5.0, -5.0]


@pytest.mark.parametrize("kind", ["even", "tenths", "gaps", "late", "negative"])
@pytest.mark.parametrize("name", ["sampled", "spaced"])
def test_functions_compose_to_the_loop(kind, name):
    """Without Spark: runs of all sizes, composed in any grouping, then handed down."""
    rng = random.Random(3)
    step, virtual = 1.0, 0.0 if name == "sampled" else None
    late = (lambda t, last: t >= last + step) if name == "sampled" else (lambda t, last: t - last >= step)
    own = sorted(times(kind, 400, rng))
    kept = [t for *_, t in sorted(plain([("v", k, t) for k, t in enumerate(own)], step, name), key=lambda r: (r[2], r[1]))]
    for width in (2.0, 7.0, 300.0):
        runs = {}
        for t in own:
            runs.setdefault(int(np.floor(t / width)), []).append(t)
        parts = []
        for r in sorted(runs):
            u, n = np.unique(runs[r], return_counts=True)
            parts.append(split.function_of(u, step, late, virtual, bool(n[0] > 1)))
        grouped = [split.composed(parts[i : i + 3], step, late) for i in range(0, len(parts), 3)]
        for some in (parts, grouped, [split.composed(grouped, step, late)]):
            last = some[0][3]
            for upto, out, _, _ in some[1:]:
                last = float(split.applied(upto, out, np.array([last]), step, late)[0])
            assert last == (kept[-1] if len(kept) > 1 or virtual is None else virtual)


@pytest.mark.parametrize("kind", ["late", "negative"])
def test_split_is_one_pass(spark, monkeypatch, kind):
    monkeypatch.setattr(split, "SPAN", 4)
    monkeypatch.setattr(split, "FAN", 2)
    rng = random.Random(5)
    rows = [(v, k, float(t)) for v in ("a", "b", None) for k, t in enumerate(times(kind, 300, rng))]
    rows += [("a", 900, None), ("a", 901, float("nan")), ("a", 902, float("inf")), ("c", 1, 7.5), ("d", 2, 0.0), ("d", 1, 0.0), ("d", 3, 1.0)]
    df = spark.createDataFrame(rows, FRAMES).repartition(3)
    key = lambda found: sorted(map(tuple, found.select("video_id", "frame_number", "timestamp").collect()), key=str)
    assert key(split.sampled(df, 1.0)) == plain(rows, 1.0, "sampled")
    assert key(split.spaced(df, 1.0)) == plain(rows, 1.0, "spaced")
    assert split.sampled(df.where("false"), 1.0).count() == 0
    with pytest.raises(ValueError):
        split.spaced(df, 0.0)


def test_one_video_of_a_million_frames(spark):
    """The same rows as one task's pass, from many tasks of about one size."""
    df = spark.range(1_000_000).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_number"), (F.col("id") / 30 + F.pmod(F.xxhash64("id"), F.lit(97)) / 97e3).alias("timestamp"))
    found = split.sampled(df, 1.0)
    assert found.exceptAll(sampling.sampled(df, 1.0)).count() == 0 and found.count() > 30_000
    runs = df.groupBy(F.floor(F.col("timestamp") / split.SPAN).alias("run")).agg(F.count("*").alias("n")).agg(F.max("n"), F.avg("n"), F.count("*")).first()
    assert runs[0] < 1.5 * runs[1] and runs[2] > 100  # what one function, and one decision, sees of the video
