"""Frames that come late: within the watermark the order of arrival makes no difference."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronoframe.config import Settings
from chronoframe.operators import gate
from chronoframe.streaming import gate as stream

from .test_operators import random_frames

FRAMES = "video_id string, frame_number bigint, timestamp double, extracted_text string, pixel_pct double, event_time timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def with_time(rows):
    """A video begins a minute after the one before it."""
    return [(*r, START + datetime.timedelta(seconds=60 * int(r[0][1:]) + r[2])) for r in rows]


def arriving(spark, folder, batches, late):
    """The micro-batches, then rows from long after, which push the watermark over all frames."""
    for k, batch in enumerate([*batches, [("end", 0, 0.0, "", 0.0, START + datetime.timedelta(days=9))], *late]):
        spark.createDataFrame(batch, FRAMES).coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(spark, tmp_path, frames, delay, settings, name):
    query = stream.late_gate(frames, delay, slot=2.0, settings=settings).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return sorted((r.video_id, r.frame_number, r.decision, r.change_type, r.reason, r.accepted) for r in spark.table(name).where("video_id <> 'end'").collect()), dropped


def key(df):
    return sorted((r.video_id, r.frame_number, r.decision, r.change_type, r.reason, r.accepted) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_frames_give_the_batch_gate_s_rows(spark, tmp_path, seed):
    rng, settings = random.Random(seed), Settings(sample_interval=1.0)
    rows = with_time(random_frames(seed))
    arrival = sorted(rows, key=lambda r: (r[5] - START).total_seconds() + rng.random() * 25)
    batches = [arrival[k : k + 33] for k in range(0, len(arrival), 33)]
    assert any(a[5] > b[5] and a[0] == b[0] for x, y in zip(batches, batches[1:], strict=False) for a in x for b in y)  # some are late
    frames = arriving(spark, str(tmp_path / f"in{seed}"), batches, [])
    found, dropped = run(spark, tmp_path, frames, "2 minutes", settings, f"late{seed}")
    batch = gate.gate(spark.createDataFrame(rows, FRAMES), settings)
    assert found == key(batch) and dropped == 0 and batch.where("accepted").count() > 4


def test_what_comes_too_late_is_dropped_and_counted(spark, tmp_path):
    rows = with_time(random_frames(3))
    batches = [rows[k::3] for k in range(3)]
    # Spark holds rows against the watermark of the batch before, so one more batch has to pass
    late = [[("end", 1, 1.0, "", 0.0, START + datetime.timedelta(days=9))], [("v0", 999, 0.05, "late text", 1.0, START)]]
    found, dropped = run(spark, tmp_path, arriving(spark, str(tmp_path / "in"), batches, late), "5 minutes", Settings(), "toolate")
    assert found == key(gate.gate(spark.createDataFrame(rows, FRAMES))) and dropped == 1


def test_a_stream_that_is_stopped_goes_on(spark, tmp_path):
    rows = with_time(random_frames(4))
    folder, settings = str(tmp_path / "in"), Settings()
    # without a row that ends it: what is undecided waits in the checkpoint
    spark.createDataFrame(rows[::2], FRAMES).coalesce(1).write.parquet(f"{folder}/part=0")
    frames = spark.readStream.schema(FRAMES).option("recursiveFileLookup", "true").parquet(folder)
    out = str(tmp_path / "out")

    def once():
        stream.late_gate(frames, "5 minutes", slot=2.0, settings=settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(300)

    once()
    assert spark.read.parquet(out).count() == 0
    spark.createDataFrame(rows[1::2], FRAMES).coalesce(1).write.parquet(f"{folder}/part=1")
    once()
    spark.createDataFrame([("end", 0, 0.0, "", 0.0, START + datetime.timedelta(days=9))], FRAMES).coalesce(1).write.parquet(f"{folder}/part=2")
    once()
    assert key(spark.read.parquet(out).where("video_id <> 'end'")) == key(gate.gate(spark.createDataFrame(rows, FRAMES), settings))


def test_gate_over_small_batches_and_long_videos(spark):
    """Carried from batch to batch, the gate gives what it gives over whole videos."""
    rng = random.Random(7)
    texts = ["", "intro", "intro slide", "agenda", "Agenda ", "agenda item", "thanks"]
    rows = [(f"v{k % 3}", k, k * 0.21, rng.choice(texts), rng.random(), START) for k in range(3000)] + [("v0", 9999, None, "x", 0.0, START)]
    want = []
    for v in range(3):
        own = [{"video_id": r[0], "frame_number": r[1], "timestamp": r[2], "extracted_text": r[3], "pixel_pct": r[4]} for r in rows if r[0] == f"v{v}" and r[2] is not None]
        want += [(x["video_id"], x["frame_number"], x["decision"], x["change_type"], x["reason"], x["accepted"]) for x in gate.decisions_of(own)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert key(gate.gate(spark.createDataFrame(rows, FRAMES).repartition(5))) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = gate.gate(spark.createDataFrame(rows, FRAMES).withColumn("thumb", F.lit(None).cast("binary")))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_videos_share_keys_of_the_state(spark, tmp_path):
    """Calls to the state store are for keys, of which there are two here, not for videos."""
    rows = with_time(random_frames(5))
    frames = arriving(spark, str(tmp_path / "in"), [rows[k::3] for k in range(3)], [])
    query = stream.late_gate(frames, "5 minutes", slot=2.0, keys=2).writeStream.format("memory").queryName("shared").option("checkpointLocation", str(tmp_path / "shared")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert key(spark.table("shared").where("video_id <> 'end'")) == key(gate.gate(spark.createDataFrame(rows, FRAMES)))
