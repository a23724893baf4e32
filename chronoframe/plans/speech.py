"""Queries over speech as a table function and as a stream, open records, and texts that are alike by bounds."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import open_records
from ..operators import alike, audio, gate
from ..providers import speech
from ..session import shared_folder
from ..sources import bindings as b
from ..streaming import audio as stream_audio
from . import relations, scalars  # noqa: F401  their SQL is used again
from .registry import ORACLES, query

_WORD = re.compile(r"[^ \t\n\r\f\x0b]+")


def _say(content: bytes) -> list[tuple[float, float, str]]:
    """Stands for a recognizer: a clip of text is one segment of 0.4 seconds a word."""
    said = content.decode()
    return [(0.0, len(_WORD.findall(said)) * 0.4, said)]


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """conversations: a turn is a clip of a conversation's audio, at 5 seconds a turn."""
    return b.table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), (F.col("turn") * 5.0).alias("offset"), F.encode("text", "UTF-8").alias("content"))


@query("""SELECT s.video_id, s.frame_number, coalesce(string_agg(trim(g.text), ' ' ORDER BY g."start", g."end", trim(g.text)), '') AS audio_text
    FROM spoken s LEFT JOIN segments g ON g.video_id = s.video_id AND g."start" <= s.timestamp + 5.0 AND g."end" >= s.timestamp - 5.0 GROUP BY s.video_id, s.frame_number""", "spoken", "segments")
def j01_table_function(spark, d):
    heard = speech.spoken(_clips(spark, d), _say)
    return audio.with_audio(b.spoken_keyframes(spark, d), heard).select("video_id", "frame_number", "audio_text")


@query(r"""SELECT video_id, count(*) AS segments, sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')))::BIGINT AS words FROM segments WHERE text IS NOT NULL GROUP BY video_id""", "segments")
def a09_lateral_function(spark, d):
    return audio.transcript_stats(speech.lateral(_clips(spark, d), _say))


@query(ORACLES.get("j01_audio_context"))
def j01_late_stream(spark, d):
    """Speech next to frames from two streams, in any order under a watermark of two hours."""
    folder = os.path.join(shared_folder(spark), "tables", spark.sparkContext.applicationId, f"speech-{uuid.uuid4().hex}")
    began = lambda x: F.timestamp_micros(F.lit(1_704_067_200_000_000) + (x * 1e6).cast("bigint"))  # noqa: E731  every video begins at one time
    frames = b.spoken_keyframes(spark, d).withColumn("event_time", began(F.col("timestamp")))
    segments = b.segments(spark, d).drop("turn").withColumn("event_time", began(F.col("start")))
    late = F.expr("INTERVAL 1000 DAYS")
    streams = {}
    for name, rows, of in (("frames", frames, "frame_number"), ("segments", segments, "start")):
        for k in range(2):
            rows.where(F.pmod(F.xxhash64("video_id", of), F.lit(2)) == k).write.parquet(f"{folder}/{name}/part={k}")
        # a row from long after all others lets the watermark pass them
        rows.limit(1).withColumn("event_time", F.col("event_time") + late).withColumn("video_id", F.lit(-1).cast(rows.schema["video_id"].dataType)).coalesce(1).write.parquet(f"{folder}/{name}/part=2")
        streams[name] = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(f"{folder}/{name}")
    provider, key = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        heard = stream_audio.with_audio(streams["frames"], streams["segments"], "2 hours")
        heard.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, had)
    return spark.read.schema(heard.schema).parquet(f"{folder}/out").where("video_id >= 0").select("video_id", "frame_number", "audio_text")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers made up from events, in five forms: a string for a list and an unknown key, nulls, other types, nothing, no JSON."""
    n, k = F.col("frame_number"), F.col("frame_number") % 5
    content = (
        F.when(k == 0, F.concat(F.lit('{"main_subject": "'), "event_type", F.lit('", "people": "x", "rating": '), n.cast("string"), F.lit("}")))
        .when(k == 1, '{"main_subject": null, "people": [{"description": "d"}], "actions": []}')
        .when(k == 2, F.concat(F.lit('```json\n{"main_subject": '), n.cast("string"), F.lit(', "people": null, "extracted_text": "'), "extracted_text", F.lit('"}\n```')))
        .when(k == 3, "{}")
        .otherwise("no answer")
    )
    return b.frames(spark, d).select("frame_number", open_records.open_record(content, F.col("timestamp")).alias("r"))


@query("""SELECT frame_number, CASE k WHEN 0 THEN '"x"' WHEN 1 THEN '[{"description":"d"}]' WHEN 2 THEN 'null' END AS people, CASE k WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE 0 END::INT AS people_count,
    k IN (1, 4) AS has_people, k = 4 AS has_actions, CASE WHEN k = 0 THEN frame_number END AS rating FROM (SELECT *, frame_number % 5 AS k FROM frames)""", "frames")
def p13_open_lists(spark, d):
    people = F.when(~F.col("r.is_fallback"), open_records.as_json(open_records.field(F.col("r"), "people")))
    rating = F.try_variant_get(open_records.field(F.col("r"), "rating"), "$", "bigint")
    return _answers(spark, d).select("frame_number", people.alias("people"), "r.people_count", "r.has_people", "r.has_actions", rating.alias("rating"))


@query("""SELECT frame_number, CASE k WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN 'null' WHEN 2 THEN frame_number::VARCHAR WHEN 3 THEN '"Video content"' ELSE '"Video content showing visual scene"' END AS main_subject,
    CASE k WHEN 1 THEN 'null' WHEN 2 THEN 'BIGINT' ELSE 'STRING' END AS kind, CASE WHEN k = 4 THEN '"video"' ELSE '"other"' END AS scene_type,
    CASE WHEN k = 2 THEN extracted_text ELSE '' END AS text_content, CASE WHEN k = 2 AND extracted_text <> '' THEN 1 ELSE 0 END::INT AS words FROM (SELECT *, frame_number % 5 AS k FROM frames)""", "frames")
def p14_open_defaults(spark, d):
    of = lambda name: open_records.field(F.col("r"), name)
    return _answers(spark, d).select(
        "frame_number",
        open_records.as_json(of("main_subject")).alias("main_subject"),
        open_records.kind(of("main_subject")).alias("kind"),
        open_records.as_json(of("scene_type")).alias("scene_type"),
        F.try_variant_get(of("text_content"), "$", "string").alias("text_content"),
        F.col("r.ocr_word_count").alias("words"),
    )


@query(ORACLES.get("p05_text_differs"))
def p05_ratio_differs(spark, d):
    """Texts differ where their ratio is under 0.85; the texts of the frames are alike only if they are equal."""
    prior = F.coalesce(F.lag("extracted_text").over(gate.in_time()), F.lit(""))
    rows = b.frames(spark, d).select("frame_number", "extracted_text", prior.alias("prior"))
    return alike.with_alike(rows, "extracted_text", "prior", 0.85).select("frame_number", (~F.col("alike")).alias("differs"))


@query(ORACLES.get("p09_flicker_exact"))
def p09_flicker_ratio(spark, d):
    return alike.flicker(b.frames(spark, d)).select("frame_number", "flicker")


@query()
def f05_alike_turns(spark, d):
    """Whether a turn's text is alike the one before it, and whether a bound decided that; a test holds it against difflib."""
    rows = b.segments(spark, d).withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("video_id").orderBy("turn")), F.lit("")))
    rows = rows.withColumn("by_bound", alike.decided(F.col("text"), F.col("before"), 0.85).isNotNull())
    return alike.with_alike(rows, "text", "before", 0.85).select("video_id", "turn", "alike", "by_bound")
