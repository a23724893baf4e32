"""The engine's entities read from the generic tables: events as frames, conversations as speech, embeddings as keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import node_id

#: Places a video's rows in one order over all videos: video number times this, plus frame number.
ORD_STEP = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user's events are a video's frames, in seconds since its first."""
    own = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = F.min("us").over(Window.partitionBy("user_id"))
    return own.select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("frame_number"),
        ((F.col("us") - first) / 1e6).alias("timestamp"),
        F.when(F.col("event_type").isin("view", "click"), "").otherwise(F.col("event_type")).alias("extracted_text"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("pixel_pct"),
        "event_type",
        "value",
        "props",
    )


def durations(frames_: DataFrame) -> DataFrame:
    return frames_.groupBy("video_id").agg(F.max("timestamp").alias("duration"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: a turn starts every 5 seconds and lasts 0.4 seconds a word."""
    own = table(spark, sf_dir, "conversations")
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    return own.select(F.col("conv_id").alias("video_id"), "turn", (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + words * 0.4).alias("end"), "text")


def spoken_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("frame_number"), (F.col("turn") * 5.0 + 2.0).alias("timestamp")).distinct()


def vectors(spark: SparkSession, sf_dir: str, documents: bool = False) -> DataFrame:
    """embeddings: a label is a video, a vector a keyframe at as many seconds as its id; with their documents if wanted."""
    own, texts = table(spark, sf_dir, "embeddings"), []
    if documents:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
        own = own.join(docs, F.col("doc_id") == F.col("vec_id"), "left")
        texts = [F.coalesce("text", F.lit("")).alias("document"), "source", "lang"]
    return own.select(
        node_id(F.col("label"), F.col("vec_id")).alias("id"),
        F.col("label").cast("bigint").alias("video_id"),
        F.col("vec_id").alias("frame_number"),
        (F.col("vec_id") * 1.0).alias("timestamp"),
        *texts,
        F.col("embedding").cast("array<double>").alias("embedding"),
        (F.col("label").cast("bigint") * ORD_STEP + F.col("vec_id")).alias("ord"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes of the vectors; reads neither texts nor vectors."""
    own = table(spark, sf_dir, "embeddings")
    return own.select(node_id(F.col("label"), F.col("vec_id")).alias("id"), F.col("label").cast("bigint").alias("video_id"), F.col("vec_id").alias("frame_number"), (F.col("vec_id") * 1.0).alias("timestamp"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description model's answers, made up from events: refusals, nothing, and JSON in several wrappings."""
    own = frames(spark, sf_dir)
    body = F.concat(F.lit('{"main_subject": "'), F.col("event_type"), F.lit('", "extracted_text": "'), F.col("extracted_text"), F.lit('", "people": ['), F.when(F.col("value") >= 50, F.concat(F.lit('{"description": "p'), (F.col("frame_number") % 7).cast("string"), F.lit('", "action": "walks"}'))).otherwise(""), F.lit('], "actions": ['), F.when(F.col("value") >= 80, '"x", "y"').otherwise(""), F.lit("]}"))
    wrapped = (
        F.when(F.col("event_type") == "error", "I'm sorry, I cannot read this")
        .when(F.col("event_type") == "signup", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("event_type") == "click", F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(F.col("event_type") == "view", F.concat(F.lit("pre "), body, F.lit(" post")))
        .otherwise(F.when(F.col("frame_number") % 5 == 0, "nope").otherwise(body))
    )
    return own.withColumn("content", wrapped)


def recognitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text recognizer's answers, made up from events."""
    kind = F.col("event_type")
    said = F.when(kind == "error", "I'm sorry, I cannot read this").when(kind == "view", "NONE").when(kind == "click", "none").when(kind == "signup", "").otherwise(F.concat(F.lit("Total "), (F.col("frame_number") % 10).cast("string")))
    return frames(spark, sf_dir).withColumn("content", said)
