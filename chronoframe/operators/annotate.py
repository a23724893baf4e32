"""Raw model answers to keyframe records with prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import responses
from ..functions.text import node_id


def annotated(keyframes: DataFrame, content: str = "content") -> DataFrame:
    """Adds `semantic`, the typed record of each answer."""
    return keyframes.withColumn("semantic", responses.record(F.col(content), F.col("timestamp")))


def prompted(keyframes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `prompt` (what is embedded) and `id`. keyframes: semantic and audio_text."""
    prompt = responses.prompt(F.col("timestamp"), F.col("semantic"), F.col("audio_text"), settings.text_limit, settings.audio_limit)
    return keyframes.withColumn("prompt", prompt).withColumn("id", node_id(F.col("video_id"), F.col("frame_number")))


def records(keyframes: DataFrame) -> DataFrame:
    """Keyframe records: pixels dropped, the score also as motion_score."""
    return keyframes.drop("data", "thumb").withColumn("motion_score", F.col("scene_change_score"))
