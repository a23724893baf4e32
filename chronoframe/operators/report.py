"""Counts that summarize keyframes, transcripts and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_text(change_type: Column, compat: bool = False) -> Column:
    """Whether a keyframe came from a text change. compat: only the label `text_change`, which the gate never emits."""
    return change_type == "text_change" if compat else change_type.isin("text_appeared", "text_disappeared", "text_changed")


def is_initial(change_type: Column, compat: bool = False) -> Column:
    return change_type == ("initial_frame" if compat else "initial")


def detection_summary(keyframes: DataFrame, *by: str, compat: bool = False) -> DataFrame:
    """keyframes, text, visual and initial counts, and their percentages; text_percent is 0 for a single keyframe."""
    kind, n = F.col("change_type"), F.count("*")
    text, visual = F.count_if(is_text(kind, compat)), F.count_if(kind == "visual_change")
    return keyframes.groupBy(*by).agg(
        n.alias("keyframes"),
        text.alias("text_count"),
        visual.alias("visual_count"),
        F.count_if(is_initial(kind, compat)).alias("initial_count"),
        F.when(n > 1, text / n * 100).otherwise(0.0).alias("text_percent"),
        (text / n * 100).alias("text_share"),
        (visual / n * 100).alias("visual_share"),
    )


def semantic_counts(records: DataFrame, *by: str) -> DataFrame:
    """records has a `semantic` struct: frames with people, actions, code, text, and people in all."""
    s = F.col("semantic")
    return records.groupBy(*by).agg(
        F.count_if(s["has_people"]).alias("frames_with_people"),
        F.count_if(s["has_actions"]).alias("frames_with_actions"),
        F.count_if(F.coalesce(s["technical_content"]["has_code"], F.lit(False))).alias("frames_with_code"),
        F.count_if(s["extracted_text"] != "").alias("frames_with_text"),
        F.sum(s["people_count"]).cast("bigint").alias("people"),
    )


def per_minute(keyframes: DataFrame, durations: DataFrame) -> DataFrame:
    """(video_id, keyframes, per_minute); null where the duration is 0."""
    n = keyframes.groupBy("video_id").agg(F.count("*").alias("keyframes"))
    return n.join(durations, "video_id").select("video_id", "keyframes", (F.col("keyframes") / F.nullif(F.col("duration") / 60, F.lit(0.0))).alias("per_minute"))


def real_fps(frames_read: Column, duration: Column) -> Column:
    return F.when(duration > 0, frames_read / duration).otherwise(0.0)
