"""From a description model's raw answer to a typed record, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PERSON, RESPONSE, TECHNICAL
from .text import once, refused, stripped, word_count


def json_text(content: Column) -> Column:
    """The JSON object in an answer, or null: fenced as json, fenced, the whole, or from the first to the last brace."""
    between = lambda mark: stripped(F.split_part(F.split_part(content, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1)))
    fence = F.when(content.contains("```json"), between("```json")).when(content.contains("```"), between("```")).otherwise(content)
    is_object = lambda c: F.startswith(stripped(c), F.lit("{")) & F.try_parse_json(c).isNotNull()
    from_braces = lambda c: once(F.regexp_extract(c, r"(?s)\{.*\}", 0), lambda x: F.when(is_object(x), x))
    return once(fence, lambda c: F.when(is_object(c), c).otherwise(from_braces(c)))


def _empty_technical() -> Column:
    return F.struct(F.lit(False).alias("has_code"), F.lit("").alias("programming_language"), F.lit(False).alias("has_terminal"), F.lit(False).alias("has_diagram"), F.lit(False).alias("has_ui_elements"))


def fallback(timestamp: Column) -> Column:
    """The record that stands in for an answer that is refused or can't be read. Fixed values."""
    person = F.struct(F.lit("Individual present in frame").alias("description"), F.lit("casual attire").alias("clothing"), F.lit("visible in scene").alias("action"), F.lit("neutral").alias("expression"), F.lit("center frame").alias("position"))
    return F.struct(
        F.lit("Video content showing visual scene").alias("main_subject"),
        F.lit("video").alias("scene_type"),
        F.lit("").alias("extracted_text"),
        F.lit("").alias("text_content"),
        F.array(person).alias("people"),
        F.array(F.lit("present in scene")).alias("actions"),
        F.array(F.lit("video content")).alias("visual_elements"),
        F.array(F.lit("scene elements")).alias("key_objects"),
        F.lit("medium").alias("info_density"),
        _empty_technical().cast(TECHNICAL).alias("technical_content"),
        F.lit(True).alias("has_people"),
        F.lit(1).alias("people_count"),
        F.lit(True).alias("has_actions"),
        timestamp.cast("double").alias("timestamp"),
        F.lit(0).alias("ocr_word_count"),
        F.lit(0.0).alias("ocr_confidence"),
        F.lit(True).alias("is_fallback"),
    )


def record(content: Column, timestamp: Column) -> Column:
    """The typed record of an answer. Refusal words count anywhere in it, before it is parsed.

    Absent and null fields take their defaults; people and actions that aren't lists count as none. An answer is parsed
    once, whatever is read of its record.
    """
    read = lambda json: F.struct(json.isNull().alias("absent"), F.from_json(json, RESPONSE).alias("found"))
    fill = lambda x: F.when(x["absent"], fallback(timestamp)).otherwise(_filled(x["found"], timestamp))
    json = F.when(~refused(content), json_text(content))
    return once(json, lambda j: once(read(j), fill))


def _filled(found: Column, timestamp: Column) -> Column:
    """A record with defaults where the answer has nothing."""
    people = F.coalesce(found["people"], F.array().cast(f"array<{PERSON}>"))
    strings = lambda name: F.coalesce(found[name], F.array().cast("array<string>"))
    text = F.coalesce(found["extracted_text"], F.lit(""))
    return F.struct(
        F.coalesce(found["main_subject"], F.lit("Video content")).alias("main_subject"),
        F.coalesce(found["scene_type"], F.lit("other")).alias("scene_type"),
        text.alias("extracted_text"),
        text.alias("text_content"),
        people.alias("people"),
        strings("actions").alias("actions"),
        strings("visual_elements").alias("visual_elements"),
        strings("key_objects").alias("key_objects"),
        F.coalesce(found["info_density"], F.lit("medium")).alias("info_density"),
        F.coalesce(found["technical_content"], _empty_technical().cast(TECHNICAL)).alias("technical_content"),
        (F.size(people) > 0).alias("has_people"),
        F.size(people).alias("people_count"),
        (F.size(strings("actions")) > 0).alias("has_actions"),
        timestamp.cast("double").alias("timestamp"),
        word_count(text).alias("ocr_word_count"),
        F.when(text != "", 95.0).otherwise(0.0).alias("ocr_confidence"),
        F.lit(False).alias("is_fallback"),
    )

def ocr_record(text: Column) -> Column:
    """The standalone recognizer's record: nothing for the exact marker NO_TEXT and for empty answers."""
    none = lambda t: t.isin("", "NO_TEXT")
    made = lambda t: F.struct(
        F.when(none(t), "").otherwise(t).alias("text"),
        F.when(none(t), 0).otherwise(word_count(t)).alias("word_count"),
        F.when(none(t), 0.0).otherwise(95.0).alias("confidence"),
        (~none(t)).alias("has_text"),
    )
    return once(stripped(F.coalesce(text, F.lit(""))), made)


def people_text(people: Column) -> Column:
    """`Person i: description[, action]` joined by `; `."""
    one = lambda p, i: F.concat(F.lit("Person "), (i + 1).cast("string"), F.lit(": "), F.coalesce(p["description"], F.lit("")), F.when(F.coalesce(p["action"], F.lit("")) != "", F.concat(F.lit(", "), p["action"])).otherwise(""))
    return F.array_join(F.transform(people, one), "; ")


def prompt(timestamp: Column, rec: Column, audio: Column, text_limit: int = 400, audio_limit: int = 250) -> Column:
    """The text that is embedded for a keyframe: fixed order, empty parts left out."""
    filled = lambda x: F.size(x) > 0
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Video frame at "), F.format_string("%.1f", F.round(timestamp, 1)), F.lit("s")),
        F.concat(F.lit("Scene: "), rec["scene_type"]),
        F.concat(F.lit("Content: "), rec["main_subject"]),
        F.when(filled(rec["people"]), F.concat(F.lit("People: "), people_text(rec["people"]))),
        F.when(filled(rec["actions"]), F.concat(F.lit("Actions: "), F.array_join(rec["actions"], ", "))),
        F.when(filled(rec["key_objects"]), F.concat(F.lit("Objects: "), F.array_join(rec["key_objects"], ", "))),
        F.when(F.coalesce(rec["text_content"], F.lit("")) != "", F.concat(F.lit("Text: "), F.substring(rec["text_content"], 1, text_limit))),
        F.when(F.coalesce(audio, F.lit("")) != "", F.concat(F.lit("Audio: "), F.substring(audio, 1, audio_limit))),
    )
