"""A description model's answer as an open record: VARIANT values by key, kept as the answer has them.

`responses.record` reads the known fields into types. Here an absent key and an explicit null differ, values of the wrong
type stay as they were, and keys that nobody expected survive. Defaults stand in for absent keys only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .responses import fallback, json_text
from .text import once, refused, word_count

FIELDS = "map<string,variant>"
#: What stands in for an absent key, as JSON.
DEFAULTS = {
    "main_subject": '"Video content"',
    "scene_type": '"other"',
    "visual_elements": "[]",
    "key_objects": "[]",
    "info_density": '"medium"',
    "technical_content": '{"has_code": false, "programming_language": "", "has_terminal": false, "has_diagram": false, "has_ui_elements": false}',
}
#: JSON of the values that count as no text.
NOTHING = ("null", '""', "0", "0.0", "false", "[]", "{}")


def field(record: Column, name: str) -> Column:
    """A key's value as a VARIANT; SQL null if the key is absent, a VARIANT null if it is null."""
    return F.try_element_at(record["fields"], F.lit(name))


def kind(value: Column) -> Column:
    """absent, null, or the type of a VARIANT (STRING, BIGINT, ARRAY<...>, OBJECT<...> and so on)."""
    return F.when(value.isNull(), "absent").when(F.is_variant_null(value), "null").otherwise(F.schema_of_variant(value))


def as_json(value: Column) -> Column:
    """JSON text of a VARIANT; SQL null stays null."""
    return F.to_json(value)


def items(value: Column) -> Column:
    """How many items a list has; 0 for anything else, absent or null."""
    return F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")), F.lit(0))


def open_record(content: Column, timestamp: Column) -> Column:
    """(fields, has_people, people_count, has_actions, ocr_word_count, ocr_confidence, is_fallback) of an answer.

    Lists count for the flags only, whatever the value is it stays in `fields`. `text_content` repeats `extracted_text`,
    or is "" without it. Refusals, what isn't a JSON object and texts that are true but no strings (a number, a list) give
    the fallback record. An object that names a key twice is no JSON object.
    """
    json = F.when(~refused(content), json_text(content))
    found = lambda j: F.struct(F.try_variant_get(F.try_parse_json(j), "$", FIELDS).alias("fields"))
    return once(once(json, found), lambda r: once(_read(r), lambda x: F.when(x["broken"], _stand_in(timestamp)).otherwise(_filled(x))))


def _read(own: Column) -> Column:
    said = field(own, "extracted_text")
    empty = said.isNull() | F.coalesce(as_json(said).isin(*NOTHING), F.lit(True))
    text = F.when(~empty & (F.schema_of_variant(said) == "STRING"), F.try_variant_get(said, "$", "string"))
    return F.struct(own["fields"].alias("fields"), said.alias("said"), F.coalesce(text, F.lit("")).alias("text"), (own["fields"].isNull() | (~empty & text.isNull())).alias("broken"))


def _flags(people: Column, actions: Column, text: Column, stands_in: bool) -> list[Column]:
    return [
        (people > 0).alias("has_people"),
        people.alias("people_count"),
        (actions > 0).alias("has_actions"),
        word_count(text).alias("ocr_word_count"),
        F.when(text != "", 95.0).otherwise(0.0).alias("ocr_confidence"),
        F.lit(stands_in).alias("is_fallback"),
    ]


def _filled(own: Column) -> Column:
    fields = own["fields"]
    defaults = F.create_map(*(x for k, v in DEFAULTS.items() for x in (F.lit(k), F.parse_json(F.lit(v)))))
    every = F.map_concat(
        F.map_filter(fields, lambda k, _: k != "text_content"),
        F.map_filter(defaults, lambda k, _: ~F.map_contains_key(fields, k)),
        F.create_map(F.lit("text_content"), F.coalesce(own["said"], F.parse_json(F.lit('""')))),
    )
    return F.struct(every.alias("fields"), *_flags(items(field(own, "people")), items(field(own, "actions")), own["text"], False))


def _stand_in(timestamp: Column) -> Column:
    fields = F.variant_get(F.to_variant_object(fallback(timestamp).dropFields("is_fallback")), "$", FIELDS)
    return F.struct(fields.alias("fields"), *_flags(F.lit(1), F.lit(1), F.lit(""), True))
