"""Golden values of scalar functions and of the prompt and response builders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.functions import image, responses, text, vector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: text.video_id(F.lit("/x/lecture.mp4")), "646ee630"),
        (lambda: text.node_id(F.lit("v"), F.lit(7)), "v_000007"),
        (lambda: text.node_id(F.lit("v"), F.lit(1234567)), "v_1234567"),
        (lambda: text.minutes_seconds(F.lit(0.25)), "00:00"),
        (lambda: text.minutes_seconds(F.lit(59.96)), "00:59"),
        (lambda: text.minutes_seconds(F.lit(3599.9)), "59:59"),
        (lambda: text.minutes_seconds(F.lit(6000.0)), "100:00"),
        (lambda: text.normalized(F.lit("  A\tb\n C ")), "a b c"),
        (lambda: text.word_count(F.lit("")), 0),
        (lambda: text.word_count(F.lit(" a  b ")), 2),
        (lambda: text.frame_file(F.lit("v"), F.lit(1.5)), "v_frame_001500.jpg"),
        (lambda: text.chunk_file(F.lit("v"), F.lit(7.5), F.lit(12.5)), "v_chunk_7_12.mp4"),
        (lambda: text.recognized(F.lit(" none ")), ""),
        (lambda: text.recognized(F.lit("I CANNOT read")), ""),
        (lambda: text.recognized(F.lit(" Total 5 ")), "Total 5"),
        (lambda: text.preview(F.lit("abcdef"), 3), "abc..."),
        (lambda: text.recognized(F.lit("\nNONE\n")), ""),
        (lambda: text.recognized(F.lit("\t x\n y \u00a0\n")), "x\n y"),
        (lambda: text.recognized(F.lit(None).cast("string")), ""),
        (lambda: text.stripped(F.lit("\x1c \u2003a b\u3000\r\n")), "a b"),
        (lambda: text.stripped(F.lit(" \n ")), ""),
        (lambda: text.stripped(F.lit(None).cast("string")), None),
    ],
)
def test_text(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("", "", 1.0), ("a", "", 0.0), ("agenda", "intro slide", 0.117647), ("intro slide", "agenda", 0.235294), ("abcdefgh", "abcdefgX", 0.875), ("abcdefghij", "abcdefghiX", 0.9)],
)
def test_ratio(a, b, want):
    assert round(text.ratio(a, b), 6) == want


def test_vectors(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vector.cosine(arr(1, 0), arr(0, 0))) == 0.0
    assert abs(one(spark, vector.cosine(arr(1, 0), arr(0.8, 0.6))) - 0.8) < 1e-12
    for same, d, want in ((True, 5, 0.758947), (True, 10, 0.72), (True, 11, 0.8), (False, 5, 0.8)):
        assert round(one(spark, vector.decayed(F.lit(0.8), F.lit(same), F.lit(d), 0.9, 10)), 6) == want
    labels = [one(spark, vector.scene_label(F.lit(x))) for x in (0.30, 0.31, 0.45, 0.46, 0.60, 0.61)]
    assert labels == ["minor_change", "moderate_change", "moderate_change", "scene_change", "scene_change", "major_scene_cut"]


def test_stripping_takes_linear_time(spark):
    assert one(spark, F.length(text.stripped(F.lit("a" + " " * 1_000_000 + "b")))) == 1_000_002


def test_ocr_record(spark):
    said = [("two words\n", ("two words", 2, 95.0, True)), (" NO_TEXT\n", ("", 0, 0.0, False)), ("\n", ("", 0, 0.0, False)), (None, ("", 0, 0.0, False)), ("no_text", ("no_text", 1, 95.0, True))]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string").select("i", responses.ocr_record(F.col("t")).alias("r")).orderBy("i").collect()
    assert [tuple(x.r) for x in rows] == [w for _, w in said]


def test_an_answer_is_parsed_once(spark):
    df = spark.createDataFrame([("{}", 1.0)], "content string, timestamp double").withColumn("semantic", responses.record(F.col("content"), F.col("timestamp")))
    df = df.withColumn("prompt", responses.prompt(F.col("timestamp"), F.col("semantic"), F.lit("")))
    plan = df.select("prompt", "semantic.people_count")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("jsontostructs") + plan.count("from_json") == 1


RESPONSES = [
    ('```json\n{"main_subject":"a","people":[]}\n```', ("a", 0, False)),
    ('```\n{"main_subject":"c"}\n```', ("c", 0, False)),
    ('pre {"main_subject":"b","people":"x"} post', ("b", 0, False)),
    ("nope", ("Video content showing visual scene", 1, True)),
    ('{"main_subject":"person unable to lift box"}', ("Video content showing visual scene", 1, True)),
    ('{"extracted_text":"two words"}', ("Video content", 0, False)),
    (None, ("Video content showing visual scene", 1, True)),
    ("```json\r\n\t{\"main_subject\":\"d\"}\n\n```", ("d", 0, False)),
    ("```json\nnone\n``` but {\"main_subject\":\"e\"}", ("Video content showing visual scene", 1, True)),
]


def test_responses(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(RESPONSES)], "i int, content string").select("i", responses.record(F.col("content"), F.lit(2.0)).alias("r")).orderBy("i").collect()
    assert [(x.r.main_subject, x.r.people_count, x.r.is_fallback) for x in rows] == [w for _, w in RESPONSES]
    assert (rows[5].r.ocr_word_count, rows[5].r.ocr_confidence, rows[5].r.scene_type) == (2, 95.0, "other")
    assert rows[2].r.people == []


def test_prompt(spark):
    content = '{"main_subject":"S","scene_type":"vlog","extracted_text":"%s","people":[{"description":"d","action":"a"},{"description":"e"}],"actions":["x","y"]}'
    make = lambda t, audio: one(spark, responses.prompt(F.lit(2.0), responses.record(F.lit(content % t), F.lit(2.0)), F.lit(audio)))
    assert make("T", "") == "Video frame at 2.0s | Scene: vlog | Content: S | People: Person 1: d, a; Person 2: e | Actions: x, y | Text: T"
    assert make("t" * 401, "u" * 251).endswith("Text: " + "t" * 400 + " | Audio: " + "u" * 250)


def test_images():
    flat, other = np.full((48, 64, 3), 100, np.uint8), np.full((48, 64, 3), 100, np.uint8)
    other[:, :32] = 200
    a, b = image.thumb(flat), image.thumb(other)
    assert len(a) == 320 * 240 and image.changed_share(a, a) == 0.0 and abs(image.changed_share(a, b) - 0.5) < 0.02
    rising = np.repeat(np.linspace(0, 255, 64).astype(np.uint8)[None, :, None], 48, 0).repeat(3, 2)
    assert image.gradient_hash(rising) == -1 and image.gradient_hash(flat) == 0
    red, blue = np.zeros((4, 4, 3), np.uint8), np.zeros((4, 4, 3), np.uint8)
    red[..., 2], blue[..., 0] = 255, 255
    assert image.hsv(red)[0, 0].tolist() == [0, 255, 255] and image.hsv(blue)[0, 0].tolist() == [120, 255, 255]
    assert image.histogram(red).sum() == 16 and image.histogram_dissimilarity(image.histogram(red), image.histogram(red)) == 0.0
    assert image.histogram_dissimilarity(image.histogram(red), image.histogram(blue)) > 0.9
