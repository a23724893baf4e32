"""Whether texts are alike by difflib's ratio, decided by bounds in expressions where these suffice.

difflib's ratio is twice the characters that match over the lengths of both. It can't exceed twice the shorter length over
both, nor twice the characters that both have, in any order, over both lengths. Only pairs that both bounds leave open go to
Python, each distinct pair once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alike, normalized, once
from .gate import in_time


def shared_characters(a: Column, b: Column) -> Column:
    """How many characters two texts share, in any order; a character that both have twice counts twice."""
    times = lambda x, c: F.length(x) - F.length(F.replace(x, c))
    return F.aggregate(F.array_distinct(F.split(a, F.lit(""))), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))


def decided(current: Column, previous: Column, least: float) -> Column:
    """true or false where equality, emptiness or a bound of the ratio decides; null where only the ratio itself can.

    Nulls are empty texts. Two empty texts are alike, an empty text and another one aren't.
    """
    pair = F.struct(F.coalesce(current, F.lit("")).alias("x"), F.coalesce(previous, F.lit("")).alias("y"))

    def by_length(p: Column) -> Column:
        low = F.struct(F.lower(p["x"]).alias("x"), F.lower(p["y"]).alias("y"))
        return F.when(p["x"] == p["y"], F.lit(least <= 1)).when((p["x"] == "") | (p["y"] == ""), F.lit(least <= 0)).otherwise(once(low, by_characters))

    def by_characters(p: Column) -> Column:
        both = F.length(p["x"]) + F.length(p["y"])
        short = lambda n: 2.0 * n / both < least
        return F.when(short(F.least(F.length(p["x"]), F.length(p["y"]))), False).when(short(shared_characters(p["x"], p["y"])), False)

    return once(pair, by_length)


def with_alike(pairs: DataFrame, current: str, previous: str, least: float, name: str = "alike") -> DataFrame:
    """Adds `name`: whether the ratio of two text columns is at least `least`; the same for every row as difflib says."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([alike(a, b, least) for a, b in zip(x, y, strict=True)], dtype="bool")

    rows = pairs.withColumn(name, decided(F.col(current), F.col(previous), least))
    left = rows.where(F.col(name).isNull()).drop(name)
    of = left.select(F.col(current).alias("__x"), F.col(previous).alias("__y")).distinct()
    of = of.withColumn(name, F.pandas_udf(run, "boolean")("__x", "__y"))
    found = left.join(of, (F.col(current) == F.col("__x")) & (F.col(previous) == F.col("__y"))).drop("__x", "__y")
    return rows.where(F.col(name).isNotNull()).unionByName(found)


def flicker(frames: DataFrame, reach: int = 3, least: float = 0.9) -> DataFrame:
    """(video_id, frame_number, flicker): the folded text isn't empty and is alike one of the last `reach` texts."""
    now, w = normalized(F.coalesce("extracted_text", F.lit(""))), in_time()
    before = F.array(*(F.lag(now, k).over(w) for k in range(1, reach + 1)))
    rows = frames.select("video_id", "frame_number", now.alias("now"), F.array_distinct(F.filter(before, lambda t: t.isNotNull())).alias("before"))
    rows = rows.select("video_id", "frame_number", "now", F.explode_outer("before").alias("before"))
    found = with_alike(rows, "now", "before", least)
    return found.groupBy("video_id", "frame_number").agg(F.bool_or(F.col("alike") & (F.col("now") != "")).alias("flicker"))
