"""Vector expressions over array<double>; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v / (|v| + 1e-8)."""
    length = norm(v) + 1e-8
    return F.transform(v, lambda x: x / length)


def difference(now: Column, before: Column) -> Column:
    """Element-wise difference; zeros where there is nothing before."""
    return F.when(before.isNull(), F.transform(now, lambda x: F.lit(0.0))).otherwise(F.zip_with(now, before, lambda x, y: x - y))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 1 where neither varies."""
    n = F.size(a).cast("double")
    ma, mb = total(a) / n, total(b) / n
    top = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    below = F.sqrt(total(F.transform(a, lambda x: (x - ma) * (x - ma))) * total(F.transform(b, lambda x: (x - mb) * (x - mb))))
    return F.when(below == 0, F.lit(1.0)).otherwise(top / below)


def hash_distance(a: Column, b: Column) -> Column:
    """Share of differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b)) / 64.0


def scene_score(features: Column, histogram: Column) -> Column:
    return features * 0.8 + histogram * 0.2


def scene_label(score: Column, threshold: float = 0.30) -> Column:
    """All bounds are strict. Fixed values."""
    return F.when(score > 0.6, "major_scene_cut").when(score > 0.45, "scene_change").when(score > threshold, "moderate_change").otherwise("minor_change")


def decayed(similarity: Column, same_video: Column, distance: Column, decay: float, reach: int) -> Column:
    """similarity * decay ** (distance / reach) within a video up to `reach` frames, else the similarity itself."""
    return F.when(same_video & (distance <= reach), similarity * F.pow(F.lit(decay), distance / float(reach))).otherwise(similarity)
