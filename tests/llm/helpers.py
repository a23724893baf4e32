"""Small tables with awkward rows, and plain re-statements of what the operators return."""

import random
import re

from pyspark.sql import functions as F

WORDS = "ath ber cion del ent for gan hin ior jal kes lor men nor ost pre qui ron ser tha uni ver was xen yor zed".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside; a table may have columns of these names.
CLASHES = ["id", "key", "h", "p", "n", "a", "b", "rank", "length", "start", "piece", "value", "component", "v", "label", "bucket", "repo", "found", "line", "pos", "m", "__id", "__live", "__pos", "__m", "__new"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def rows(seed=1, n=40):
    """Documents with nulls, empty, blank and long texts, copies, near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    shared = prose(rng, 45)
    out = [None, "", " \n\t ", "one", "one", "a b c d", "A B C D", "\x0b\x0c", "é" * 50, "x  y   z\n\n\nx  y   z"]
    out += [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    base = prose(rng, 100).split()
    for k in range(6):
        own = list(base)
        for _ in range(k):
            own[rng.randrange(100)] = rng.choice(WORDS)
        out.append(" ".join(own))
    out += [prose(rng, 20) + " " + shared + " " + prose(rng, 15) for _ in range(5)]
    out += [out[12], out[12].upper(), "\n".join([prose(rng, 12)] * 3), prose(rng, 3000), "the the " * 40, "<|endoftext|> don't " + shared]
    out += [f"line one of it has quite enough words to count here\n{prose(rng, 12)}\nshort\nshort" for _ in range(4)]
    return [(i * 3, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 7 else None, len(t) if t else None) for i, t in enumerate(out)]


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def words(text, lower=False):
    text = text or ""
    if lower:
        text = text.translate({k: k + 32 for k in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def union_find(ids, pairs):
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
