"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, met by the windows of training texts.

Native: DataFrame functions only. Texts are split into lower-cased words (A-Z only are folded). A window is `size`
consecutive words of an item; an item of fewer words is one window. Most windows of a text can't occur: every window of
L words contains exactly one of the text's stretches of (L + 1) // 2 words that start at every (L // 2 + 1)-th word, so
only these anchors are hashed and looked up in a bitmap of the items' stretches. Windows over the anchors that are in it
become rows and meet the windows of all items, word for word, in a broadcast hash join; so hashes only choose candidates
and never decide. Where the items' windows are more than a broadcast may hold (checked: `MOST_WINDOWS`, `MOST_BYTES`), the
same join is left to Spark, which shuffles it and splits hot windows. What is found of a document is a set of spans; one
fold over the sorted spans counts words that lie in any of them, however they overlap.

Rows are told apart by number while their windows are gathered, so repeated rows and null ids stay apart. The number is
that of `monotonically_increasing_id`, which a lost executor's tasks give again over files; write a table first if its
rows come in no fixed order.

Defined results: null and empty texts have no words and no hits; items without words have no windows; an item with a null
id hits words but isn't listed or counted; equal item ids count once; very long texts are whole rows, scanned in linear
time; empty tables of either kind give no hits; extra columns are kept by `decontaminated` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that stand between words once A-Z are folded: ASCII other than digits and letters. As Spark's split takes it.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR, _WORD_BYTE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of texts as they are
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Windows of items, and bytes of their words, that a broadcast may hold.
MOST_WINDOWS, MOST_BYTES = 1 << 19, 1 << 26
#: The bitmap of anchors has 64 bits an anchor, and 2 to these powers at least and at most.
BITMAP_BITS = (12, 24)


def words(text: Column) -> Column:
    """Lower-cased words. What is ASCII throughout can take the faster of two ways to fold A-Z."""
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), SEPARATORS), "")


def _let(value: Column, f) -> Column:
    """`f` of a value that is computed once a row, however often `f` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _range(first: Column, last: Column, step: int = 1) -> Column:
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _anchor(length: int) -> tuple[int, int]:
    """How many words an anchor of windows of `length` words has, and at which distance anchors start."""
    return (length + 1) // 2, length // 2 + 1


def _anchors(w: Column, length: int) -> Column:
    """Hashes of all stretches of a window that may be its anchor in a text."""
    k, step = _anchor(length)
    return F.transform(F.sequence(F.lit(1), F.lit(step)), lambda j: F.xxhash64(F.slice(w, j, k)))


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(gram, length, items): each distinct window, its number of words, and the sorted ids of items that have it."""
    items = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    long = F.least(F.size("w"), F.lit(size))
    starts = items.select("item", "w", long.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - long + 1)).alias("i"))
    grams = starts.select("item", "length", F.array_join(F.slice("w", F.col("i"), F.col("length")), " ").alias("gram"))
    return grams.groupBy("gram", "length").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _bitmap(grams: DataFrame, lengths: list[int], power: int) -> DataFrame:
    """One row, `bits`: 2**power bits, of which those of the hashes of all anchors of windows are set."""
    pieces = None
    for length in lengths:
        own = grams.where(F.col("length") == length).select(F.explode(_anchors(F.split("gram", " "), length)).alias("h"))
        pieces = own if pieces is None else pieces.unionByName(own)
    every = grams.sparkSession.range(1 << (power - 6)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    if pieces is not None:
        slots = pieces.select(F.shiftrightunsigned("h", 64 - power).alias("slot"))
        every = every.unionByName(slots.selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, CAST(slot & 63 AS INT)) AS mask"))
    merged = every.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return merged.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("all")).select(F.col("all.mask").alias("bits"))


def _candidates(w: Column, bits: Column, length: int, power: int) -> Column:
    """Windows of `length` words over anchors that are in the bitmap, as (start, length, gram)."""
    k, step = _anchor(length)
    n = F.size(w)

    def known(a: Column) -> Column:
        slot = F.array(F.shiftrightunsigned(F.xxhash64(F.slice(w, a, k)), 64 - power))
        return F.exists(slot, lambda s: F.call_function("shiftright", F.get(bits, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)

    anchors = F.filter(_range(F.lit(1), n - (k - 1), step), known)
    starts = F.flatten(F.transform(anchors, lambda a: _range(F.greatest(a - (step - 1), F.lit(1)), F.least(a, n - (length - 1)))))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(w, i, length), " ").alias("gram")))


def _covered(spans: Column) -> Column:
    """How many words lie in sorted spans of (start, stop)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        zero,
        lambda had, s: F.struct((had["words"] + F.greatest(F.lit(0), s["stop"] - F.greatest(had["upto"], s["start"]))).alias("words"), F.greatest(had["upto"], s["stop"]).alias("upto")),
        lambda had: had["words"],
    )


def spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`docs` but its column `text`, and n_words, spans (sorted, of words: start from 1, stop exclusive) and items.

    items: sorted ids of the items of which windows occur. One row for each row of `docs`.
    """
    grams = windows(benchmark, size)
    had = grams.groupBy("length").agg(F.count("*"), F.sum(F.octet_length("gram") + 8 * F.size("items"))).collect()  # `size` rows at most
    lengths, n, total = sorted(r[0] for r in had), sum(r[1] for r in had), sum(r[2] for r in had)
    power = min(max(BITMAP_BITS[0], (64 * n).bit_length()), BITMAP_BITS[1])
    keys = [c for c in docs.columns if c != "text"]
    known = docs.select(F.struct(*keys).alias("__keys"), "text", _bitmap(grams, lengths, power).scalar().alias("__bits"))
    none = F.array().cast("array<struct<start int, length int, gram string>>")
    # the bitmap is named once and outside of lambdas, so that it stays a constant of the plan and isn't copied into rows
    found = _let(
        F.struct(words(F.col("text")).alias("w"), F.col("__bits").alias("bits")),
        lambda x: F.struct(F.size(x["w"]).alias("n"), F.concat(none, *(_candidates(x["w"], x["bits"], m, power) for m in lengths)).alias("c")),
    )
    rows = known.select(F.monotonically_increasing_id().alias("__row"), "__keys", found.alias("__found"))
    # two steps, so that what is exploded isn't carried along as well
    rows = rows.select("__row", "__keys", F.col("__found.n").alias("__n"), F.col("__found.c").alias("__all")).select("__row", "__keys", "__n", F.explode_outer("__all").alias("__c"))
    small = n <= most_windows and total <= most_bytes
    sought = grams.select(F.col("gram").alias("__gram"), F.col("items").alias("__items"))
    met = rows.join(F.broadcast(sought) if small else sought, F.col("__c.gram") == F.col("__gram"), "left")
    span = F.when(F.col("__gram").isNotNull(), F.struct(F.col("__c.start").alias("start"), (F.col("__c.start") + F.col("__c.length")).alias("stop")))
    by_row = met.groupBy("__row").agg(
        F.any_value("__keys").alias("__keys"), F.any_value("__n").alias("__n"), F.sort_array(F.collect_list(span)).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items")
    )
    return by_row.select("__keys.*", F.col("__n").cast("bigint").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def _left(x: Column) -> Column:
    gone = F.flatten(F.transform(x["spans"], lambda s: F.sequence(s["start"], s["stop"] - 1)))
    stay = F.array_except(F.sequence(F.lit(1), F.size(x["pieces"])), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(x["pieces"], i - 1)), "")


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, **bounds: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = spans(docs.select("doc_id", "text"), benchmark, size, **bounds)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, documents: bool = False, **bounds: int) -> DataFrame:
    """The rows of `docs` with words that windows cover removed from `text`, or without the rows that have any (`documents`).

    A removed word takes the separators before it along; n_chars, where there is such a column, follows the text. What is
    found is kept by the text's digest, so each text's spans travel once and meet its copies in an ordinary join.
    """
    hits = spans(docs.select(F.sha2("text", 256).alias("digest"), "text"), benchmark, size, **bounds).where(F.size("spans") > 0)
    hits = hits.groupBy("digest").agg(F.any_value("spans").alias("spans")).select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans"))
    if documents:
        return docs.join(hits, F.sha2(docs["text"], 256) == hits["__digest"], "left_anti")
    both = docs.join(hits, F.sha2(docs["text"], 256) == hits["__digest"], "left")
    # a piece is a word with what stands before it; what follows the last word is a piece too
    pieces = F.split(docs["text"], f"(?<={_WORD_BYTE})(?={_SEPARATOR})")
    left = F.when(hits["__spans"].isNull(), docs["text"]).otherwise(_let(F.struct(pieces.alias("pieces"), hits["__spans"].alias("spans")), _left))
    columns = {c: docs[c] for c in docs.columns}
    columns["text"] = left
    if "n_chars" in columns:
        columns["n_chars"] = F.when(hits["__spans"].isNull(), docs["n_chars"]).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return both.select(*(v.alias(c) for c, v in columns.items()))
