"""Language identification of web pages by Bayesian evidence fusion.

1. Text: smoothed counts of hashed byte trigrams for each language, over all labelled documents, give a page's
   log-likelihoods. Trigrams overlap, so these are tempered.
2. Declared markup language: how often pages that read like a language declare each value, by grouped aggregation.
3. Address: a host's prior is smoothed towards its address suffix's, and that towards the corpus's, from sums of the
   text posteriors; a page's own share is taken out of its host's and suffix's sums.

The posterior is the product of the three, normalized. Counts cover all rows, and every label is a language, however few
documents have it. Counts of trigrams stay in a table; their logarithms reach tasks by slices of `SLICE` languages, one
pass over the pages a slice (one in all for up to `SLICE` languages). What grows on the driver is one row a label.

Defined results: a null or empty page has no text evidence and takes its prior; pages without a host share the host '';
an undeclared or malformed language is the value ''; numeric references of nine digits or more
stand for U+FFFD; unclosed markup is text; ties go to the language that sorts first; without labelled
documents the language is null; ids may repeat; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, map_batches, mix64, text_bytes, written
from .vectors import matrix

#: Trigram buckets; languages whose tables (64 KB each) reach a task at once.
BUCKETS, SLICE = 8_192, 512
#: Weight of a trigram's log-likelihood, pseudo-counts of a host's and a suffix's prior, and of declared values.
TEMPER, HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 0.3, 4.0, 20.0, 1.0
_RAW = re.compile(r"<(script|style|noscript)\b", re.I)
_RAW_END = {k: re.compile(rf"</{k}\s*+>", re.I) for k in ("script", "style", "noscript")}
_ROOT = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?+\s*+([A-Za-z]{2,3})(?![A-Za-z])", re.I)
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}+|[xX][0-9A-Fa-f]{9,}+);?")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def _trigrams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte trigrams, ASCII letters folded, and their rows; none reaches over a row's end."""
    if len(body) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = body.copy()
    folded[(body >= 65) & (body <= 90)] += 32
    wide = folded.astype(np.uint64)
    code = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
    row = np.searchsorted(offsets, np.arange(len(code)), "right") - 1
    inside = np.arange(len(code)) + 3 <= offsets[row + 1]
    return (mix64(code[inside]) % np.uint64(BUCKETS)).astype(np.int64), row[inside]


def trigram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) over all labelled texts; summed within each task before they are dealt out."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in gathered(batches, 1 << 20):
            langs, of = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            bucket, row = _trigrams(*text_bytes(batch.column(1)))
            counts = np.bincount(of[row] * BUCKETS + bucket, minlength=len(langs) * BUCKETS).reshape(-1, BUCKETS)
            for lang, own in zip(langs, counts, strict=True):
                total[lang] = total.get(lang, 0) + own
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at].astype(np.int64))], ["lang", "bucket", "n"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    return known.mapInArrow(f, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def languages(docs: DataFrame, lang_col: str = "lang") -> list[str]:
    """All labels, in order."""
    return sorted(r[0] for r in docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string")).distinct().collect())  # a row a label


def likelihoods(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """The log-probabilities of buckets, one row a language; `langs` are neighbours in the order of all."""
    table, place = np.full((len(langs), BUCKETS), 0.5), {x: i for i, x in enumerate(langs)}

    def packed(group: pa.Table) -> pa.Table:
        own = np.zeros(BUCKETS, np.int64)
        own[group.column("bucket").to_numpy()] = group.column("n").to_numpy()
        return pa.table({"lang": group.column("lang").slice(0, 1), "counts": pa.array([own.tobytes()], pa.binary())})

    if langs:
        for row in counts.where(F.col("lang").between(langs[0], langs[-1])).groupBy("lang").applyInArrow(packed, "lang string, counts binary").collect():  # a row a language
            table[place[row["lang"]]] += np.frombuffer(row["counts"], np.int64)
    return np.log(table / table.sum(axis=1, keepdims=True))


def visible_text(page: str | None) -> str:
    """A page's text with a space for each tag, comment and element that holds no text, in one pass.

    What has no end further on is not looked for again.
    """
    if not page:
        return ""
    out, at, endless = [], 0, set()
    while (a := page.find("<", at)) >= 0 and (b := page.find(">", a)) >= 0:
        end = b + 1
        raw = _RAW.match(page, a)
        name = raw[1].lower() if raw else "!--" if page.startswith("<!--", a) else None
        if name and name not in endless:
            if name == "!--":
                close = page.find("-->", a + 4)
                close = close + 3 if close >= 0 else -1
            else:
                found = _RAW_END[name].search(page, end)
                close = found.end() if found else -1
            if close >= 0:
                end = close
            else:
                endless.add(name)
        out += [page[at:a], " "]
        at = end
    out.append(page[at:])
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", "".join(out)))


def declared_language(page: str | None) -> str:
    """What the first root tag that declares a language says, in lower case; else ''."""
    at = 0
    while page and (root := _ROOT.search(page, at)):
        end = page.find(">", root.end())
        end = len(page) if end < 0 else end
        if said := _LANG.search(page, root.end(), end):
            return said[1].lower()
        at = end
    return ""


def _scores(bucket: np.ndarray, row: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Tempered log-likelihoods of `n` texts, one column a language."""
    return np.stack([np.bincount(row, own[bucket], minlength=n) for own in table], axis=1) * TEMPER if len(table) else np.zeros((n, 0))


def _doubles(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64()))


def evidence(pages: DataFrame, langs: list[str], counts: DataFrame) -> DataFrame:
    """(page_id, host, suffix, declared, ll, p): log-likelihoods of the text, and its posterior under an even prior.

    The first pass reads pages; where a slice doesn't hold all languages it keeps their trigrams for the passes after it.
    """
    head, kept = "page_id bigint, host string, suffix string, declared string", "grams binary, ll array<double>"
    slices = [langs[a : a + SLICE] for a in range(0, len(langs), SLICE)] or [[]]

    def posterior(ll: np.ndarray) -> np.ndarray:
        p = np.exp(ll - ll.max(axis=1, keepdims=True)) if ll.shape[1] else ll
        return p / p.sum(axis=1, keepdims=True) if ll.shape[1] else p

    def read(table: np.ndarray) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, suffixes, declared, texts = [], [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = _HOST.match(url or "")
                host = found[1].lower() if found else ""
                hosts.append(host)
                suffixes.append(host.rpartition(".")[2])
                declared.append(declared_language(page))
                texts.append(visible_text(page))
            bucket, row = _trigrams(*text_bytes(pa.array(texts, pa.string())))
            ll = _scores(bucket, row, len(texts), table)
            own = [batch.column(0), pa.array(hosts), pa.array(suffixes), pa.array(declared)]
            if len(slices) == 1:
                return pa.RecordBatch.from_arrays([*own, _doubles(ll), _doubles(posterior(ll))], ["page_id", "host", "suffix", "declared", "ll", "p"])
            at = np.searchsorted(row, np.arange(len(texts) + 1))
            grams = [bucket[a:b].astype(np.uint16).tobytes() for a, b in zip(at, at[1:], strict=False)]
            return pa.RecordBatch.from_arrays([*own, pa.array(grams, pa.binary()), _doubles(ll)], ["page_id", "host", "suffix", "declared", "grams", "ll"])

        return f

    def more(table: np.ndarray, last: bool) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams = [np.frombuffer(x, np.uint16) for x in batch.column(4).to_pylist()]
            row = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
            bucket = np.concatenate([np.zeros(0, np.uint16), *grams])
            before = matrix(batch.column(5))
            ll = np.concatenate([before, _scores(bucket, row, len(grams), table)], axis=1)
            if last:
                return pa.RecordBatch.from_arrays([*batch.columns[:4], _doubles(ll), _doubles(posterior(ll))], ["page_id", "host", "suffix", "declared", "ll", "p"])
            return pa.RecordBatch.from_arrays([*batch.columns[:5], _doubles(ll)], ["page_id", "host", "suffix", "declared", "grams", "ll"])

        return f

    whole = f"{head}, ll array<double>, p array<double>"
    own = map_batches(pages.select(F.col("page_id").cast("bigint"), "url", "html"), read(likelihoods(counts, slices[0])), whole if len(slices) == 1 else f"{head}, {kept}")
    for k, part in enumerate(slices[1:], 2):
        last = k == len(slices)
        own = map_batches(written(own, "evidence"), more(likelihoods(counts, part), last), whole if last else f"{head}, {kept}")
    return own


def _sums(df: DataFrame, name: str, n: int, value: str, *keys: str) -> DataFrame:
    """Element-wise sums of an array column by keys; by rows of (keys, place) where there are too many for columns."""
    if n <= SLICE:
        return df.groupBy(*keys).agg(F.array(*(F.sum(F.col(value)[i]) for i in range(n))).alias(name))
    each = df.select(*keys, F.posexplode(value).alias("__at", "__x")).groupBy(*keys, "__at").agg(F.sum("__x").alias("__x"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__x"))), lambda s: s["__x"]).alias(name))


def _share(counts: Column, base: Column, weight: float) -> Column:
    """(counts + weight * base) / (sum of counts + weight), element-wise."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + weight
    return F.zip_with(counts, base, lambda c, b: (c + weight * b) / total)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence of every page."""
    langs = languages(docs)
    n = len(langs)
    own = written(evidence(pages, langs, written(trigram_counts(docs), "trigrams")), "evidence")
    if not n:
        return own.select("page_id", "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    names = F.lit(langs)
    # written, so that pages meet plain tables and AQE can split a hot host
    hosts = written(_sums(own, "host_sum", n, "p", "host", "suffix"), "hosts")
    suffixes = written(_sums(hosts, "suffix_sum", n, "host_sum", "suffix"), "suffixes")
    said = written(_sums(own, "said", n, "p", "declared"), "declared")
    kinds = said.count()
    totals = _sums(said.select(F.lit(0).alias("all"), "said"), "totals", n, "said", "all").first()
    every = [float(x or 0) for x in (totals["totals"] if totals else [0] * n)]
    # P(declared | language) for every declared value: one small row a value
    said = said.select("declared", F.transform("said", lambda c, i: F.log((c + DECLARED_WEIGHT) / (F.element_at(F.lit(every), i + 1) + DECLARED_WEIGHT * max(kinds, 1)))).alias("said"))
    total = sum(every)
    world = F.lit([(x + 1) / (total + n) for x in every])
    both = own.join(hosts, ["host", "suffix"]).join(suffixes, "suffix").join(said, "declared")
    less = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    both = both.withColumn("suffix_prior", _share(less(F.col("suffix_sum"), F.col("p")), world, SUFFIX_WEIGHT))
    both = both.withColumn("prior", _share(less(F.col("host_sum"), F.col("p")), F.col("suffix_prior"), HOST_WEIGHT))
    both = both.withColumn("z", F.zip_with(F.zip_with("ll", "said", lambda a, b: a + b), "prior", lambda a, b: a + F.log(b)))
    both = both.withColumn("most", F.array_max("z"))
    best = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    total = F.aggregate(F.transform("z", lambda x: F.exp(x - F.col("most"))), F.lit(0.0), lambda a, x: a + x)
    return both.select("page_id", "host", "declared", best(F.col("ll")).alias("text_lang"), best(F.col("z")).alias("lang"), F.round(1 / total, 6).alias("confidence"))
