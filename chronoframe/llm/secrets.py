"""Secret scans with corpus-wide ownership frequency.

Patterns propose spans. Each span's value is hashed, and the hashes are aggregated over the corpus by distinct
repositories and owners: a value that many owners hold is a copied example, a value that few hold and that looks random
is live. Spans stay whatever their class; the class decides what `redact` masks.

Defined results: null and empty texts have no spans; a null repository counts as one repository named ''; positions are
code points, ends exclusive; rows with equal or null ids are each reported by their own text; extra columns are ignored by
`find` and kept by `redact`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c + "?" * (c == "_") for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
_RUN = "[A-Za-z0-9_-]"
#: kind, pattern, group of the value, least length of the value; the first three are the base kinds. Every pattern takes
#: linear time: what repeats without a bound is never tried again from within.
KINDS = [
    ("assign", re.compile(rf"(?:{_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"), 0, 27),
    ("web_token", re.compile(rf"(?<!{_RUN})(?>{_RUN}*?(?=eyJ))(eyJ{_RUN}++\.{_RUN}++\.{_RUN}++)"), 1, 24),
    ("host_token", re.compile(r"(?:gh[pousr]_[A-Za-z0-9]+|xox[abprs]-[A-Za-z0-9-]+)"), 0, 20),
    ("url_login", re.compile(r"://[^\s:/@]{1,64}:([^\s:/@]{1,128})@"), 1, 4),
]
BASE = 3
#: Which of these a text must contain for a kind to be looked for: substrings of the lower-cased text.
_HINTS = [("passw", "secret", "token", "api"), ("akia",), (), ("private key",), ("eyj",), ("gh", "xox"), ("://",)]
#: Kinds whose span is that of the value alone.
_VALUE_ONLY = {"web_token"}


def spans_of(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of every span, by start, then kind."""
    if not text:
        return []
    folded = text.lower()
    found = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        if _HINTS[k] and not any(h in folded for h in _HINTS[k]):
            continue
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                a, b = m.span(group if name in _VALUE_ONLY else 0)
                found.append((a, k, b, m[group]))
    return sorted(found)


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b, _ in spans)


def looks_random(value: str) -> bool:
    """Whether a value's characters are as spread as those of a generated key."""
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return bits >= 2.2 and not re.search(r"(?i)example|changeme|placeholder|x{4,}|your[_-]", value)


def scan(docs: DataFrame, repo: Column) -> DataFrame:
    """doc_id, text_key, repo, counts, digests and the spans with their values' hashes, one row a document."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, base, every, spans = [[], [], []], [], [], []
        for text in batch.column(3).to_pylist():
            own = spans_of(text)
            for k in range(BASE):
                n[k].append(sum(x[1] == k for x in own))
            base.append(hashlib.sha256(_joined([x for x in own if x[1] < BASE]).encode()).hexdigest())
            every.append(_joined(own))
            spans.append([{"start": a, "end": b, "value": hashlib.sha256(v.encode()).hexdigest()[:32], "random": looks_random(v)} for a, _, b, v in own])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("random", pa.bool_())]))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in n), pa.array(base), pa.array(every), pa.array(spans, kind)], ["doc_id", "text_key", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    schema = "doc_id bigint, text_key bigint, repo string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<start:int,end:int,value:string,random:boolean>>"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), F.coalesce(repo.cast("string"), F.lit("")), "text"), f, schema)


def ownership(found: DataFrame, owner: Column | None = None) -> DataFrame:
    """(value, n_repos, n_owners) over the corpus; pre-aggregated to a row a value and repository before it is counted."""
    each = found.select("repo", (F.substring_index("repo", "/", 1) if owner is None else owner).alias("owner"), F.explode("found.value").alias("value")).distinct()
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def classified(scanned: DataFrame, max_owners: int = 4) -> DataFrame:
    """(doc_id, text_key, n_live, n_examples, live array<struct<start,end>>) of each text with spans of each id.

    A span is live if its value looks random and at most `max_owners` owners hold it, else an example. Owners are written
    before spans meet them, so that AQE can split a value that many spans have.
    """
    some = scanned.where(F.size("found") > 0)
    each = some.groupBy("doc_id", "text_key").agg(F.first("found").alias("found")).select("doc_id", "text_key", F.explode("found").alias("s"))
    each = each.select("doc_id", "text_key", "s.start", "s.end", "s.random", F.col("s.value").alias("value")).join(written(ownership(some), "owners"), "value")
    live = F.col("random") & (F.col("n_owners") <= max_owners)
    return each.groupBy("doc_id", "text_key").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_examples"),
        F.max("n_owners").alias("most_owners"),
        F.array_compact(F.sort_array(F.collect_list(F.when(live, F.struct("start", "end"))))).alias("live"),
    )


def find(docs: DataFrame, repo: str = "source", max_owners: int = 4) -> DataFrame:
    """Counts, digests, all spans and the numbers of live and example spans of every document."""
    scanned = written(scan(docs, F.col(repo)), "spans")
    classes = classified(scanned, max_owners).drop("live").withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    out = scanned.drop("found", "repo").join(classes, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left").drop("id", "key", "text_key")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_live", "n_examples", "most_owners")})


def redact(docs: DataFrame, repo: str = "source", max_owners: int = 4, mask: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every live span masked; others keep their text. `n_chars`, where there is one, follows it."""
    scanned = written(scan(docs, F.col(repo)).select("doc_id", "text_key", "repo", "found").where(F.size("found") > 0), "spans")
    live = classified(scanned, max_owners).where("n_live > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("live").alias("__live"))
    both = docs.join(live, docs["doc_id"].cast("bigint").eqNullSafe(live["__id"]) & (F.xxhash64(docs["text"]) == live["__key"]), "left")
    merged = F.aggregate(
        live["__live"],
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(F.concat(acc["out"], F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(F.substring(docs["text"], acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))).alias("out"), s["end"].alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(docs["text"], acc["at"] + 1, F.length(docs["text"]))),
    )
    new = F.when(live["__live"].isNull(), docs["text"]).otherwise(merged)
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(live["__live"].isNull(), docs["n_chars"]).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return both.select(*(changed.get(c, docs[c]).alias(c) for c in docs.columns))
