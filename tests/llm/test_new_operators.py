"""Decontamination, band join and manifest against plain versions on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chronoframe.llm import bandjoin, decontaminate, manifest

from .helpers import SCHEMA, clashing, prose, rows, table

FOLD = {k: k + 32 for k in range(65, 91)}
BENCH = "item_id bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain_hits(docs, bench, size=10):
    grams = {}
    for item, text in bench:
        w = plain_words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, items = plain_words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if found := grams.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found - {None}
        out.append((doc_id, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)))
    return sorted(out, key=str)


def bench_and_docs():
    rng = random.Random(3)
    texts = [t for _, t, *_ in rows()]
    long = [t for t in texts if t and len(t.split()) > 30]
    bench = [(k, " ".join(t.split()[2 : 2 + rng.randint(9, 25)]).upper()) for k, t in enumerate(long[:12])]
    bench += [(3, long[3]), (100, None), (101, ""), (102, " ,.; "), (None, " ".join(long[5].split()[5:20])), (103, "É" * 3), (104, "one"), (105, "b c d"), (106, prose(rng, 200)), (20, bench[0][1])]
    docs = list(enumerate(texts))
    docs += [(None, texts[12]), (None, texts[12]), (7, long[3] + " " + long[3]), (8, "x," * 3 + bench[0][1].replace(" ", "--") + "É " + bench[0][1]), (9, "Straße İstanbul ÉÉÉ ÄÖ one"), (9, "one ONE oNe"), (10, prose(rng, 20_000) + " " + bench[-2][1])]
    return docs, bench


@pytest.mark.parametrize("size", [10, 9, 3, 1])
def test_decontamination_is_plain_search(spark, size):
    docs, bench = bench_and_docs()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(bench, BENCH).repartition(2)
    want = plain_hits(docs, bench, size)
    assert sum(x[5] for x in want) > 10
    assert sorted(map(tuple, decontaminate.report(clashing(d), clashing(b), size).collect()), key=str) == want


def test_decontamination_without_broadcast_is_the_same(spark):
    docs, bench = bench_and_docs()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(bench, BENCH)
    found = decontaminate.report(d, b, most_windows=1)
    assert sorted(map(tuple, found.collect()), key=str) == plain_hits(docs, bench)


def test_decontamination_runs_no_python(spark):
    docs, bench = bench_and_docs()
    found = decontaminate.report(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, BENCH))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan) and "BroadcastHashJoin" in plan


def test_decontaminated_texts(spark):
    docs, bench = bench_and_docs()
    d = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in docs], SCHEMA).repartition(3)
    d, b = clashing(d).withColumn("__spans", F.lit(1)).withColumn("digest", F.lit("x")), spark.createDataFrame(bench, BENCH)
    left = decontaminate.decontaminated(d, b)
    assert left.schema.names == d.schema.names
    found = left.collect()
    assert len(found) == len(docs)
    want = []
    for doc_id, text in docs:
        w = plain_words(text)
        [(_, _, n, *_)] = plain_hits([(doc_id, text)], bench)
        want.append((str(doc_id), len(w) - n))
        if n == 0:
            assert (doc_id, text) in [(r["doc_id"], r["text"]) for r in found]
    assert sorted((str(r["doc_id"]), len(plain_words(r["text"]))) for r in found) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in found if r["text"] is not None)
    kept = decontaminate.decontaminated(d, b, documents=True).collect()
    assert sorted(map(str, (r["doc_id"] for r in kept))) == sorted(str(x[0]) for x in plain_hits(docs, bench) if not x[5])
    one = spark.createDataFrame([(1, "Ab, cd;  ef gh. ")], "doc_id bigint, text string")
    assert decontaminate.decontaminated(one, spark.createDataFrame([(1, "CD ef")], BENCH)).first()["text"] == "Ab gh. "


def test_decontamination_of_empty_tables(spark):
    docs, bench = bench_and_docs()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, BENCH)
    assert decontaminate.report(d.limit(0), b).count() == 0
    none = decontaminate.report(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] or r["n_items"] or r["items_sha256"] != sha("") for r in none)
    assert decontaminate.decontaminated(d, b.limit(0)).count() == len(docs)


# band join

LINES = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double"
ITEMS = "item_id bigint, name string, price double"


def cents(x):
    return math.floor(100.0 * x + 0.5) if x is not None and math.isfinite(x) and abs(100.0 * x) < 2**53 else None


def plain_band(items, lines, k=10):
    own = []
    for sale, no, item, _, q, amount in lines:
        a = cents(amount)
        if None not in (sale, item, q, a) and q:
            own.append(((2 * a + q) // (2 * q), sale, no, item))
    out = []
    for item, _, price in items:
        p = cents(price)
        pairs = []
        for u, sale, no, other in own if None not in (p, item) else []:
            gap = abs(u - p)
            if other != item and (gap <= 50 or 1000 * gap <= 5 * min(u, p)):
                pairs.append((gap, u, sale, no, other))
        pairs.sort(key=lambda x: (*x[:3], -math.inf if x[3] is None else x[3], x[4]))
        sums = (len(pairs), sum(x[0] for x in pairs), sum(zlib.crc32(f"{x[2]},{'' if x[3] is None else x[3]},{x[4]}".encode()) for x in pairs))
        out += [(item, n + 1, *x, *sums) for n, x in enumerate(pairs[:k])] or [(item, 0, None, None, None, None, None, *sums)]
    return sorted(out, key=str)


def shop(seed, n_items, n_lines, prices, hot=0.0):
    rng = random.Random(seed)
    items = [(i, "x", prices(rng)) for i in range(n_items)]
    lines = []
    for _ in range(n_lines):
        i = 0 if rng.random() < hot else rng.randrange(n_items)
        q = rng.randint(1, 50)
        price = items[i][2] if rng.random() < 0.7 else prices(rng)
        lines.append((rng.randrange(n_lines), rng.choice([1, 1, 2, 3, None]), i, 1, q, round(price * q, 2)))
    lines += lines[: n_lines // 10]
    return items, lines


AWKWARD_ITEMS = [(None, "x", 5.0), (500, "x", None), (501, "x", float("nan")), (502, "x", float("inf")), (503, "x", -0.3), (504, "x", 0.0), (0, "x", 5.0), (1, "x", 5.0), (1, "x", 5.0), (505, "x", 1e15), (506, "x", 9e6)]
AWKWARD_LINES = [
    (None, 1, 0, 1, 1, 5.0), (1, 1, None, 1, 1, 5.0), (1, 1, 0, 1, None, 5.0), (1, 1, 0, 1, 1, None), (1, 1, 0, 1, 0, 5.0), (1, 1, 900, 1, -3, 5.0), (1, 1, 900, 1, 7, -1.0), (1, 1, 900, 1, 1, float("nan")),
    (1, 1, 900, 1, 1, float("-inf")), (1, 1, 900, 1, 1, 1e15), (1, 1, 900, 1, 1, 0.0), (2, None, 900, 1, 1, 5.0), (2, None, 900, 1, 1, 5.0), (3, 1, 901, 1, 2, 9e6 * 2.005), (4, 1, 901, 1, 1, 9e6 / 1.005),
]


@pytest.mark.parametrize(
    ("seed", "n_items", "n_lines", "low", "high", "hot"), [(1, 30, 400, 1, 3, 0.0), (2, 40, 400, 50, 5000, 0.3), (3, 3, 600, 10, 10.2, 0.6), (4, 2, 300, 10, 10.1, 0.95), (5, 60, 300, 101, 103.5, 0.1)]
)
def test_band_join_is_all_pairs(spark, seed, n_items, n_lines, low, high, hot):
    items, lines = shop(seed, n_items, n_lines, lambda rng: round(rng.uniform(low, high), 2), hot)
    items, lines = items + AWKWARD_ITEMS, lines + AWKWARD_LINES
    i, x = spark.createDataFrame(items, ITEMS).repartition(3), spark.createDataFrame(lines, LINES).repartition(3)
    clash = {c: F.lit("clash") for c in ("u", "p", "gap", "n", "crc", "near", "lines", "before", "bucket", "b", "v")}
    found = bandjoin.nearest_lines(i.withColumns(clash), x.withColumns(clash))
    assert found.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_band(items, lines)


def test_band_edges(spark):
    """Gaps of 50 and 51 cents, and of just 0.5 % and a cent more, on either side and at bucket borders."""
    prices = [1, 49, 50, 51, 64, 127, 128, 9_999, 10_000, 10_199, 10_200, 10_250, 10_251, 12_800, 20_000, 1_000_000, 123_456_789]
    points = sorted({max(0, q + s * d) for q in prices for s in (-1, 1) for d in (0, 49, 50, 51, q // 200 - 1, q // 200, q // 200 + 1, q // 201, q // 201 + 1, q - q * 200 // 201)})
    items = [(k, "x", q / 100) for k, q in enumerate(prices)]
    lines = [(k, 1, 1000, 1, 1, u / 100) for k, u in enumerate(points)]
    found = bandjoin.nearest_lines(spark.createDataFrame(items, ITEMS), spark.createDataFrame(lines, LINES))
    assert sorted(map(tuple, found.collect()), key=str) == plain_band(items, lines)


def test_band_join_of_empty_tables(spark):
    items, lines = shop(1, 5, 20, lambda rng: 5.0)
    i, x = spark.createDataFrame(items, ITEMS), spark.createDataFrame(lines, LINES)
    assert bandjoin.nearest_lines(i.limit(0), x).count() == 0
    assert {tuple(r)[1:] for r in bandjoin.nearest_lines(i, x.limit(0)).collect()} == {(0, None, None, None, None, None, 0, 0, 0)}


# manifest


def plain_leaf(row, add=0):
    out = []
    for k in (0, 3, 2, 4, 1):
        v = row[k]
        v = v + add if k == 4 and v is not None else v
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha(*out)


def grown(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        yield i & 1, level[i ^ 1] if i ^ 1 < len(level) else None
        i >>= 1


def plain_proofs(table_rows):
    by = {}
    for r in table_rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append(grown([plain_leaf(r) for r in by[x]]))
    top, out = grown([t[-1][0] for t in trees]) if trees else None, []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            path = [*steps(trees[k], i), *steps(top, k)]
            h = plain_leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, s in path:
                h = sha(s, h) if left else sha(h, s or "")
            out.append((r[0], plain_leaf(r), trees[k][-1][0], top[-1][0], sha(*(s or "" for _, s in path)), h, h == top[-1][0]))
    return sorted(out, key=str)


def languages(n, seed=5):
    rng = random.Random(seed)
    names = ["en"] * n + ["de", "fr", None, None, "Z", "é", "a\x00b", ""]
    return [(rng.randrange(-5, 10**6) if rng.random() > 0.02 else None, rng.choice([None, "", "té xt", "b"]), names[k % len(names)] if k else "en", rng.choice([None, "s"]), rng.choice([None, 0, -1, 2**63 - 1])) for k in range(n + 8)]


@pytest.mark.parametrize("some", [rows(), rows()[:1], rows()[:2], [(k, "t", "en", "s", 1) for k in range(5)], [(k, "t", f"l{k % 37:02}", "s", k) for k in range(90)], languages(40), [(1, "t", None, None, 3)] * 9, []])
def test_proofs_are_the_plain_tree(spark, some):
    df = clashing(spark.createDataFrame(some, SCHEMA).repartition(4)).withColumns({c: F.lit("clash") for c in ("tree", "index", "hash", "size", "level", "place", "leaf", "path", "tie")})
    found = manifest.proofs(df)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_proofs(some)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_tiers_don_t_matter(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    some = languages(70)
    assert sorted(map(tuple, manifest.proofs(spark.createDataFrame(some, SCHEMA).repartition(4)).collect()), key=str) == plain_proofs(some)


def test_tampering_shows(spark):
    some = [(k, "t", "en", "s", k) for k in range(64)]
    found = {r["doc_id"]: r["verified"] for r in manifest.proofs(spark.createDataFrame(some, SCHEMA)).collect()}
    assert found == {k: zlib.crc32(str(k).encode()) % 7 != 0 for k in range(64)} and len(set(found.values())) == 2
    assert len(list(itertools.filterfalse(found.get, found))) > 2
