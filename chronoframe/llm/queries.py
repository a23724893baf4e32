"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bandjoin, bpe, decontaminate, embeddings, language, lines, manifest, minhash, nearest, packing, quality, secrets, substrings
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"), maximal=True)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), length=20, digest=True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op12_bandjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandjoin.nearest_lines(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"), k=10)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_minhash, op4_language, op5_packing, op6_lines, op7_substrings, op8_secrets, op9_nearest, op10_embeddings, op11_decontamination, op12_bandjoin, op13_manifest)}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.id),
top AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, top.c AS component_id, d.doc_id = top.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN top ON top.id = d.doc_id"""

_OP6 = f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM t),
k AS (SELECT doc_id, p, ls[p] AS x, len({_WORDS.format("ls[p]")}) AS c FROM l),
u AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY p) AS cum FROM k),
w AS (SELECT a.doc_id, a.p, b.p AS q, b.cum - a.cum AS later, min(b.p) OVER (PARTITION BY a.doc_id, a.p) AS least FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.cum - a.cum + a.c >= 10 AND b.cum - a.cum - b.c < 10 WHERE a.c > 0),
q AS (SELECT doc_id, p, q FROM w WHERE q = least OR later < 10),
g AS (SELECT doc_id, p, q, row_number() OVER (PARTITION BY array_to_string(ls[p:q], chr(10)), q - p ORDER BY doc_id, p) AS n FROM q JOIN t USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS p FROM g WHERE n > 1)
SELECT k.doc_id, count(*) AS n_lines, count(gone.p) AS n_removed, sha256(coalesce(string_agg(x, chr(10) ORDER BY k.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.p = k.p GROUP BY k.doc_id"""

_OP7 = f"""WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: struct_pack(p := i, g := array_to_string(w[i:i + 19], ' '))), recursive := true) FROM t WHERE len(w) >= 20),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM f WHERE n > 1),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: struct_pack(p := i, x := w[i])), recursive := true) FROM t)
SELECT d.doc_id, count(k.p) AS n_words, count(gone.p) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY k.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.p = k.p GROUP BY d.doc_id"""

_OP10 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
top AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, top.c AS component_id, e.vec_id = top.c AS kept
FROM embeddings e JOIN top ON top.id = e.vec_id"""


_OP11_WORDS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".format(_FOLDED)
_OP11 = f"""WITH d AS (SELECT doc_id, {_OP11_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP11_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT x.doc_id, x.i, x.k, g.item_id FROM x JOIN g USING (k, g)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""


def _crc32(text: str) -> str:
    """DuckDB has no crc32; this is SQL for that of a short ASCII text."""
    bits = "list_reduce(range(8), lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b))"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT), lambda c, b: {bits}, 4294967295::BIGINT), 4294967295)"


_U = "CASE WHEN quantity <> 0 THEN (2 * a + quantity) // (2 * quantity) - CASE WHEN (2 * a + quantity) % (2 * quantity) <> 0 AND (2 * a + quantity < 0) <> (quantity < 0) THEN 1 ELSE 0 END END"
_OP12 = f"""WITH l AS (SELECT *, {_crc32("concat_ws(',', sale_id, coalesce(line_no::VARCHAR, ''), line_item_id)")} AS crc FROM (
    SELECT sale_id, line_no::BIGINT AS line_no, item_id AS line_item_id, {_U} AS u
    FROM (SELECT *, floor(100 * amount + 0.5)::BIGINT AS a FROM (SELECT sale_id, line_no, item_id, quantity::BIGINT AS quantity, amount FROM sale_lines WHERE isfinite(amount) AND sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL))) WHERE u IS NOT NULL),
i AS (SELECT row_number() OVER () AS k, item_id, CASE WHEN isfinite(price) THEN floor(100 * price + 0.5)::BIGINT END AS p FROM items),
x AS (SELECT k, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc FROM i JOIN l ON l.u BETWEEN p - p // 100 - 50 AND p + p // 100 + 50 AND i.item_id <> line_item_id WHERE abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS n FROM x),
s AS (SELECT k, count(*) AS n_pairs, sum(gap) AS gap_sum, sum(crc) AS lines_crc FROM x GROUP BY k)
SELECT item_id, coalesce(n, 0)::INTEGER AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0)::BIGINT AS n_pairs, coalesce(gap_sum, 0)::BIGINT AS gap_sum, coalesce(lines_crc, 0)::BIGINT AS lines_crc
FROM i LEFT JOIN s USING (k) LEFT JOIN (SELECT * FROM r WHERE n <= 10) r USING (k)"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


_OP13 = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) END AS tampered FROM documents),
m AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
t(tree, lev, idx, h, n) AS (SELECT tree, 0, idx, leaf, n FROM m UNION ALL SELECT tree, lev + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, lev, idx // 2, n),
top(lev, idx, h, n) AS (SELECT 0, tree, h, (SELECT max(tree) + 1 FROM m) FROM t WHERE n = 1 UNION ALL SELECT lev + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lev, idx // 2, n),
lev AS (SELECT DISTINCT tree, lev FROM t WHERE n > 1), toplev AS (SELECT DISTINCT lev FROM top WHERE n > 1), depth AS (SELECT tree, count(*) AS depth FROM lev GROUP BY tree),
step AS (SELECT m.tree, m.idx, lev.lev AS lev, (m.idx >> lev.lev::BIGINT) & 1 = 1 AS on_left, t.h FROM m JOIN lev ON lev.tree = m.tree LEFT JOIN t ON t.tree = m.tree AND t.lev = lev.lev AND t.idx = xor(m.idx >> lev.lev::BIGINT, 1)
    UNION ALL SELECT m.tree, m.idx, coalesce(depth, 0) + toplev.lev, (m.tree >> toplev.lev::BIGINT) & 1 = 1, top.h FROM m CROSS JOIN toplev LEFT JOIN depth USING (tree) LEFT JOIN top ON top.lev = toplev.lev AND top.idx = xor(m.tree >> toplev.lev::BIGINT, 1)),
f(tree, idx, lev, h) AS (SELECT tree, idx, 0, coalesce(tampered, leaf) FROM m UNION ALL SELECT f.tree, f.idx, f.lev + 1, sha256(CASE WHEN step.on_left THEN step.h || f.h ELSE f.h || coalesce(step.h, '') END) FROM f JOIN step USING (tree, idx, lev)),
folded AS (SELECT tree, idx, max_by(h, lev) AS h FROM f GROUP BY tree, idx),
proof AS (SELECT tree, idx, sha256(coalesce(string_agg(h, '' ORDER BY lev), '')) AS h FROM step GROUP BY tree, idx)
SELECT m.doc_id, m.leaf, t.h AS subroot, top.h AS root, coalesce(proof.h, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = top.h AS verified
FROM m JOIN t ON t.tree = m.tree AND t.n = 1 JOIN top ON top.n = 1 JOIN folded ON folded.tree = m.tree AND folded.idx = m.idx LEFT JOIN proof ON proof.tree = m.tree AND proof.idx = m.idx"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are held against brute force and libraries in the tests."""
    return {"op3_minhash": _OP3, "op6_lines": _OP6, "op7_substrings": _OP7, "op10_embeddings": _OP10, "op11_decontamination": _OP11, "op12_bandjoin": _OP12, "op13_manifest": _OP13}
