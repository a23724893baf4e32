"""A Merkle manifest of a table of documents: a tree for each language, a tree of their roots, and a proof for each row.

Leaves are numbered in order within their language: a range-partitioned sort is written, and a leaf's index is its place
in its run (a language's stretch of one sorted partition) plus the lengths of the language's earlier runs. So a language
of any share of the rows is sorted and numbered by many tasks; what is windowed is one row a run.

Trees grow in tiers of `LEVELS` levels: up to 2**LEVELS neighbours meet in a row, all their nodes are computed there and
written to the node table by coordinates (tree, level, index), and the topmost ones are the members of the next tier.
A proof comes from coordinates alone: each member explodes those of the siblings that its index and its tree's size ask
for, joins the node table, and orders and concatenates what it finds; a lone node has no sibling at its level. Members of
lower tiers take the rest of their proof from the one above them, so that no node near a root is joined by all leaves.
Folding a leaf with its path gives a root again; where it isn't the table's, leaf and table differ.

H is the lowercase hex sha256 of the concatenated inputs, digests as hex text. All of it is DataFrame functions.

Defined results: nulls in any column hash as `-`; a null language is a tree of its own, before the others; null ids come
first in their tree; rows with equal ids are ordered by their leaves, and equal rows are leaves of their own; a language
of one row has its leaf for subroot; a table with one language has its subroot for root; an empty table has no rows and
no root; other columns than the five that are hashed, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Columns that a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a tier: 2 to this power members meet in a row, of 64 bytes each.
LEVELS = 10


def _digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def _field(value: Column) -> Column:
    """`-`, or the UTF-8 bytes of the value's text behind their number."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered): tampered is the leaf of a row whose n_chars was raised by 1, null where no row was touched."""
    fields = {c: _field(docs[c]) for c in FIELDS}
    leaf = _digest(*fields.values())
    touched = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(7)) == 0
    more = fields | {"n_chars": _field(docs["n_chars"].cast("decimal(20,0)") + 1)}
    other = F.when(touched & docs["n_chars"].isNotNull(), _digest(*more.values()))
    return docs.select(docs["lang"].cast("string").alias("lang"), docs["doc_id"].cast("bigint").alias("doc_id"), leaf.alias("leaf"), other.alias("tampered"))


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` in order of `order`, nulls first, written with their `place`: a partition's number and the row's in it."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn("place", F.monotonically_increasing_id()), name)


def _runs(placed: DataFrame, group: str) -> DataFrame:
    """(group, run, first, before, size): each group's stretch of a partition, its first place, how many rows of the group come before it, and how many there are."""
    runs = placed.groupBy(group, F.shiftright("place", 33).alias("run")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(group, "run", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("size"))


def _members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their tree's number and size and their index in it; and (lang, tree, trees) of each language."""
    placed = _placed(rows.withColumn("tie", F.monotonically_increasing_id()), ["lang", "doc_id", "leaf", "tie"], "leaves")
    runs = _runs(placed, "lang")
    langs = _placed(runs.groupBy("lang").agg(F.lit(0).alias("all")), ["lang"], "languages")
    tops = _runs(langs, "all").select(F.col("run").alias("top_run"), "first", "before", F.col("size").alias("trees"))
    langs = langs.join(tops, F.shiftright("place", 33) == F.col("top_run")).select(F.col("lang").alias("tree_lang"), (F.col("before") + F.col("place") - F.col("first")).alias("tree"), "trees")
    langs = written(langs, "trees")
    found = runs.join(langs, F.col("lang").eqNullSafe(F.col("tree_lang"))).select(F.col("lang").alias("run_lang"), "run", "first", "before", "size", "tree")
    met = placed.join(found, (F.shiftright("place", 33) == F.col("run")) & F.col("lang").eqNullSafe(F.col("run_lang")))
    index = F.col("before") + F.col("place") - F.col("first")
    return written(met.select("tree", index.alias("index"), "size", F.unhex("leaf").alias("hash"), "doc_id", F.unhex("tampered").alias("tampered")), "members"), langs


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _levels(size: Column) -> Column:
    """How many levels of a tree of `size` members lie in a tier."""
    return F.size(F.filter(F.array(*(F.lit(1 << k) for k in range(LEVELS))), lambda width: width < size))


def nodes(members: DataFrame, name: str) -> DataFrame:
    """The node table of a tier, written: tree, level, index, hash, and size (members of the tree) and levels of the tree in this tier.

    `members` have tree, index, size and hash. A tree's topmost nodes, of level `levels`, are the next tier's members.
    """
    blocks = members.groupBy("tree", F.shiftright("index", LEVELS).alias("block")).agg(F.any_value("size").alias("size"), F.sort_array(F.collect_list(F.struct("index", "hash"))).alias("m"))
    blocks = blocks.withColumn("levels", _levels(F.col("size")))

    def above(row: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: F.unhex(_digest(_hex(F.get(row, 2 * i)), F.coalesce(_hex(F.get(row, 2 * i + 1)), F.lit("")))))

    steps = F.when(F.col("levels") > 0, F.sequence(F.lit(1), F.col("levels"))).otherwise(F.array().cast("array<int>"))
    rows = F.aggregate(steps, F.array(F.col("m.hash")), lambda had, _: F.concat(had, F.array(above(F.element_at(had, -1)))))
    by_level = blocks.select("tree", "block", "size", "levels", rows.alias("rows")).select("tree", "block", "size", "levels", F.posexplode("rows").alias("level", "row"))
    single = by_level.select("tree", "block", "size", "levels", "level", F.posexplode("row").alias("j", "hash"))
    index = F.call_function("shiftleft", F.col("block"), F.lit(LEVELS) - F.col("level")) + F.col("j")
    return written(single.select("tree", "level", F.when(F.col("level") == F.col("levels"), F.col("block")).otherwise(index).alias("index"), "hash", "size", "levels"), name)


def _paths(members: DataFrame, table: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, index, *payload, path): for each level of the tier what stands beside the member's ancestor, and on which side."""
    levels = _levels(F.col("size"))
    coordinates = members.select("tree", "index", *payload, F.explode_outer(F.when(levels > 0, F.sequence(F.lit(0), levels - 1))).alias("level"))
    at = F.call_function("shiftright", F.col("index"), F.coalesce("level", F.lit(0)))
    # what a member carries along travels once, with its lowest level
    own = [F.when(F.coalesce("level", F.lit(0)) == 0, F.col(c)).alias(c) for c in payload]
    coordinates = coordinates.select("tree", "index", *own, "level", at.bitwiseXOR(F.lit(1)).alias("beside"), (at.bitwiseAND(F.lit(1)) == 1).alias("left"))
    sought = table.where(F.col("level") < F.col("levels")).select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("index").alias("i"), F.col("hash").alias("sibling"))
    met = coordinates.join(sought, (F.col("tree") == F.col("t")) & (F.col("level") == F.col("l")) & (F.col("beside") == F.col("i")), "left")
    step = F.when(F.col("level").isNotNull(), F.struct("level", "left", "sibling"))
    return met.groupBy("tree", "index").agg(*(F.max(c).alias(c) for c in payload), F.sort_array(F.collect_list(step)).alias("steps")).select("tree", "index", *payload, F.transform("steps", lambda s: s.dropFields("level")).alias("path"))


def _grown(members: DataFrame, name: str) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """(members, node table) of each tier, and (tree, hash) of each tree's root."""
    tiers = []
    while (members.agg(F.max("size")).first()[0] or 0) > 1:
        table = nodes(members.select("tree", "index", "size", "hash"), f"{name}-nodes")
        tiers.append((members, table))
        size = F.call_function("shiftright", F.col("size") + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("levels")) - 1, F.col("levels"))
        members = table.where(F.col("level") == F.col("levels")).select("tree", "index", size.alias("size"), "hash")
    return tiers, members.select("tree", "hash")


def proven(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path) of each row; path: array of (left, sibling), from the leaf to the root."""
    members, langs = _members(leaves(docs))
    tiers, subroots = _grown(members, "leaf")
    tops = langs.join(subroots, "tree").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("index"), F.col("trees").alias("size"), "hash")
    top_tiers, root = _grown(tops, "top")
    no_path = F.array().cast("array<struct<left boolean, sibling binary>>")
    # from the root down: what each member has above it
    above = root.select("tree", F.lit(0).cast("bigint").alias("index"), F.col("hash").alias("root"), no_path.alias("upper"))
    for own, table in reversed(top_tiers):
        above = _joined(_paths(own, table, ["hash"]), above, ["root"])
    if not top_tiers:  # one tree: its subroot is the root
        above = above.withColumn("hash", F.col("root"))
    above = written(above.select(F.col("index").alias("tree"), F.lit(0).cast("bigint").alias("index"), F.col("hash").alias("subroot"), "root", "upper"), "above")
    for k, (own, table) in reversed(list(enumerate(tiers))):
        payload = ["hash", "doc_id", "tampered"] if k == 0 else []
        above = _joined(_paths(own, table, payload), above, ["subroot", "root"])
    if not tiers:  # each tree has one row, or there are none
        above = members.select("tree", "index", "hash", "doc_id", "tampered").join(above.drop("index"), "tree")
    return above.select("doc_id", _hex(F.col("hash")).alias("leaf"), _hex(F.col("tampered")).alias("tampered"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), F.transform("upper", lambda s: F.struct(s["left"].alias("left"), _hex(s["sibling"]).alias("sibling"))).alias("path"))


def _joined(paths: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """Paths of a tier, continued by those of the members above."""
    higher = above.select(F.col("tree").alias("t"), F.col("index").alias("i"), *carried, F.col("upper").alias("rest"))
    met = paths.join(higher, (F.col("tree") == F.col("t")) & (F.shiftright("index", LEVELS) == F.col("i")))
    return met.withColumn("upper", F.concat("path", "rest")).drop("t", "i", "path", "rest")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda had, s: F.when(s["left"], _digest(s["sibling"], had)).otherwise(_digest(had, F.coalesce(s["sibling"], F.lit("")))))


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    found = proven(docs)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join(F.col("path.sibling"), "").cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
