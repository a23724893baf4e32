"""Near-duplicate documents by HyperMinHash, banding and confirmation on whole shingle sets.

A document's set holds the hashes of its distinct word shingles. Equal sets are one class from the start. A class's
sketch has one register a bucket: the smallest hash that fell there, stored as a leading-zero count and mantissa bits
(Yu and Weber, "HyperMinHash", 2017). Runs of registers make bands; classes that share a band are candidates:

1. every class against the smallest class of each of its bands; confirmed links join components;
2. where one band still holds several components, pairs from different components of that band. Sizes of similar sets
   differ by a bounded factor, so a large band is cut into overlapping zones of sizes. Members of small zones, and of small
   bands whole, meet with their sketches in groups of many zones; large zones are compared block against block of at most
   about `BLOCK` classes and `BLOCK_BYTES` of sets. So a row is made for a member, never for a pair that comes to nothing.

Sets of up to `SMALL` shingles travel whole in their sketches' place, so pairs of these are decided at once. For others
registers give a collision-corrected estimate of the similarity; a pair whose estimate falls short of the threshold by
more than five standard errors, reckoned from the registers that are full, goes no further, any other is confirmed on
the full sets. Blocks compare sketches only; texts go just to blocks' members that have a likely partner there. A pair
inside one component can't change the result, so step 2 leaves it out: large groups of copies need no pairs of their own.

With 48 bands of 4 registers a pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**48 = 1.2e-8 if its
sets fill the registers; sets of a few shingles fill few bands, and share none more often.

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer words than a shingle make
one shingle of all words; texts count whole; rows with null ids are left out; ids must be unique; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, mix64, text_bytes, windows_of, words_of, written

BANDS, ROWS = 48, 4
BUCKETS = BANDS * ROWS
#: Bits of a register: a leading-zero count and a mantissa. Short documents leave most registers of a band empty, so
#: the mantissa alone has to tell them apart.
COUNT_BITS, MANTISSA_BITS = 6, 26
#: Shingles up to which a set travels whole.
SMALL = 64
#: Classes in a block of a large band, and bytes of their sets, at most.
BLOCK, BLOCK_BYTES = 1500, 24 << 20
#: Members of small zones in a group, about.
GROUP = 1000
#: Ids that are broadcast at most (8 bytes each).
FEW_IDS = 1_000_000
_EDGES = np.array([-(-i * (1 << 64) // BUCKETS) for i in range(BUCKETS)], np.uint64)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, words: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, _, _, first = words_of(body, offsets, lower)
    whole = windows_of(hashes, words)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            salt = np.uint64(0x2545F4914F6CDD1D * int(b - a) & (1 << 64) - 1)
            out.append(mix64(windows_of(hashes[a:b], int(b - a)) + salt))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted hash set: 0 where a bucket is empty, else leading zeros and mantissa of its least value."""
    out = np.zeros(BUCKETS, np.uint32)
    at = np.searchsorted(shingles, _EDGES)
    ends = np.append(at[1:], len(shingles))
    full = np.flatnonzero(at < ends)
    # hashes fall into buckets by order, so the first of a bucket is its least; what it exceeds the edge by is uniform
    with np.errstate(over="ignore"):
        value = (shingles[at[full]] - _EDGES[full]) * np.uint64(BUCKETS)
    top = (value >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    _, exponent = np.frexp(np.maximum(top, 0.5))
    zeros = np.clip(53 - exponent, 0, (1 << COUNT_BITS) - 2).astype(np.uint64)
    with np.errstate(over="ignore"):
        mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out[full] = (((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint32)
    return out


def _keys(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bands' keys, and which bands aren't empty, of one row of registers or of many."""
    runs = registers.reshape(*registers.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + runs[..., r] + np.uint64(1))
    return key.view(np.int64), runs.any(axis=-1)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """A key for each band that isn't empty."""
    keys, full = _keys(registers)
    return keys[full]


def _band_index(registers: np.ndarray, key: int) -> int:
    return int(np.flatnonzero(_keys(registers)[0] == key)[0])


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of rows of registers, corrected for registers that agree by chance."""
    full = (a > 0) | (b > 0)
    n = np.maximum(full.sum(axis=1), 1)
    agree = ((a == b) & full).sum(axis=1)
    chance = n * 2.0**-MANTISSA_BITS
    return np.clip((agree - chance) / np.maximum(n - chance, 1e-9), 0, 1)


def possible(a: np.ndarray, b: np.ndarray, share: float, deviations: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of rows of registers, and which pairs go on to confirmation: not `deviations` errors below `share`."""
    e = estimate(a, b)
    full = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    return e, e >= share - deviations * np.sqrt(share * (1 - share) / full)


def signature(shingles: np.ndarray) -> bytes:
    """A small set whole, a larger one's registers."""
    return shingles.tobytes() if len(shingles) <= SMALL else sketch(shingles).tobytes()


def registers(own: bytes, n: int) -> np.ndarray:
    return np.frombuffer(own, np.uint32) if n > SMALL else sketch(np.frombuffer(own, np.uint64))


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): k1, k2 identify the set."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*text_bytes(batch.column(1)), words)
        with np.errstate(over="ignore"):
            k1 = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            k2 = [int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
        sigs = list(map(signature, sets))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), f, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary")


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, id, n_shingles) for every band of every class."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [bands_of(registers(x, n)) for x, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        each = [len(x) for x in own]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), *(pa.array(np.repeat(batch.column(c).to_numpy(), each)) for c in (0, 2))], ["key", "id", "n_shingles"])

    return map_batches(reps.select("id", "sig", "n_shingles"), f, "key bigint, id bigint, n_shingles bigint")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sure): links of two small sets, and other pairs whose estimate allows for a link."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        keep, sure = _near_sizes(na, nb, percent), (na <= SMALL) & (nb <= SMALL)
        for i in np.flatnonzero(keep & sure):
            keep[i] = similar(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), percent)
        rest = np.flatnonzero(keep & ~sure)
        if len(rest):
            r, t = (np.stack([registers(z[i], n[i]) for i in rest]) for z, n in ((x, na), (y, nb)))
            keep[rest] = possible(r, t, percent / 100)[1]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sure)], ["a", "b", "sure"]).filter(pa.array(keep))

    regs = reps.select("id", "n_shingles", "sig")
    both = pairs.join(regs.toDF("a", "na", "xa"), "a").join(regs.toDF("b", "nb", "xb"), "b").select("a", "b", "na", "nb", "xa", "xb")
    return map_batches(both, f, "a bigint, b bigint, sure boolean")


def _near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows with these ids. Few ids go to all tasks, so that other texts aren't shuffled; the texts of many are written, so that both sides of the next join are plain."""
    ids, texts = written(ids.distinct(), "ids"), docs.select(F.col("doc_id").alias("id"), "text")
    if ids.count() <= FEW_IDS:
        return texts.join(F.broadcast(ids), "id", "left_semi")
    return written(texts.join(ids, "id", "left_semi"), "texts")


def _confirmed(likely: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b): sure ones, and those with 100 * intersection >= percent * union of the full sets."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (shingle_sets(*text_bytes(batch.column(c)), words) for c in (2, 3))
        keep = [similar(s, t, percent) for s, t in zip(x, y, strict=True)]
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    likely = written(likely, "likely")
    pairs = likely.where("NOT sure").select("a", "b")
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return likely.where("sure").select("a", "b").unionByName(map_batches(both, f, "a bigint, b bigint"))


def _root(top: dict[int, int], c: int) -> int:
    while top.get(c, c) != c:
        c = top[c]
    return c


def _likely_within(members: DataFrame, groups: int, percent: int) -> DataFrame:
    """Pairs (a, b, sure) as of `_likely`, each once, between components within small zones of bands.

    members: (key, zone, place, id, c, n_shingles, sig). A pair is compared in the first band and in the zone of its larger
    set. Pairs whose components are joined by sure links of their group are left out.
    """

    def f(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("zone", "ascending"), ("id", "ascending")])
        key, zone, place, ids, comp, size = (group.column(k).to_numpy() for k in ("key", "zone", "place", "id", "c", "n_shingles"))
        sigs = group.column("sig").to_pylist()
        _, first, at = np.unique(ids, return_index=True, return_inverse=True)
        regs = np.stack([registers(sigs[i], size[i]) for i in first])
        runs = regs.reshape(-1, BANDS, ROWS)
        here = (_keys(regs)[0][at] == key[:, None]).argmax(axis=1)
        number = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (zone[1:] != zone[:-1])))
        found = []
        for d in range(1, int(np.bincount(number).max())):
            i = np.flatnonzero(number[d:] == number[:-d])
            i = i[(comp[i] != comp[i + d]) & _near_sizes(size[i], size[i + d], percent) & (np.maximum(place[i], place[i + d]) == zone[i])]
            x, y = at[i], at[i + d]
            fresh = ((runs[x] == runs[y]).all(axis=2) & (runs[x] > 0).any(axis=2)).argmax(axis=1) == here[i]
            sure = (size[i] <= SMALL) & (size[i + d] <= SMALL)
            keep = np.flatnonzero(fresh & (sure | possible(regs[x], regs[y], percent / 100)[1]))
            found += zip(i[keep].tolist(), (i[keep] + d).tolist(), sure[keep].tolist(), strict=True)
        top: dict[int, int] = {}
        out = []
        for i, j, sure in sorted(found, key=lambda x: not x[2]):
            a, b = _root(top, int(comp[i])), _root(top, int(comp[j]))
            if a == b or sure and not similar(np.frombuffer(sigs[i], np.uint64), np.frombuffer(sigs[j], np.uint64), percent):
                continue
            if sure:
                top[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j]), sure))
        a, b, sure = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return members.groupBy(F.pmod(F.xxhash64("key", "zone"), F.lit(groups)).alias("group")).applyInArrow(f, "a bigint, b bigint, sure boolean")


def _blocks(members: DataFrame, *keep: str) -> DataFrame:
    """Members (key, zone, id, ..., blocks) in each pair (x, y) of blocks that their own one (`own`) has part in."""
    out = members.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return out.select("key", "zone", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", *keep)


def _candidates(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a group: the later rows it has to be compared with here and the estimates, most likely first.

    A pair is compared in the first band and in the zone of its larger set, between blocks x and y, if its components
    differ.
    """
    key, zone, x, y = (group.column(k)[0].as_py() for k in ("key", "zone", "x", "y"))
    ids, comp, own, size, place = (group.column(k).to_numpy() for k in ("id", "c", "own", "n_shingles", "place"))
    regs = np.stack([registers(s, n) for s, n in zip(group.column("sig").to_pylist(), size.tolist(), strict=True)])
    runs = regs.reshape(-1, BANDS, ROWS)
    here = _band_index(regs[0], key)
    right = np.flatnonzero(own == y)
    for i in np.flatnonzero(own == x):
        js = right[(comp[right] != comp[i]) & _near_sizes(size[right], size[i], percent) & (np.maximum(place[right], place[i]) == zone)]
        js = js[ids[js] > ids[i]] if x == y else js
        if not len(js):
            continue
        e, keep = possible(regs[i][None], regs[js], percent / 100)
        js, e = js[keep], e[keep]
        if here and len(js):
            earlier = ((runs[js, :here] == runs[i, :here]).all(axis=2) & (runs[i, :here] > 0).any(axis=1)).any(axis=1)
            js, e = js[~earlier], e[~earlier]
        if len(js):
            yield int(i), js, e


def _hot_links(hot: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components within large zones of bands; at most a tree for each two blocks.

    hot: (key, zone, place, id, c, blocks, n_shingles, sig). First sketches alone are compared, which tells the members
    with a likely partner; then these meet again with their texts, pairs in descending order of their estimates, unless
    what was confirmed before already joins their components.
    """
    own = ["c", "place", "n_shingles", "sig"]
    schema = "key bigint, zone int, x bigint, y bigint, own bigint, id bigint, c bigint, place int, n_shingles bigint, sig binary"

    def likely(group: pa.Table) -> pa.Table:
        seen = np.zeros(len(group), bool)
        for i, js, _ in _candidates(group, percent):
            seen[i] = True
            seen[js] = True
        return group.select([x.split()[0] for x in schema.split(", ")]).filter(pa.array(seen))

    some = written(_blocks(hot, *own).groupBy("key", "zone", "x", "y").applyInArrow(likely, schema), "likely")
    texts = _texts(docs, some.where(F.col("n_shingles") > SMALL).select("id"))
    rows = some.join(texts, "id", "left").select(*some.columns, "text")

    def links(group: pa.Table) -> pa.Table:
        ids, comp, size = (group.column(k).to_numpy() for k in ("id", "c", "n_shingles"))
        found = [(float(e), i, int(j)) for i, js, es in _candidates(group, percent) for j, e in zip(js, es, strict=True)]
        top: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}
        sigs, texts = group.column("sig"), group.column("text")

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(sigs[i].as_py(), np.uint64) if size[i] <= SMALL else shingle_sets(*text_bytes(texts.slice(i, 1)), words)[0]
            return sets[i]

        out = []
        for _, i, j in sorted(found, reverse=True):
            a, b = _root(top, int(comp[i])), _root(top, int(comp[j]))
            if a != b and similar(of(i), of(j), percent):
                top[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("key", "zone", "x", "y").applyInArrow(links, "a bigint, b bigint")


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes; never with an empty set."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = np.concatenate([s, t])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and 100 * common >= percent * (len(both) - common)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, hot: int = 48) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): see the module's text.

    hot: classes from which on a zone of a band is compared block against block rather than in a group with other zones.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    known = written(sketches(docs, words), "sketches")
    some = known.where("n_shingles > 0")
    classes = written(some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    by_id = known.select(F.col("doc_id").alias("id"), "n_shingles", "sig")
    reps = by_id.join(classes.select("id"), "id", "left_semi")
    # grouped sides of joins are written, so that AQE can split a hot key on the other side
    bands = written(band_keys(reps), "bands")
    least = written(bands.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    shared = written(bands.join(least, "key").select("key", "id", "n_shingles", "b"), "shared")
    stars = shared.where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    links = written(_confirmed(_likely(stars, by_id, percent), docs, words, percent), "links")
    first = components(links)
    member = written(shared.join(first, "id", "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("c")), "members")
    mixed = written(member.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 < c1").select("key", "n"), "mixed")
    left, whole = member.join(mixed, "key"), F.col("n") <= hot
    # sets within the threshold's factor of each other have places that differ by 1 at most; a zone holds two places
    place = F.floor(F.log(F.col("n_shingles").cast("double")) / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.lit(0)
    zone = F.when(whole, F.array(F.lit(0))).otherwise(F.array("place", F.col("place") + 1))
    zones = written(left.withColumn("place", F.when(whole, 0).otherwise(place)).withColumn("zone", F.explode(zone)).drop("n"), "zones")
    sizes = written(zones.groupBy("key", "zone").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("n_shingles").alias("most")).where("c0 < c1").select("key", "zone", "n", "most"), "sizes")
    zones = zones.join(sizes, ["key", "zone"])

    def sketched(some: DataFrame, *own: str | Column) -> DataFrame:
        """A class meets its sketch once, with all its zones (two a band at most) in one row."""
        places = some.groupBy("id").agg(F.collect_list(F.struct("key", "zone", "place", "c", *own)).alias("places"))
        return written(places, "places").join(by_id, "id").select("id", "n_shingles", "sig", F.inline("places"))

    few = sizes.where(F.col("n") <= hot).agg(F.sum("n")).first()[0] or 0
    more = _confirmed(_likely_within(sketched(zones.where(F.col("n") <= hot)), -(-few // GROUP) or 1, percent), docs, words, percent)
    if sizes.where(F.col("n") > hot).limit(1).count():
        blocks = F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(BLOCK_BYTES) / (8 * F.col("most"))))).alias("blocks")
        more = more.unionByName(_hot_links(sketched(zones.where(F.col("n") > hot), blocks), docs, words, percent))
    more = written(more, "links")
    of_class = classes.join(components(links.unionByName(more)), "id", "left").select("k1", "k2", F.col("n_shingles").alias("n"), F.coalesce("component", "id").alias("c"))
    out = known.join(of_class, (known.k1 == of_class.k1) & (known.k2 == of_class.k2) & (known.n_shingles == of_class.n), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
