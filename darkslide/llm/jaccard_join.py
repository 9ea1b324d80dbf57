"""Join of all texts whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. One pass over the texts: the set of n-grams as 64-bit hashes, its digest, and MinHash band hashes.
   Bands and rows are chosen so that a pair at the threshold shares a band with the wanted recall.
2. Texts with equal sets are one class from here on, however many there are (partial aggregation).
3. Classes that share a band hash are candidates. Each is tied to the least class of its band bucket,
   so a bucket of n gives n - 1 edges; the components of those edges bound where links can be.
4. The full sets of the classes in components are read again from the texts and compared, whether a pair shares a band itself
   or not, in blocks of about BLOCK_CLASSES classes and BLOCK_HASHES hashes:
   a component that fits is one block; a larger one is first compared with its most central class (linear
   work), and from there on a class is its size and its difference from that one, which gives intersections exactly and is small for
   near copies. Classes within half the allowed distance of that one are similar to each other, since the Jaccard distance obeys
   the triangle inequality, so their links are counted without comparing them. The other classes ask all
   classes of the component, block by block, or, where that moves fewer rows, those of their band
   buckets, where a pair counts in the first band it shares, so here alone one that shares none is missed. No pair is
   emitted: a task returns each class's number of links and its place in a forest of links.
5. The forests of all tasks are joined to the final groups.

Texts without a word have no n-grams and so no links. A text of one to four words has one n-gram, all
its words. Classes are named by 64 bits of their digest: among n different texts two
share a name with probability under n * n / 2 ** 65. A text's n-grams are held whole by the task
that handles it, 8 bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.llm.textbuf import arrow_map, byte_chunks, distinct_per_row, mix, shingles_of, U, words_of
from darkslide.operators.graph import connected_components
from darkslide.plans.session import discard, free_shuffles, materialize, unused_name

#: Classes and n-gram hashes of a block side, on average.
BLOCK_CLASSES = 512
BLOCK_HASHES = 1 << 20
#: A large component's sides are parted in about so many, until they have 8 * BLOCK_CLASSES classes each.
BLOCK_PARTS = 32
#: Up to so many keys (8 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_KEYS = 4_000_000


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int


def choose_banding(threshold: float, recall: float, most_hashes: int = 256) -> Banding:
    """The most rows a band (so the fewest false candidates) for which the bands that give the recall
    at the threshold need at most most_hashes hash functions."""
    best = None
    for rows in range(1, most_hashes + 1):
        miss = 1 - threshold**rows
        bands = 1 if miss <= 0 else int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows > most_hashes:
            break
        best = Banding(bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def minhash_bands(values: np.ndarray, rows: np.ndarray, n: int, banding: Banding) -> np.ndarray:
    """(n, bands) band hashes of the sets given as (value, row) in order of row. Rows without
    values keep 0."""
    out = np.zeros((n, banding.bands), np.uint64)
    if not len(values):
        return out
    rng = np.random.default_rng(8128)
    k = banding.bands * banding.rows
    a = rng.integers(0, 1 << 63, k, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    has = rows[first]
    work = np.empty(len(values), np.uint64)
    for band in range(banding.bands):
        h = np.full(len(first), band, np.uint64)
        for i in range(band * banding.rows, (band + 1) * banding.rows):
            np.multiply(values, a[i], out=work)
            np.add(work, b[i], out=work)
            h = mix(h * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(work, first))
        out[has, band] = h
    return out


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, values, rows, ends) of the distinct n-grams of each text."""
    for lo, hi, data, offsets in byte_chunks(column):
        values, rows = distinct_per_row(*shingles_of(words_of(data, offsets), size))
        yield lo, hi, values, rows, np.searchsorted(rows, np.arange(hi - lo + 1))


def _digest(values: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(docs: DataFrame, key: str, text: str, size: int, banding: Banding) -> DataFrame:
    """key, n_grams, d1, d2 (digest of the set; null without n-grams), bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, rows, ends in _sets(batch.column(1), size):
                bands = minhash_bands(values, rows, hi - lo, banding).view(np.int64)
                d = [_digest(values[i:j]) if j > i else (None, None) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * banding.bands, pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), lists], ["key", "n_grams", "d1", "d2", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.transform(arrow_map, run, f"key {kind}, n_grams bigint, d1 bigint, d2 bigint, bands array<bigint>")


def full_sets(docs: DataFrame, keys: DataFrame, n_keys: int, key: str, text: str, size: int) -> DataFrame:
    """cid, hashes (binary) of the texts whose key is in keys (column rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _lo, _hi, values, _rows, ends in _sets(batch.column(0), size):
                parts = [values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(p)[0] for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["cid", "hashes"])

    rows = docs.select(F.col(key).alias("rep"), F.col(text).cast("string").alias("text"))
    side = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys
    return rows.join(side, "rep", "left_semi").select("text").transform(arrow_map, run, "cid bigint, hashes binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(n, m) sizes of the intersections of distinct hashes. Values in few sets add their pairs one by
    one, those in many go through a product of 0/1 matrices, some columns at a time."""
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.float32)
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(map(len, left))
    sides = []
    for sets, at in ((left, place[:split]), (right, place[split:])):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(at, kind="stable")
        df = np.bincount(at, minlength=len(values))
        sides.append((owner[order], at[order], df, np.cumsum(df) - df))
    (own_a, at_a, df_a, begin_a), (own_b, at_b, df_b, begin_b) = sides
    pairs = df_a * df_b
    few = np.flatnonzero((pairs > 0) & (pairs <= 64))
    ends = np.cumsum(pairs[few])
    lo = 0
    while lo < len(few):  # at most some millions of pairs at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 21), "right")))
        v = few[lo:hi]
        k = np.arange(int(pairs[v].sum())) - np.repeat(np.cumsum(pairs[v]) - pairs[v], pairs[v])
        v = np.repeat(v, pairs[v])
        a, b = own_a[begin_a[v] + k // df_b[v]], own_b[begin_b[v] + k % df_b[v]]
        if len(a) * 8 > n * m:
            out += np.bincount(a * m + b, minlength=n * m).reshape(n, m)
        else:
            np.add.at(out, (a, b), 1)
        lo = hi
    many = np.flatnonzero(pairs > 64)
    for i in range(0, len(many), 2048):
        some = many[i : i + 2048]
        column = np.full(len(values), -1)
        column[some] = np.arange(len(some))
        dense = []
        for own, at, size in ((own_a, at_a, n), (own_b, at_b, m)):
            c = column[at]
            x = np.zeros((size, len(some)), np.float32)
            x[own[c >= 0], c[c >= 0]] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether intersections of that size reach the threshold, for sets of sizes a and b."""
    return both >= np.float32(threshold) * (a + b - both) - np.float32(1e-3)


@dataclass
class Rows:
    """Classes of one side of a block. sets: their n-grams, or for all sides of the block how they differ from one and the same
    set; sizes: their numbers of n-grams."""

    cids: np.ndarray
    copies: np.ndarray
    central: np.ndarray
    bands: np.ndarray
    sets: list[np.ndarray]
    sizes: np.ndarray | None = None


def roots(linked: np.ndarray) -> np.ndarray:
    """The least number in each one's component, for a symmetric matrix of links."""
    n = len(linked)
    root = np.arange(n, dtype=np.int32)
    while True:
        near = np.where(linked, root[None, :], n).min(1, initial=n)
        low = np.minimum(root, near).astype(np.int32)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def verify(left: Rows, right: Rows | None, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, class that it is tied to, number of linked documents) of a block.

    A pair counts if its sets reach the threshold and, unless `band` is -1, if that is the first band that it shares. Without a right
    side all pairs of the left one are compared. Otherwise the left classes ask and the right ones are asked: an asking class counts
    all its links, an asked one only if it is central, since it asks for itself elsewhere if it isn't."""
    other = right or left
    held_a, held_b = (np.array([len(s) for s in x.sets], np.float32) for x in (left, other))
    size_a, size_b = (h if x.sizes is None else x.sizes.astype(np.float32) for x, h in ((left, held_a), (other, held_b)))
    # differences from one set differ from each other as the sets do
    apart = held_a[:, None] + held_b[None, :] - 2 * intersections(left.sets, other.sets)
    linked = similar((size_a[:, None] + size_b[None, :] - apart) / 2, size_a[:, None], size_b[None, :], threshold)
    linked &= left.cids[:, None] != other.cids[None, :]
    if band >= 0:  # a pair that shares other bands as well meets in their buckets too
        a, b = np.nonzero(linked)
        same = left.bands[a] == other.bands[b]
        first = same[:, band] & ~same[:, :band].any(1)
        linked[a[~first], b[~first]] = False
    if right is None:
        return left.cids, left.cids[roots(linked)], linked @ left.copies
    n = len(left.cids)
    square = np.zeros((n + len(right.cids),) * 2, bool)
    square[:n, n:], square[n:, :n] = linked, linked.T
    cids = np.concatenate([left.cids, right.cids])
    links = np.concatenate([linked @ right.copies, np.where(right.central, left.copies @ linked, 0)])
    tied = square.any(1)
    return cids[tied], cids[roots(square)][tied], links[tied]


def _in_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal values of names."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[c] != held[0][c] for c in names):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _verify_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: g (block), band, side (-1: a block without sides, 0 asking, 1 asked), cid, copies, central, bands,
    hashes, n_grams. Returns cid, root, n of each block."""

    def side(rows: list[dict]) -> Rows:
        return Rows(np.array([r["cid"] for r in rows], np.int64), np.array([r["copies"] for r in rows], np.int64), np.array([r["central"] for r in rows], bool),
                    np.array([r["bands"] for r in rows], np.int64), [np.frombuffer(r["hashes"], np.uint64) for r in rows], np.array([r["n_grams"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_groups(batches, ["g"]):
            left = [r for r in rows if r["side"] < 1]
            right = [r for r in rows if r["side"] == 1]
            if not left or (len(left) == 1 and not right) or (left[0]["side"] == 0 and not right):
                continue
            found = verify(side(left), side(right) if right else None, left[0]["band"], threshold)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["cid", "root", "n"])

    dealt = rows.repartition("g").sortWithinPartitions("g")
    return dealt.select("g", "band", "side", "cid", "copies", "central", "bands", "hashes", "n_grams").transform(arrow_map, run, "cid bigint, root bigint, n bigint")


def _near_center(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: component, chunk, is_center, cid, hashes; the center is in every chunk. Returns cid, root (the center for classes
    within half the allowed distance of it, else null) and hashes (those of the class or of the center, but not of both). A task holds the
    center's set and a batch of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, center, cid = None, np.zeros(0, np.uint64), 0
        for batch in batches:
            found: list[tuple[int, int | None, bytes]] = []
            for r in batch.to_pylist():
                values = np.frombuffer(r["hashes"], np.uint64)
                if (r["component"], r["chunk"]) != now:  # the center comes first
                    now, center, cid = (r["component"], r["chunk"]), values, r["cid"]
                both = len(np.intersect1d(center, values, assume_unique=True))
                near = both >= (1 + threshold) / 2 * (len(center) + len(values) - both)
                found.append((r["cid"], cid if near else None, np.setxor1d(center, values, assume_unique=True).tobytes()))
            if found:
                cells = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(cells, ["cid", "root", "hashes"])

    dealt = rows.repartition("component", "chunk").sortWithinPartitions("component", "chunk", F.desc("is_center"))
    return dealt.select("component", "chunk", "cid", "hashes").transform(arrow_map, run, "cid bigint, root bigint, hashes binary")


def _chunks(classes: Column, hashes: Column) -> Column:
    side = F.greatest(F.lit(BLOCK_CLASSES), F.least(F.lit(8 * BLOCK_CLASSES), F.ceil(classes / BLOCK_PARTS)))
    return F.greatest(F.ceil(classes / side), F.ceil(hashes / BLOCK_HASHES)).cast("int")


def _blocks(members: DataFrame, group: list[str], band: Column) -> DataFrame:
    """g, band, side, cid, copies, central, n_grams: the asking members (asks) of each group beside all of its members, in
    blocks of bounded size. members: group columns, cid, copies, n_grams, n_hashes, asks, and per group asking, asking_hashes, n, hashes."""
    m = members.where("asking > 0").withColumns({"rows": _chunks(F.col("asking"), F.col("asking_hashes")), "cols": _chunks(F.col("n"), F.col("hashes"))})
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = m.where("asks").withColumns({"i": part("rows"), "j": every("cols"), "side": F.lit(0)})
    right = m.withColumns({"j": part("cols"), "i": every("rows"), "side": F.lit(1)})
    return left.unionByName(right).select(F.xxhash64(*group, "i", "j").alias("g"), band.alias("band"), "side", "cid", "copies", (~F.col("asks")).alias("central"), "n_grams")


def _counted(members: DataFrame, group: list[str], size: str) -> DataFrame:
    """members with the sums that _blocks needs, by partial aggregation; size: the column with the number of a group's members.
    The sums go to as many parts of a large group as its members are dealt over, so none meets in one task."""
    asks = lambda x: F.sum(F.when(F.col("asks"), x).otherwise(0))
    parts = lambda n: F.ceil(F.col(n) / BLOCK_CLASSES).cast("int")
    sums = members.groupBy(*group).agg(asks(F.lit(1)).alias("asking"), asks(F.col("n_hashes")).alias("asking_hashes"), F.count("*").alias("n"), F.sum("n_hashes").alias("hashes"))
    sums = sums.withColumn("part", F.explode(F.sequence(F.lit(0), parts("n") - 1)))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("cid"), parts(size)).cast("int"))
    return dealt.drop("n", "hashes", "size").join(sums, [*group, "part"]).drop("part")


def _verify_large(large: DataFrame, buckets: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows for _verify_blocks, links found without it, tables that these read) of components that are no single block.

    large: component, cid, copies, n_grams, n, hashes; buckets: band, h, size, cid."""
    n = large.select("component").distinct().count()
    per_component = lambda df: F.broadcast(df) if n <= BROADCAST_KEYS else df
    mine = materialize(buckets.join(large.select("cid", "component"), "cid"), "large-buckets")
    degree = mine.groupBy("cid").agg(F.sum("size").alias("degree"))
    center = large.join(degree, "cid").groupBy("component").agg(F.max_by("cid", F.struct("degree", "copies", "cid")).alias("center"))
    star = large.join(per_component(center), "component").withColumn("chunks", _chunks(F.col("n"), F.col("hashes"))).withColumn("is_center", F.col("cid") == F.col("center"))
    chunk = F.when(F.col("is_center"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")))
    star = star.select("component", F.explode(chunk).alias("chunk"), "is_center", "cid").join(sets, "cid")
    central = materialize(_near_center(star, threshold), "central")
    near = central.dropDuplicates(["cid"])  # the center comes from every chunk
    found = near.select("cid", "root", (F.octet_length("hashes") / 8).cast("long").alias("n_hashes"))
    judged = materialize(large.join(found, "cid").withColumn("asks", F.col("root").isNull()), "judged")
    total = judged.where("not asks").groupBy("component").agg(F.sum("copies").alias("total"))
    known = judged.where("not asks").join(per_component(total), "component").select("cid", "root", (F.col("total") - F.col("copies")).alias("n"))

    # whole components or buckets: whichever moves fewer rows
    whole = _counted(judged, ["component"], "n")
    by_bucket = _counted(mine.join(judged.select("cid", "copies", "n_grams", "n_hashes", "asks"), "cid"), ["band", "h"], "size")
    cost = F.when(F.col("asks"), _chunks(F.col("n"), F.col("hashes"))).otherwise(0) + _chunks(F.col("asking"), F.col("asking_hashes"))
    costs = [x.groupBy("component").agg(F.sum(cost).alias("cost")) for x in (whole, by_bucket)]
    better = costs[0].join(costs[1].withColumnRenamed("cost", "other"), "component").select("component", (F.col("cost") <= F.col("other")).alias("as_one"))
    better = materialize(better, "block-choice")
    one = _blocks(whole.join(per_component(better.where("as_one")), "component", "left_semi"), ["component"], F.lit(-1))
    many = _blocks(by_bucket.join(per_component(better.where("not as_one")), "component", "left_semi"), ["band", "h"], F.col("band"))
    return one.unionByName(many).join(near.select("cid", "hashes"), "cid"), known, [mine, central, judged, better]


def _judged_rows(docs: DataFrame, key: str, text: str, size: int, threshold: float, recall: float) -> DataFrame:
    """key, n_grams, d1 (digest of the set; null without a key or n-grams), rep (least key with an equal set), copies,
    class_rep and class_d1 (the group's least key and one of its digests that has it), other_links of every row."""
    banding = choose_banding(threshold, recall)
    sig = materialize(signatures(docs, key, text, size, banding), "signatures")
    usable = sig.where("d1 is not null and key is not null")
    named = usable.groupBy(F.col("d1").alias("cid")).agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"))
    classes = materialize(named, "classes")

    # candidates: bucket stars over one row per class and band. The rows of a class's copies are
    # equal, so they fall together in the partial aggregation.
    entries = usable.select(F.col("d1").alias("cid"), F.posexplode("bands").alias("band", "h")).groupBy("band", "h", "cid").agg(F.lit(1).alias("one")).select("band", "h", "cid")
    entries = materialize(entries, "bands")
    sizes = entries.groupBy("band", "h").agg(F.count("*").alias("size"), F.min("cid").alias("pivot")).where("size > 1")
    buckets = materialize(entries.join(sizes, ["band", "h"]), "buckets")
    discard(entries)
    free_shuffles(docs.sparkSession)
    parts = materialize(connected_components(buckets.select(F.col("cid").alias("src"), F.col("pivot").alias("dst")).where("src <> dst").distinct()), "candidates")

    members = parts.select(F.col("node").alias("cid"), "component").join(classes, "cid")
    sums = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_grams").alias("hashes"))
    members = materialize(members.join(sums, "component"), "members")
    sets = lambda some: full_sets(docs, some.select("rep").distinct(), some.count(), key, text, size).dropDuplicates(["cid"])
    bands = usable.select(F.col("d1").alias("cid"), "key", "bands").join(members.select("cid", F.col("rep").alias("key")), ["cid", "key"]).dropDuplicates(["cid"]).select("cid", "bands")
    fits = (F.col("n") <= BLOCK_CLASSES) & (F.col("hashes") <= BLOCK_HASHES)
    small, large = members.where(fits), members.where(~fits)
    blocks = small.select(F.xxhash64("component", F.lit(-1)).alias("g"), F.lit(-1).alias("band"), F.lit(-1).alias("side"), "cid", "copies", F.lit(False).alias("central"), "n_grams").join(sets(small), "cid")
    known, used = None, []
    if not large.isEmpty():
        more, known, used = _verify_large(large.drop("rep"), buckets.select("band", "h", "size", "cid"), sets(large), threshold)
        blocks = blocks.unionByName(more)
    links = _verify_blocks(blocks.join(bands, "cid"), threshold)
    found = materialize(links if known is None else links.unionByName(known), "links")
    discard(buckets, parts, members, *used)
    free_shuffles(docs.sparkSession)

    groups = connected_components(found.where("cid <> root").select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    groups = materialize(groups.join(classes.select(F.col("cid").alias("node"), "rep"), "node"), "groups")
    least = groups.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("least"))
    of_class = groups.join(least, "component").select(F.col("node").alias("cid"), F.col("least.rep").alias("class_rep"), F.col("least.node").alias("class_d1"))
    counts = found.groupBy("cid").agg(F.sum("n").alias("other_links"))
    about = classes.join(of_class, "cid", "left").join(counts, "cid", "left").select(F.col("cid").alias("d1"), "rep", "copies", F.coalesce("class_rep", "rep").alias("class_rep"), F.coalesce("class_d1", "cid").alias("class_d1"), F.coalesce("other_links", F.lit(0)).alias("other_links"))
    return sig.select("key", "n_grams", F.when(F.col("key").isNotNull(), F.col("d1")).alias("d1")).join(about, "d1", "left")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """key, class_id, copy_id, n_grams, n_copies, n_links of every row of docs.

    class_id: the least key of the group that links tie together (a row without links: its own key).
    copy_id: the least key with an equal set. n_links: the other rows whose similarity is at least
    the threshold, equal ones included. Rows with a null key or without n-grams (null, empty, no words) have no links; their
    class is their own key. Repeated rows are links of each other, rows of one key with different texts are judged each by
    its text; other columns are left out; an empty table gives no rows."""
    rows = _judged_rows(docs, key, text, size, threshold, recall)
    return rows.select(
        F.col("key").alias(key),
        F.coalesce("class_rep", "key").alias("class_id"),
        F.coalesce("rep", "key").alias("copy_id"),
        "n_grams",
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("other_links", F.lit(0))).cast("long").alias("n_links"),
    )


def with_digest(docs: DataFrame, text: str, size: int, out: str) -> DataFrame:
    """docs with the digest of each text's n-grams in column out."""
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, _rows, ends in _sets(batch.column(at), size):
                digests = [_digest(values[i:j])[0] if j > i else None for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(digests, pa.int64())], [*names, out])

    return docs.transform(arrow_map, run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def one_of_each(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """docs with one row of each group of near duplicates: that with the least key. Rows with a null key or
    without words stay. Rows of one key are told apart by their n-grams: each is kept or dropped by its own text,
    and of those with equal n-grams one stays."""
    columns = ["key", "d1", (F.col("d1").isNull() | ((F.col("d1") == F.col("class_d1")) & (F.col("key") == F.col("class_rep")))).alias("stays")]
    found = materialize(_judged_rows(docs, key, text, size, threshold, recall).where("key is not null").select(*columns), "near")
    per_key = materialize(found.groupBy("key").agg(F.count("*").alias("n"), F.min("stays").alias("stays")).where("n > 1 or not stays"), "keys")
    gone = per_key.where("n = 1").select(F.col("key").alias(key))
    keys = per_key.where("n > 1").select(F.col("key").alias(key))
    rest = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")
    n_keys = keys.count()
    if not n_keys:
        return rest
    side = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys
    digest = unused_name(docs, "digest")
    again = with_digest(rest.join(side, key, "left_semi").withColumn(text, F.col(text).cast("string")), text, size, digest)
    stay = found.where("stays and d1 is not null").select(F.col("key").alias(key), F.col("d1").alias(digest)).distinct()
    once = again.join(stay, [key, digest], "left_semi").dropDuplicates([key, digest])
    plain = again.where(F.col(digest).isNull())
    return rest.join(side, key, "left_anti").unionByName(once.unionByName(plain).select(*docs.columns))
