"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words: its words at the masked offsets are hashed, the
others are ignored. The two MASKS together hit every window of WINDOW words in which at most
SUBSTITUTIONS words are replaced (all such patterns are tried in the tests), so no overlap of that kind is missed.

The seeds of the benchmark are put in a sorted table that goes to all tasks; the benchmark is taken
in blocks of about BLOCK_BYTES, one scan of the documents for each. With more than one, each block's result is written in the shared folder
and its table given up before the next is made, so driver and workers hold one block at a time however large the benchmark
is. Around each hit the whole diagonal of item and document is compared
word by word. A document is contaminated by an item if some window of WINDOW item words matches it with at
most SUBSTITUTIONS replaced (items of MIN_WORDS to WINDOW - 1 words: all of them, none replaced; shorter ones are
too short to tell and never match).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.textbuf import arrow_map, byte_chunks, mix, SHINGLE_MUL, U, Words, words_of
from darkslide.plans.session import discard, materialize, new_path

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 8, 9))
WINDOW, SUBSTITUTIONS, MIN_WORDS = 13, 2, 8
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22


def seeds(words: Words, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the mask at every place where it lies within one text."""
    n = len(words.hash) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[:n] == words.row[mask[-1] :])
    h = np.zeros(len(at), np.uint64)
    for k, o in enumerate(mask):
        h += words.hash[at + o] * SHINGLE_MUL[k]
    return mix(h + U(mask[-1])), at


@dataclass
class Block:
    """Words and seeds of some items."""

    ids: list
    hashes: np.ndarray
    bounds: np.ndarray
    seed: np.ndarray
    seed_at: np.ndarray
    filter: np.ndarray


def make_block(ids: list, texts: list[str | None]) -> Block:
    column = pa.array(texts, pa.string())
    hashes, counts, seed, seed_at, base = [np.zeros(0, np.uint64)], [], [], [], 0
    for _lo, _hi, data, offsets in byte_chunks(column):
        w = words_of(data, offsets)
        for mask in MASKS:
            h, at = seeds(w, mask)
            seed.append(h)
            seed_at.append(at + base)
        hashes.append(w.hash)
        counts.append(np.diff(w.bounds))
        base += len(w.hash)
    every = np.concatenate([np.zeros(0, np.uint64), *seed])
    where = np.concatenate([np.zeros(0, np.int64), *seed_at])
    order = np.argsort(every, kind="stable")
    sieve = np.zeros(1 << _FILTER_BITS, bool)
    sieve[every >> U(64 - _FILTER_BITS)] = True
    return Block(ids, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64), every[order], where[order], sieve)


#: (hit, item) pairs, and words of items, that are looked at together.
PAIRS, PAIR_WORDS = 1 << 18, 1 << 20


def diagonal_overlaps(block: Block, words: Words, row: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (row, item, shift): words of the item in matching windows, equal words among them, first such word, with item word j
    beside word j + shift of the row; words outside the row don't match."""
    n = np.diff(block.bounds)[item]
    base = np.concatenate([[0], np.cumsum(n)])
    which = np.repeat(np.arange(len(n)), n)
    j = np.arange(base[-1]) - base[which]
    size = np.where(n >= WINDOW, WINDOW, n)
    allowed = np.where(n >= WINDOW, SUBSTITUTIONS, 0)
    place = words.bounds[row][which] + j + shift[which]
    there = (place >= words.bounds[row][which]) & (place < words.bounds[row + 1][which])
    equal = there & (block.hashes[block.bounds[item][which] + j] == words.hash[np.where(there, place, 0)])
    total = np.concatenate([[0], np.cumsum(equal)])
    at = np.flatnonzero((j + size[which] <= n[which]) & (n >= MIN_WORDS)[which])
    at = at[total[at + size[which[at]]] - total[at] >= (size - allowed)[which[at]]]
    cover = np.zeros(base[-1] + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size[which[at]], -1)
    inside = np.cumsum(cover)[:-1] > 0
    count = lambda x: np.bincount(which, x, minlength=len(n)).astype(np.int64)
    first = np.zeros(len(n), np.int64)
    first[which[at[::-1]]] = j[at[::-1]]
    return count(inside), count(inside & equal), first


def best_of(found: np.ndarray) -> np.ndarray:
    """The rows (row, item, overlap, equal, shift, first) with the largest overlap, most equal words and least shift of each row and item."""
    found = found[np.lexsort((found[:, 4], -found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def overlaps(block: Block, words: Words) -> np.ndarray:
    """(row, item, overlap, equal, first document word) of each contaminated row and item, by the best diagonal.

    A seed that many items hold meets all of them, but only PAIRS pairs (or one hit's) at a time."""
    out = np.zeros((0, 6), np.int64)
    for mask in MASKS:
        h, at = seeds(words, mask)
        some = block.filter[h >> U(64 - _FILTER_BITS)]
        h, at = h[some], at[some]
        lo, hi = np.searchsorted(block.seed, h, "left"), np.searchsorted(block.seed, h, "right")
        h, at, lo, n = h[hi > lo], at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        ends, i = np.cumsum(n), 0
        while i < len(n):
            k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            m = n[i:k]
            which = np.repeat(lo[i:k] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            item_word, doc_word = block.seed_at[which], np.repeat(at[i:k], m)
            item = np.searchsorted(block.bounds, item_word, "right") - 1
            row = words.row[doc_word]
            shift = (doc_word - words.bounds[row]) - (item_word - block.bounds[item])
            todo = np.unique(np.stack([row, item, shift], 1), axis=0)
            words_of_items = np.cumsum(np.diff(block.bounds)[todo[:, 1]])
            parts, a = [out], 0
            while a < len(todo):
                b = max(a + 1, int(np.searchsorted(words_of_items, (words_of_items[a - 1] if a else 0) + PAIR_WORDS, "right")))
                t = todo[a:b]
                size, equal, first = diagonal_overlaps(block, words, *t.T)
                parts.append(np.column_stack([t[:, :2], size, equal, t[:, 2], first])[size > 0])
                a = b
            out, i = best_of(np.concatenate(parts)), k
    return np.column_stack([out[:, :4], np.maximum(0, out[:, 5] + out[:, 4])])


def _blocks(spark: SparkSession, benchmark: DataFrame, item_key: str, item_text: str) -> Iterator[tuple[Broadcast, int]]:
    """(broadcast block, number of blocks), one at a time; each but the last is given up when the next is asked for."""
    items = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(n):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).orderBy("item", "text").toArrow()
        shared = spark.sparkContext.broadcast(make_block(some["item"].to_pylist(), some["text"].to_pylist()))
        yield shared, n
        if n > 1:
            shared.destroy()


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item key (benchmark_<key> if both have one name), overlap_words, equal_words, item_words, doc_word of every contaminated row.

    Null and empty texts and items match nothing; equal rows or items are each reported; an empty
    table on either side gives no rows; other columns are left out. Texts of any length are compared whole; a task holds 32 bytes for each word of
    a text beside the block."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, overlap_words bigint, equal_words bigint, item_words bigint, doc_word bigint"
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    path = None
    for shared, n_blocks in _blocks(spark, benchmark, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for lo, _hi, data, offsets in byte_chunks(batch.column(1)):
                    found = overlaps(block, words_of(data, offsets))
                    if len(found):
                        row, item, size, equal, first = found.T
                        ids = pa.array([block.ids[i] for i in item.tolist()])
                        cells = [pa.array(x, pa.int64()) for x in (size, equal, np.diff(block.bounds)[item], first)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), ids, *cells], ["key", "item", "overlap_words", "equal_words", "item_words", "doc_word"])

        out = rows.transform(arrow_map, run, schema)
        if n_blocks > 1:
            path = path or new_path(spark, "contaminated")
            out.write.mode("append").parquet(path)
            out = spark.read.schema(schema).parquet(path)
    return out.withColumnsRenamed({"key": key, "item": f"benchmark_{item_key}" if item_key.lower() == key.lower() else item_key})


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the contaminated rows. Every row is judged by its own text, whatever its key; nulls, empty texts and empty
    tables as in `contaminated`. With one block of benchmark items that is one pass and no join."""
    at, names = docs.columns.index(text), docs.columns
    for shared, n_blocks in _blocks(spark, benchmark, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _hi, data, offsets in byte_chunks(batch.column(at)):
                    keep[lo + overlaps(block, words_of(data, offsets))[:, 0]] = False
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, names)

        last, docs = docs, docs.transform(arrow_map, run, docs.schema)
        if n_blocks > 1:
            docs = materialize(docs, "clean")
            if hasattr(last, "table_path") and last.table_path.rsplit("/", 1)[-1].startswith("clean-"):
                discard(last)
    return docs
