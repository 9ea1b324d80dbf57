"""Vectorised word hashing over the UTF-8 bytes of Arrow string columns.

An Arrow string column is one byte buffer with offsets. Word boundaries, word hashes and
shingle hashes are computed over that buffer with numpy, a bounded number of bytes at a time,
so no Python object is made per word and memory does not grow with the batch.

A word is a maximal run of ASCII letters and digits and of bytes of non-ASCII characters (their punctuation and
no-break spaces included); ASCII capitals count as small letters, others don't. Scripts without spaces so give very few and
long words: split them into words beforehand. All texts are used whole.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 18
U = np.uint64
_RNG = np.random.default_rng(20240229)
_POS = _RNG.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * U(2) + U(1)
SHINGLE_MUL = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Task) -> Task:
    """run, with freed memory handed back to the system at the end of the task: workers live on for
    tasks of other stages, and what they hold adds up on an executor."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


#: Most bytes of an Arrow batch; every task holds a few batches on both sides.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run: Task, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of at most BATCH_BYTES, unless the session asks for
    smaller ones, and with freed memory handed back at the end of each task.

    Spark reads the size of batches from the session when a query runs, so the session keeps the lower bound."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_SETTING)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(tidy(run), schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most `limit` bytes, or
    one longer row. Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@dataclass
class Words:
    """Words of some rows: start and end byte, 64-bit hash, row of each; bounds[i]:bounds[i+1]
    are the words of row i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    bounds: np.ndarray


def windows(data: np.ndarray, inside: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `size` bytes that end after a byte of which inside[byte] is False; longer where there is none."""
    at = 0
    while at < len(data):
        stop, step = len(data), size
        while at + step < len(data):
            ends = np.flatnonzero(~inside[data[at : at + step]])
            if len(ends):
                stop = at + int(ends[-1]) + 1
                break
            step *= 2
        yield at, stop
        at = stop


def _spans(data: np.ndarray, cut: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of words; cut[i]: no word goes on from byte i - 1 to byte i."""
    inside = is_word[data]
    flag = np.zeros(len(data) + 1, bool)
    flag[:-1] = inside
    prev = np.zeros(len(data) + 1, bool)
    prev[1:] = inside
    start = np.flatnonzero(flag & (~prev | cut))
    end = np.flatnonzero(prev & (~flag | cut))
    if len(start) == 0:
        return start, end, np.zeros(0, np.uint64)
    length = end - start
    first = np.repeat(start, length)
    which = np.arange(len(first)) - np.repeat(np.cumsum(length) - length, length)
    value = data[first + which]
    if lower:
        value = _LOWER[value]
    h = np.add.reduceat((value.astype(np.uint64) + U(1)) * _POS[which & 0xFFFF], np.cumsum(length) - length)
    return start, end, mix(h + length.astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _WORD, lower: bool = True) -> Words:
    """Words of rows. What takes many bytes for each byte of text is done in windows of about CHUNK_BYTES, so a very long
    row takes 32 bytes for each of its words beside its own bytes."""
    # a row's end is a boundary even where the next row starts with a word character
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    found = [(at + s, at + e, h) for at, stop in windows(data, is_word, CHUNK_BYTES) for s, e, h in [_spans(data[at:stop], cut[at : stop + 1], is_word, lower)]]
    start, end, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    bounds = np.searchsorted(start, offsets)
    return Words(start, end, h, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row, and the row of each. A row of fewer words,
    but at least one, has one shingle: all its words. In order of position; not yet distinct."""
    n = len(words.hash)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = words.hash * SHINGLE_MUL[0]
    for j in range(1, min(size, n)):
        same = np.zeros(n, bool)
        same[: n - j] = words.row[j:] == words.row[: n - j]
        total[: n - j] += np.where(same[: n - j], words.hash[j:] * SHINGLE_MUL[j], U(0))
    counts = np.diff(words.bounds)
    left = words.bounds[1:][words.row] - np.arange(n)
    keep = (left >= size) | ((counts[words.row] < size) & (left == counts[words.row]))
    return mix(total[keep]), words.row[keep]


def distinct_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), ordered by row and value."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], r[new]
