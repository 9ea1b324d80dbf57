"""Sums and means of vectors by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups whose sums a task holds before it gives them out.
HELD = 4096


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if len(x) >= width else np.concatenate([x, np.zeros(width - len(x), x.dtype)])


def _add(held: dict, group: object, n: int, counts: np.ndarray, sums: np.ndarray) -> None:
    if group in held:
        m, c, s = held[group]
        width = max(len(s), len(sums))
        n, counts, sums = n + m, _widened(c, width) + _widened(counts, width), _widened(s, width) + _widened(sums, width)
    held[group] = n, counts, sums


def _rows(held: dict, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    lists = lambda i, k: pa.array([list(v[i]) for v in held.values()], pa.list_(k))
    return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([v[0] for v in held.values()], pa.int64()), lists(1, pa.int64()), lists(2, pa.float64())], names)


def _sums_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """group, rows, count and sum of each position, of a batch (group, vector)."""
    codes = batch.column(0).dictionary_encode(null_encoding="encode")
    code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
    vec = batch.column(1)
    lengths = np.nan_to_num(np.asarray(vec.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int)
    width, flat = int(lengths.max(initial=0)), vec.drop_null().flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    at = (code[row] * width + place)[known]
    size = len(names) * width
    sums = np.bincount(at, flat.drop_null().to_numpy(zero_copy_only=False).astype(float), size).reshape(len(names), width)
    counts = np.bincount(at, minlength=size).reshape(len(names), width)
    for name, n, c, s in zip(names, np.bincount(code, minlength=len(names)), counts, sums, strict=True):
        yield name, int(n), c, s


def vector_sums(df: DataFrame, group: str, vec: str) -> DataFrame:
    """group, n (rows), counts and sums (of each position of the vectors; nulls don't count).

    Each task adds up its rows by group, some HELD groups at a time, so a group gives at most a few rows for each task however many vectors it
    has; these are sorted by group and added up as they come."""
    kind = df.schema[group].dataType
    schema = T.StructType([T.StructField(group, kind), T.StructField("n", T.LongType()), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    names = schema.names

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for x in _sums_of(batch):
                _add(held, *x)
            if len(held) >= HELD:
                yield _rows(held, batch.schema.field(0).type, names)
                held.clear()
        if held:
            yield _rows(held, batch.schema.field(0).type, names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            kind = batch.schema.field(0).type
            for g, n, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if g not in held and len(held) >= HELD:  # groups come in order: all but the last are whole
                    yield _rows(held, kind, names)
                    held.clear()
                _add(held, g, n, np.asarray(c, np.int64), np.asarray(s, float))
        if held:
            yield _rows(held, kind, names)

    parts = df.select(group, vec).mapInArrow(partial, schema)
    return parts.repartition(F.col(group)).sortWithinPartitions(group).mapInArrow(total, schema)
