"""BPE encoding and decoding of a text column (forced-boundary splitting, see bpe.py)."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.llm.bpe import encoder, WINDOW_BYTES
from darkslide.llm.textbuf import arrow_map, byte_chunks

DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_VOCABULARY)


def plan_columns(df: DataFrame, wanted: dict[str, T.DataType]) -> T.StructType:
    """The schema of df's columns plus new ones; a column of df with the name of a new one (in any
    case) is an error rather than silently replaced."""
    clash = {c.lower() for c in df.columns} & {c.lower() for c in wanted}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in wanted.items())])


def packed_rows(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The ids of each row as little-endian unsigned 32-bit integers."""
    raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit integers) of every row.

    Null and empty texts have no ids. Rows repeat as often as in df; other columns are left out.
    Texts of any length are taken in windows (bpe.WINDOW_BYTES), so a task holds a long row's bytes and ids but
    nothing else of its size; nothing is shuffled."""
    vocabulary = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = encoder(vocabulary)
        for batch in batches:
            for a, b, data, offsets in byte_chunks(batch.column(1), WINDOW_BYTES):
                ids, counts = bpe.encode_rows(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed_rows(ids, counts), pa.binary())], ["key", "ids"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.BinaryType())])
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).transform(arrow_map, run, schema).withColumnRenamed("key", key)


def decode_column(df: DataFrame, ids: str, out: str, path: str | None = None) -> DataFrame:
    """df with the text of its packed ids in column `out`; null ids give a null text."""
    vocabulary = path or default_path()
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [None if x is None else bpe.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return df.transform(arrow_map, run, plan_columns(df, {out: T.StringType()}))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row: the digests of the packed ids and
    of the text decoded from them. Empty and null texts: 0 tokens and the digests of nothing. Rows repeat as
    often as in df, an empty table gives no rows, other columns are left out.

    Both ways are gone in one pass, so a task holds one encoder and no text goes back to the JVM."""
    vocabulary = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = encoder(vocabulary)
        for batch in batches:
            for a, b, data, offsets in byte_chunks(batch.column(1), WINDOW_BYTES):
                ids, counts = bpe.encode_rows(data, offsets)
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in rows]) for rows in (packed_rows(ids, counts), bpe.decode_rows(ids, counts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), *digests], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.transform(arrow_map, run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
