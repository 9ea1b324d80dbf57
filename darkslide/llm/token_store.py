"""Token files of directly addressable codes, written and read by Spark.

A file (one row of the table that `write_tokens` makes) holds the ids of some whole documents in
ascending order of their key. Ids are split into chunks of 8 bits, least significant first. Level
0 has a byte for every id; level k has bytes only for ids of more than k bytes. A bitmap beside
each level tells which of its ids go on in the next level, and a directory counts the set bits
before each 512 bits, so the place of an id in the next level is one rank look-up. Any id is read
with at most four look-ups and without decoding its neighbours (`DacReader.get`).

Layout, little-endian: magic "DAC1", levels (u4); per level: n (u8), n bytes, bitmap of
ceil(n/64) words (u8), directory of ceil(n/512)+1 counts (u4). The last level has no bitmap.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkslide.llm.bpe import encoder, WINDOW_BYTES
from darkslide.llm.textbuf import arrow_map, byte_chunks
from darkslide.llm.tokenize_op import default_path
from darkslide.plans.session import new_path

MAGIC = b"DAC1"
#: A file ends with the document that reaches so many ids.
FILE_IDS = 1 << 18


def dac_encode(ids: np.ndarray) -> bytes:
    """The file of an array of unsigned 32-bit ids."""
    left, levels = ids.astype(np.uint32), []
    while True:
        more = left > 0xFF
        levels.append(((left & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        left = left[more] >> np.uint32(8)
    out = [MAGIC, struct.pack("<I", len(levels))]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k < len(levels) - 1:
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
            per = np.add.reduceat(more, np.arange(0, len(more), 512), dtype=np.uint32)
            out += [bits.tobytes(), np.concatenate([[0], np.cumsum(per)]).astype("<u4").tobytes()]
    return b"".join(out)


class DacReader:
    """Random access to the ids of one file."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        (count,), at = struct.unpack_from("<I", blob, 4), 8
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for k in range(count):
            (n,) = struct.unpack_from("<Q", blob, at)
            chunk = np.frombuffer(blob, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k < count - 1:
                words = -(-n // 64)
                bits = np.frombuffer(blob, "<u8", words, at)
                at += 8 * words
                ranks = np.frombuffer(blob, "<u4", -(-n // 512) + 1, at)
                at += 4 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, i: int) -> int:
        """Id number i, by rank look-ups alone."""
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if bits is None or not (int(bits[i >> 6]) >> (i & 63)) & 1:
                break
            block = i >> 9
            before = int(ranks[block])
            for w in range(block * 8, i >> 6):
                before += int(bits[w]).bit_count()
            i = before + (int(bits[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()
            shift += 8
        return value

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start to end, as unsigned 32-bit integers."""
        out = np.zeros(end - start, np.uint32)
        at, a, b = np.arange(end - start), start, end
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out[at] |= chunk[a:b].astype(np.uint32) << np.uint32(8 * k)
            if bits is None:
                break
            block = a >> 9
            flags = np.unpackbits(bits[block * 8 : -(-b // 64)].view(np.uint8), bitorder="little").astype(bool)
            before = int(ranks[block]) + int(flags[: a - block * 512].sum())
            more = flags[a - block * 512 : b - block * 512]
            at = at[more]
            a, b = before, before + int(more.sum())
            if a == b:
                break
        return out


def write_tokens(spark: SparkSession, docs: DataFrame, target: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = 0, partitions: int | None = None) -> None:
    """Encode every text, append end_id to each document and write the files at `target`, in
    ascending order of key over the range partitions: nulls first, rows of an equal key by a hash of their
    text, equal rows as they come. Null and empty texts have the end id alone; an empty table writes no file.

    Columns: part, file (order: part, then file), keys, lengths (ids of each document), blob. The
    only shuffle is the one by range of the texts themselves: sampling for the ranges so never
    repeats the encoding. The ranges are over key, hash of text and row, so a key that many rows share is dealt
    over many of them. A lost task is run again from the shuffle; files appear when the job commits."""
    vocabulary = path or default_path()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe, part, file = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            column, lengths = pa.concat_arrays(keys), np.concatenate(counts)
            cells = [pa.array([part], pa.int32()), pa.array([file], pa.int32())]
            cells += [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (column, pa.array(lengths, pa.int64()))]
            return pa.RecordBatch.from_arrays([*cells, pa.array([dac_encode(np.concatenate(parts))], pa.binary())], ["part", "file", "keys", "lengths", "blob"])

        for batch in batches:
            for a, _, data, offsets in byte_chunks(batch.column(1), WINDOW_BYTES):
                ids, n = bpe.encode_rows(data, offsets)
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1
                ends, lo = np.cumsum(n), 0
                while lo < len(n):
                    first = int(ends[lo] - n[lo])
                    hi = min(len(n), int(np.searchsorted(ends, first + FILE_IDS - held)) + 1)  # with the row that fills the file
                    keys.append(batch.column(0).slice(a + lo, hi - lo))
                    parts.append(ids[first : ends[hi - 1]])
                    counts.append(n[lo:hi])
                    held += len(parts[-1])
                    lo = hi
                    if held >= FILE_IDS:
                        yield flush()
                        keys, parts, counts, held, file = [], [], [], 0, file + 1
        if keys:
            yield flush()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["key", F.xxhash64("text"), "row"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")
    files = ordered.transform(arrow_map, run, f"part int, file int, keys array<{kind}>, lengths array<bigint>, blob binary")
    files.write.parquet(target)


def read_tokens(spark: SparkSession, target: str, key: str = "doc_id", index: str | None = None) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the files alone.

    start counts the ids of all documents before it: a running sum within a partition's few files
    plus the total of the partitions before. Those totals are one row per partition that wrote files."""
    files = spark.read.parquet(target)
    sizes = files.select("part", "file", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per range partition: their number is a setting, not the size of the data
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    in_part = sizes.withColumn("at", F.sum("n").over(Window.partitionBy("part").orderBy("file")) - F.col("n"))
    starts = in_part.join(before, "part").select("part", "file", (F.col("base") + F.col("at")).alias("file_start"))
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                reader = DacReader(batch.column(3)[r].as_py())
                lengths = np.array(batch.column(2)[r].as_py(), np.int64)
                ends = np.cumsum(lengths)
                raw = reader.read(0, len(reader)).astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                size = len(lengths)
                cells = [pa.array([batch.column(0)[r].as_py()] * size, pa.int32()), pa.array([batch.column(1)[r].as_py()] * size, pa.int32())]
                cells += [batch.column(4).slice(r, 1).flatten(), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, ["part", "file", "key", "at", "n_tokens", "ids_crc32"])

    found = files.select("part", "file", "lengths", "blob", "keys").transform(arrow_map, run, f"part int, file int, key {kind}, at bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, ["part", "file"]).select(F.col("key").alias(key), (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of docs in the shared folder and read them back. Empty and null texts
    have the end id alone; an empty table gives no rows."""
    target = new_path(spark, "tokens")
    write_tokens(spark, docs, target, path=path)
    return read_tokens(spark, target)
