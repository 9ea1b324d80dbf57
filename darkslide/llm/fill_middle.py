"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put together in another order, by secondary sort.

A text is cut into units (runs of ASCII letters, or one other character) at two places that hashes of its key draw. Its output is emitted as
pieces, chunks of whole units of some PIECE bytes, keyed by document and position in the output. repartitionAndSortWithinPartitions brings the
pieces of a document together in order, and one pass over each partition feeds them to incremental digests (or joins them to texts), a piece at a time.
For restoration that pass finds the marks in what it reads, and keys each stretch by its place in the original text; the
partitioner is kept, so these pieces are sorted again where they are and don't move a second time. Sorts spill to disk; a task holds pieces of a few documents.

Defined results: a null text is empty; empty texts, texts that hold a mark and a tenth of all texts stay as they are (form plain); a null key is an empty
one in the hash; rows equal in key and text share their pieces and give as many equal result rows; other columns of the table don't matter. A text
is whole in memory only in the task that cuts it, since it is one row of the table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a piece; a piece ends with a unit, unless one unit is longer.
PIECE = 1 << 16
#: Bytes of a text that are looked at together.
WINDOW = 1 << 20
#: Bytes of text whose pieces are sorted in one partition.
PARTITION_BYTES = 64 << 20
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"plain": (), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Places in the original text.
PLACE = {"prefix": 0, "middle": 1, "suffix": 2}
PLAIN_FROM, SPM_BELOW = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_INNER = np.zeros(256, bool)
_INNER[128:192] = True


def unit_starts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether a unit starts at each of the bytes a to b of UTF-8 text."""
    letter = _LETTER[data[max(0, a - 1) : b]]
    before = letter[:-1] if a else np.concatenate([[False], letter[:-1]])
    letter = letter[1:] if a else letter
    return ~_INNER[data[a:b]] & ~(letter & before)


def count_units(data: np.ndarray) -> list[int]:
    """Units that start in each window of a text."""
    return [int(np.count_nonzero(unit_starts(data, a, min(len(data), a + WINDOW)))) for a in range(0, len(data), WINDOW)]


def offset_of(data: np.ndarray, counts: list[int], k: int) -> int:
    """Byte at which unit k (from 0) starts; the length of the text if it has k units."""
    for i, n in enumerate(counts):
        if k < n:
            return i * WINDOW + int(np.flatnonzero(unit_starts(data, i * WINDOW, min(len(data), (i + 1) * WINDOW)))[k])
        k -= n
    return len(data)


def code_points(data: np.ndarray, a: int, b: int) -> int:
    return sum(int(np.count_nonzero(~_INNER[data[x : min(b, x + WINDOW)]])) for x in range(a, b, WINDOW))


def chunks(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole units that make up a to b."""
    while b - a > PIECE:
        stop = a + PIECE
        starts = unit_starts(data, stop, min(b, stop + PIECE))
        stop += int(starts.argmax())
        yield a, stop
        a = stop
    if a < b:
        yield a, b


def draw(key: object) -> tuple[int, int, int, int]:
    """The four numbers that decide on a document."""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut(key: object, data: bytes) -> tuple[tuple, list[tuple[bytes, int, int]]]:
    """(key, n, form, prefix_chars, middle_chars), and (mark, start, end) of the stretches of the output in order."""
    view = np.frombuffer(data, np.uint8)
    counts = count_units(view)
    n = sum(counts)
    h1, h2, h3, h4 = draw(key)
    if not data or any(m in data for m in MARKS.values()) or h3 % 100 >= PLAIN_FROM:
        return (key, n, "plain", None, None), [(b"", 0, len(data))]
    low, high = (offset_of(view, counts, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    spans = {"prefix": (0, low), "middle": (low, high), "suffix": (high, len(data))}
    return (key, n, form, code_points(view, 0, low), code_points(view, low, high)), [(MARKS[x], *spans[x]) for x in ORDERS[form]]


def name_of(key: object, data: bytes) -> bytes:
    """What tells documents apart: equal for rows of equal key and text."""
    return hashlib.blake2b(repr(key).encode() + b"\0" + data, digest_size=16).digest()


def cut_rows(rows: Iterable[tuple]) -> Iterator[tuple]:
    """((name, position), packed piece) of the outputs of (key, text); at position 0 beside the document's header."""
    for key, text in rows:
        data = (text or "").encode()
        header, stretches = cut(key, data)
        name, view, at = name_of(key, data), np.frombuffer(data, np.uint8), 0
        for mark, a, b in stretches:
            for x, y in [*chunks(view, a, b)] or [(a, a)]:
                piece = zlib.compress(mark + data[x:y], 1)
                yield (name, at), piece if at else (header, piece)
                mark, at = b"", at + 1


def place_of(key: tuple) -> int:
    """Partition of a piece: by its document."""
    return int.from_bytes(key[0][:6], "big")


def sorted_pieces(pieces: RDD, partitions: int) -> RDD:
    return pieces.repartitionAndSortWithinPartitions(partitions, place_of)


def documents_of(items: Iterable[tuple]) -> Iterator[tuple[bytes, tuple, int, Iterator[bytes]]]:
    """(name, header, copies, pieces in order) of the documents of a sorted partition; the pieces of one are read before the next comes."""

    for name, group in groupby(items, lambda x: x[0][0]):
        (_, at), (header, first) = next(group)
        copies, held = 1, None
        for (_, at), value in group:
            if at:
                held = at, value
                break
            copies += 1

        def pieces(first=first, held=held, group=group) -> Iterator[bytes]:
            yield zlib.decompress(first)
            last = 0
            for at, value in ([held] if held else []):
                last = at
                yield zlib.decompress(value)
            for (_, at), value in group:
                if at != last:  # copies of a document have equal pieces
                    last = at
                    yield zlib.decompress(value)

        yield name, header, copies, pieces()


def stretches_of(form: str, pieces: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place in the original text, bytes) of an output that comes in pieces. Marks are found wherever pieces are cut."""
    marks = [(MARKS[x], PLACE[x]) for x in ORDERS[form]]
    place, rest = 0, b""
    for piece in pieces:
        rest += piece
        while marks and (at := rest.find(marks[0][0])) >= 0:
            if at:
                yield place, rest[:at]
            rest, place = rest[at + len(marks[0][0]) :], marks[0][1]
            marks = marks[1:]
        keep = 2 if marks else 0
        if len(rest) > keep:
            yield place, rest[: len(rest) - keep]
            rest = rest[len(rest) - keep :]
    if rest:
        yield place, rest


def digest_outputs(items: Iterable[tuple]) -> Iterator[tuple]:
    """Pieces of outputs in order -> pieces keyed by their place in the original text, after the document's header with its digest."""
    for name, header, copies, pieces in documents_of(items):
        digest = hashlib.sha256()

        def read(pieces=pieces, digest=digest) -> Iterator[bytes]:
            for p in pieces:
                digest.update(p)
                yield p

        for seq, (place, data) in enumerate(stretches_of(header[2], read())):
            yield (name, (place, seq)), zlib.compress(data, 1)
        yield (name, (-1, 0)), (header, copies, digest.hexdigest())


def digest_restored(items: Iterable[tuple]) -> Iterator[tuple]:
    """Pieces in the order of the original text -> rows of the result."""
    for _, group in groupby(items, lambda x: x[0][0]):
        _, (header, copies, output) = next(group)
        digest = hashlib.sha256()
        for _, piece in group:
            digest.update(zlib.decompress(piece))
        for _ in range(copies):
            yield (*header, output, digest.hexdigest())


def partitions_for(docs: DataFrame, text: str) -> int:
    """Partitions of some PARTITION_BYTES of text, as many as Spark's shuffles have at least."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def _fields(docs: DataFrame, key: str, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), *more])


def output_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> RDD:
    """The outputs of all documents: ((name, position), piece) with a document's pieces in one partition, in order."""
    rows = docs.select(key, text).rdd
    return sorted_pieces(rows.mapPartitions(cut_rows), partitions or partitions_for(docs, text))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    pieces = output_pieces(docs, key, text, partitions)
    placed = pieces.mapPartitions(digest_outputs, preservesPartitioning=True)
    # the same partitioner: sorted anew within its partitions, without a shuffle
    rows = sorted_pieces(placed, pieces.getNumPartitions()).mapPartitions(digest_restored)
    sha = [T.StructField(c, T.StringType()) for c in ("output_sha256", "restored_sha256")]
    return docs.sparkSession.createDataFrame(rows, _fields(docs, key, *sha), verifySchema=False)


def outputs(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output (the text to train on) of every row."""

    def join(items: Iterable[tuple]) -> Iterator[tuple]:
        for _, header, copies, pieces in documents_of(items):
            output = b"".join(pieces).decode()
            for _ in range(copies):
                yield (*header, output)

    rows = output_pieces(docs, key, text, partitions).mapPartitions(join)
    return docs.sparkSession.createDataFrame(rows, _fields(docs, key, T.StructField("output", T.StringType())), verifySchema=False)


def restore(rows: DataFrame, key: str = "doc_id", form: str = "form", output: str = "output", partitions: int | None = None) -> DataFrame:
    """key, text: the original texts of outputs and their forms, by sorting their stretches. A null output is an empty text, a null form plain."""

    def place(items: Iterable[tuple]) -> Iterator[tuple]:
        for k, f, out in items:
            data = (out or "").encode()
            name = name_of((k, f), data)
            yield (name, (-1, 0)), k
            pieces = (data[a : a + PIECE] for a in range(0, len(data), PIECE))
            for seq, (at, some) in enumerate(stretches_of(f or "plain", pieces)):
                yield (name, (at, seq)), zlib.compress(some, 1)

    def join(items: Iterable[tuple]) -> Iterator[tuple]:
        for _, group in groupby(items, lambda x: x[0][0]):
            keys, found, last = [], [], None
            for (_, at), value in group:
                if at == (-1, 0):
                    keys.append(value)
                elif at != last:
                    found.append(zlib.decompress(value))
                    last = at
            text = b"".join(found).decode()
            for k in keys:
                yield k, text

    raw = rows.select(key, form, output).rdd
    joined = sorted_pieces(raw.mapPartitions(place), partitions or partitions_for(rows, output)).mapPartitions(join)
    return rows.sparkSession.createDataFrame(joined, T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("text", T.StringType())]), verifySchema=False)
