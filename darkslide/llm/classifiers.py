"""Two text classifiers with hashed features: toxicity and quality.

Both are fitted on a bounded sample of labelled rows (`max_rows` keys, chosen by a hash of the key, so
the choice doesn't depend on order or partitions; see `training_texts` for the bound of their bytes) and score
every row of the table, whole. Rows whose crc32(key as text) mod 4 is 2 are held out: their labels are never read. Features
come from the text alone. Scoring is one pass over the texts with a table of weights of fixed size; nothing is
shuffled but the sample. Features of very long texts are gathered in windows.

Null and empty texts are scored by the intercept. With no labelled rows, or one class alone, the
score is the smoothed share of the class, the same for all rows. Repeated rows get equal scores, an empty table gives no
rows; of several texts of a labelled key one is learnt from (the least by hash), of several labels the largest.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.llm.textbuf import arrow_map, byte_chunks, _LOWER, mix, U, windows, _WORD
from darkslide.plans.session import materialize

#: Hashed features: 2 ** CHAR_BITS of characters, 2 ** WORD_BITS of words.
CHAR_BITS, WORD_BITS = 22, 20
#: Most bytes of the labelled texts that a model is fitted on, and of one such text.
TRAIN_BYTES, TRAIN_TEXT_BYTES = 24 << 20, 1 << 20


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, key: str, text: str) -> DataFrame:
    """order, text, y of at most max_rows labelled keys that aren't held out, written in the shared
    folder. Rows with a null label don't count; of several labels of a key the largest does. Labelled texts of over TRAIN_TEXT_BYTES
    are left out of the sample, and it ends (in order of the key's hash) before it exceeds TRAIN_BYTES."""
    some = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(key).agg(F.max(label).cast("int").alias("y"))
        .select(F.col(key).alias("_key"), "y", F.xxhash64(key).alias("order")).orderBy("order").limit(max_rows)
    )
    # at most max_rows keys are broadcast; the texts stay where they are until they are written
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "_key")
    rows = rows.where(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    one = materialize(rows.groupBy("order", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "training")
    sizes = sorted((r[0], r[1]) for r in one.select("order", F.octet_length("text")).collect())  # at most max_rows
    total = np.cumsum([n for _, n in sizes])
    last = int((total <= TRAIN_BYTES).sum())
    return one if last == len(sizes) else one.where(F.col("order") < sizes[last][0])


def distinct(rows: np.ndarray, features: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), in order."""
    code = np.sort(pd.unique((rows.astype(np.int64) << bits) | features))
    return code >> bits, code & ((1 << bits) - 1)


# --- features -------------------------------------------------------------------------------

CHAR_SIZES = (4, 6)
#: Texts of more bytes are taken in windows of so many.
CHAR_WINDOW = 1 << 17


def _plain_characters() -> np.ndarray:
    """By code point of the basic plane: its small letter, or a space if it is no letter, digit or mark."""
    keep = [unicodedata.category(chr(c))[0] in "LMN" for c in range(1 << 16)]
    small = [chr(c).lower() for c in range(1 << 16)]
    return np.array([(ord(s) if len(s) == 1 else c) if k else 32 for c, (k, s) in enumerate(zip(keep, small, strict=True))], np.uint64)


_PLAIN = _plain_characters()


def char_ngrams(texts: list[str], ends: tuple[bool, bool] = (True, True)) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all n-grams of CHAR_SIZES characters; letters are lowered, and characters of the basic plane
    other than letters, digits and marks count as spaces. No n-gram crosses two texts.

    A space stands before and after each text, so that n-grams see where its first and last word end; ends tells whether the texts'
    ends are such ends."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    x = np.where(points < 1 << 16, _PLAIN[np.minimum(points, 0xFFFF)], points)
    first, last = (0 if ends[0] else 1), len(x) - (0 if ends[1] else 1)
    x, row = x[first:last], row[first:last]
    rows, found, value = [], [], x
    for size in range(2, max(CHAR_SIZES) + 1):
        value = value[:-1] * U(0x9E3779B97F4A7C15) + x[size - 1 :]
        if size in CHAR_SIZES:
            inside = row[: len(value)] == row[size - 1 :]
            found.append((mix(value[inside] + U(size)) >> U(64 - CHAR_BITS)).astype(np.int64))
            rows.append(row[: len(value)][inside])
    return np.concatenate(rows), np.concatenate(found)


def char_features(data: np.ndarray, offsets: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of rows of UTF-8, in order; of the features that are useful."""

    def some(r: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if useful is not None:
            r, f = r[useful[f]], f[useful[f]]
        return distinct(r, f, CHAR_BITS)

    raw, at = data.tobytes(), offsets.tolist()
    if len(raw) <= 2 * CHAR_WINDOW:
        return some(*char_ngrams([raw[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]))
    rows, found = [], []
    for r, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        parts, lo = [], i
        while lo < j:
            hi = min(j, lo + CHAR_WINDOW)
            begin = max(i, lo - 4 * max(CHAR_SIZES))  # windows overlap by more than an n-gram
            while begin > i and raw[begin] & 0xC0 == 0x80:
                begin -= 1
            while hi < j and raw[hi] & 0xC0 == 0x80:
                hi += 1
            parts.append(some(*char_ngrams([raw[begin:hi].decode("utf-8", "replace")], (begin == i, hi == j)))[1])
            lo = hi
        rows.append(np.full(len(f := np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))), r))
        found.append(f)
    return np.concatenate(rows), np.concatenate(found)


_CLASS = np.where(_WORD, 1, 2).astype(np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Bytes of a window of word_features.
WORD_WINDOW = 1 << 18
_POS = np.random.default_rng(7).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * U(2) + U(1)


def _tokens(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, surface, shape) of the words of data; cut[i]: a row begins at byte i."""
    kind = _CLASS[data]
    edge = cut.copy()
    edge[1:] |= kind[1:] != kind[:-1]
    edge[:1] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    if not len(start):
        return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    length = end - start
    at = np.cumsum(length) - length
    where = np.arange(int(length.sum())) - np.repeat(at, length)
    value = data[np.repeat(start, length) + where]
    surface = mix(np.add.reduceat((_LOWER[value].astype(np.uint64) + U(1)) * _POS[where & 0xFFF], at) + length.astype(np.uint64))
    capitals = np.add.reduceat(_UPPER[value], at, dtype=np.int64)
    shape = np.where((capitals > 1) & (2 * capitals > length), U(3), np.where(_UPPER[data[start]], U(2), U(1)))
    return start, surface, np.where(kind[start] == 2, surface, shape)


def word_features(data: np.ndarray, offsets: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count, number of words of each row), in order: hashed n-grams of words, those that are useful.

    Words are runs of letters and digits, and runs of other characters. Each has a surface (letters
    lowered) and a shape: repeated from the word before, capitals, first letter a capital, plain, or its
    surface if it has no letter. Features: surfaces, pairs of surfaces, shapes, pairs and triples of shapes."""
    n = len(offsets) - 1
    cut = np.zeros(len(data), bool)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    found = [(at + s, u, v) for at, stop in windows(data, _CLASS > 0, WORD_WINDOW) for s, u, v in [_tokens(data[at:stop], cut[at:stop])]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    start, surface, shape = (np.concatenate(x) for x in zip(*found, strict=True))
    row = np.searchsorted(offsets, start, "right") - 1
    same = np.zeros(len(start), bool)
    same[1:] = (surface[1:] == surface[:-1]) & (row[1:] == row[:-1])
    shape[same] = 4
    codes = np.zeros(0, np.int64)
    counts = np.zeros(0, np.int64)
    for tag, stream, size in [(0, surface, 1), (1, surface, 2), (2, shape, 1), (3, shape, 2), (4, shape, 3)]:
        h = np.full(len(stream), tag + 1, np.uint64)
        for j in range(size):
            h = mix(h[: max(0, len(stream) - j)] * U(0x9E3779B97F4A7C15) + stream[j:])
        ok = row[: len(h)] == row[len(row) - len(h) :]
        f = (h[ok] >> U(64 - WORD_BITS)).astype(np.int64)
        code = (row[: len(h)][ok] << WORD_BITS) | f
        code, c = np.unique(code if useful is None else code[useful[f]], return_counts=True)
        codes, counts = np.concatenate([codes, code]), np.concatenate([counts, c])
    code, at = np.unique(codes, return_inverse=True)
    total = np.bincount(at, counts, minlength=len(code)).astype(np.int64)
    return code >> WORD_BITS, code & ((1 << WORD_BITS) - 1), total, np.bincount(row, minlength=n)


# --- models ---------------------------------------------------------------------------------


@dataclass
class Linear:
    """Weights of hashed features and an intercept; score = logistic(sum of weight * value)."""

    weights: np.ndarray
    intercept: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def constant(y: np.ndarray, bits: int) -> Linear:
    p = (float(y.sum()) + 1) / (len(y) + 2)
    return Linear(np.zeros(1 << bits, np.float32), float(np.log(p / (1 - p))))


def fit_logistic(ends: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 8, inner: int = 10) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L2 penalty on the weights, by Newton steps whose equations are
    solved by conjugate gradients; a step that doesn't lower the loss is halved.

    Row i has the features cols[ends[i]:ends[i + 1]], each of value scale[feature], and counts weight[i] times."""
    n, n_cols = len(y), len(scale)
    weight = weight / weight.sum()
    penalty = np.full(n_cols + 1, l2)
    penalty[-1] = 0
    blocks = [0]
    while blocks[-1] < n:  # some rows at a time, so nothing but cols grows with the features of the sample
        blocks.append(max(blocks[-1] + 1, int(np.searchsorted(ends, ends[blocks[-1]] + (1 << 21), "right")) - 1))
    spans = list(zip(blocks[:-1], blocks[1:], strict=True))

    def forward(v: np.ndarray) -> np.ndarray:
        u, out = scale * v[:-1], np.empty(n)
        for a, b in spans:
            total = np.concatenate([[0.0], np.cumsum(u[cols[ends[a] : ends[b]]])])
            out[a:b] = np.diff(total[ends[a : b + 1] - ends[a]])
        return out + v[-1]

    def backward(g: np.ndarray) -> np.ndarray:
        out = np.zeros(n_cols)
        for a, b in spans:
            out += np.bincount(cols[ends[a] : ends[b]], np.repeat(g[a:b], np.diff(ends[a : b + 1])), minlength=n_cols)
        return np.append(out * scale, g.sum())

    def loss(v: np.ndarray) -> float:
        s = forward(v)
        return float((weight * (np.logaddexp(0, s) - y * s)).sum() + (penalty * v * v).sum() / 2)

    w = np.zeros(n_cols + 1)
    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(forward(w))
        g = backward(weight * (p - y)) + penalty * w
        curve = weight * (p * (1 - p) + 1e-9)
        step, r = np.zeros_like(w), -g
        d, rr = r.copy(), float(r @ r)
        stop = rr * 1e-4
        for _ in range(inner):
            hd = backward(curve * forward(d)) + penalty * d
            a = rr / float(d @ hd)
            step += a * d
            r = r - a * hd
            new = float(r @ r)
            if new <= stop:
                break
            d, rr = r + new / rr * d, new
        size = 1.0
        while size > 1e-4 and (trial := loss(w + size * step)) >= now:
            size /= 2
        if size <= 1e-4:
            break
        done, w, now = now - trial < 1e-6, w + size * step, trial
        if done:
            break
    return w[:-1], float(w[-1])


#: Toxicity: labelled rows, texts of the sample that an n-gram must occur in, smoothing of their counts, penalty.
TOXIC_ROWS, TOXIC_LEAST, TOXIC_ALPHA, TOXIC_L2 = 5_000, 3, 1.0, 1e-3


def log_count_ratios(n1: np.ndarray, n0: np.ndarray, m1: float, m0: float) -> np.ndarray:
    """Naive Bayes: log ratio of the smoothed shares of the m1 and m0 texts that hold each n-gram."""
    a = TOXIC_ALPHA
    return np.log((n1 + a) / (m1 + 2 * a)) - np.log((n0 + a) / (m0 + 2 * a))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = TOXIC_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Linear:
    """Character n-grams scaled by naive Bayes log-count ratios, then a linear classifier.

    r is the log ratio of the smoothed shares of toxic and other texts of the sample that hold an n-gram. All n-grams in TOXIC_LEAST texts or
    more are features, those that speak for toxicity and those against; a feature of a text is r if the n-gram occurs in it, and the
    weights of the scaled features are fitted by logistic regression in which both classes weigh alike, however few texts
    are toxic. The driver holds some 8 bytes for each distinct feature of each text of the sample."""
    train = training_texts(docs, labels, label, max_rows, key, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << CHAR_BITS), np.int32)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for lo, _hi, data, offsets in byte_chunks(batch.column(0)):
                r, f = char_features(data, offsets)
                for c in (0, 1):
                    at, n = np.unique(f[toxic[lo + r] == bool(c)], return_counts=True)
                    total[c, at] += n.astype(np.int32)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[c, at].astype(np.int64)) for c in (0, 1))], ["f", "n0", "n1"])

    by = {r["y"]: float(r["count"]) for r in train.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    m1, m0 = by.get(True, 0.0), by.get(False, 0.0)
    counts = train.select("text", "y").transform(arrow_map, count, "f bigint, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    seen = counts.where(F.col("n0") + F.col("n1") >= TOXIC_LEAST).toPandas().sort_values("f") if m1 and m0 else None
    if seen is None or seen.empty:
        return constant(np.repeat([0.0, 1.0], [int(m0), int(m1)]), CHAR_BITS)
    used = seen["f"].to_numpy()
    useful = np.zeros(1 << CHAR_BITS, bool)
    useful[used] = True
    shared = train.sparkSession.sparkContext.broadcast(np.packbits(useful))  # a bit for each hashed feature

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column(0)):
                r, f = char_features(data, offsets, wanted)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(hi - lo + 1)), pa.int32()), pa.array(f.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists], ["order", "y", "f"])

    found = train.select("text", "order", "y").transform(arrow_map, select, "order bigint, y int, f array<int>").orderBy("order", "y")
    y, sizes, cols = [], [], []
    place = np.zeros(1 << CHAR_BITS, np.int32)
    place[used] = np.arange(len(used))
    for batch in found.toArrow().to_batches():
        y.append(batch.column(1).to_numpy(zero_copy_only=False) > 0)
        sizes.append(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
        cols.append(place[batch.column(2).flatten().to_numpy()])
    toxic = np.concatenate(y).astype(float)
    r = log_count_ratios(seen["n1"].to_numpy(), seen["n0"].to_numpy(), m1, m0)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    w, b = fit_logistic(ends, np.concatenate(cols), r, toxic, np.where(toxic > 0, 0.5 / m1, 0.5 / m0), TOXIC_L2)
    weights = np.zeros(1 << CHAR_BITS, np.float32)
    weights[used] = w * r
    return Linear(weights, b)


#: Quality: labelled rows, passes over them, and the settings of follow-the-regularised-leader.
QUALITY_ROWS, QUALITY_EPOCHS = 6_000, 3
FTRL_ALPHA, FTRL_BETA, FTRL_L1, FTRL_L2 = 0.5, 1.0, 0.05, 0.5


class Ftrl:
    """Follow-the-regularised-leader (proximal), logistic loss, a learning rate for each coordinate."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * FTRL_L1) / ((FTRL_BETA + np.sqrt(n)) / FTRL_ALPHA + FTRL_L2)
        return np.where(np.abs(z) <= FTRL_L1, 0.0, w)

    def learn(self, at: np.ndarray, g: np.ndarray) -> None:
        """One step by the gradients g of the coordinates at."""
        w = self.weights(at)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / FTRL_ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = QUALITY_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Linear:
    """Hashed word n-grams, each with the root of its share of the text's n-grams; FTRL over the sample."""
    train = training_texts(docs, labels, label, max_rows, key, text)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column(0)):
                r, f, n, words = word_features(data, offsets)
                ends = pa.array(np.searchsorted(r, np.arange(hi - lo + 1)), pa.int32())
                x = np.sqrt(n / np.maximum(words[r], 1)).astype(np.float32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (f.astype(np.int32), x)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists], ["order", "y", "f", "x"])

    table = train.select("text", "order", "y").transform(arrow_map, extract, "order bigint, y int, f array<int>, x array<float>").toArrow().combine_chunks()
    y = (table["y"].to_numpy() > 0).astype(float)
    if len(set(y.tolist())) < 2:
        return constant(y, WORD_BITS)
    ends, f, x = np.concatenate([[0], np.cumsum(table["f"].combine_chunks().value_lengths().to_numpy())]), table["f"].combine_chunks().flatten().to_numpy(), table["x"].combine_chunks().flatten().to_numpy()
    order = np.lexsort((y, table["order"].to_numpy()))
    model, bias = Ftrl(1 << WORD_BITS), Ftrl(1)
    one = np.zeros(1, np.int64)
    for _ in range(QUALITY_EPOCHS):
        for i in order:
            at, v = f[ends[i] : ends[i + 1]], x[ends[i] : ends[i + 1]].astype(float)
            error = float(sigmoid(model.weights(at) @ v + bias.weights(one)[0])) - y[i]
            model.learn(at, error * v)
            bias.learn(one, np.array([error]))
    return Linear(model.weights(slice(None)).astype(np.float32), float(bias.weights(slice(None))[0]))


# --- scoring --------------------------------------------------------------------------------


def toxic_values(weights: np.ndarray, useful: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    r, f = char_features(data, offsets, useful)
    return np.bincount(r, weights[f], minlength=len(offsets) - 1)


def quality_values(weights: np.ndarray, useful: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    r, f, n, words = word_features(data, offsets, useful)
    return np.bincount(r, weights[f] * np.sqrt(n / np.maximum(words[r], 1)), minlength=len(offsets) - 1)


def score(spark: SparkSession, docs: DataFrame, model: Linear, values: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of every text, a sparse dot product, in column `out`."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists already")
    shared = spark.sparkContext.broadcast((model.weights, model.intercept))  # 4 bytes for each hashed feature
    kept = docs.columns
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b = shared.value
        useful = weights != 0
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column(at)):
                s = sigmoid(values(weights, useful, data, offsets) + b)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(s)], [*kept, out])

    return docs.transform(arrow_map, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


TOXIC_AT, QUALITY_AT = 0.3, 0.7


def _judged(spark: SparkSession, docs: DataFrame, model: Linear, values: Callable, at: float, key: str, text: str) -> DataFrame:
    rows = docs.select(key, F.col(text).cast("string").alias("text"))
    scored = score(spark, rows, model, values)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def judge_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted (score >= TOXIC_AT) of every row; other columns are left out. Nulls, empty and very long texts,
    repeated rows and empty tables: see the module's text."""
    return _judged(spark, docs, fit_toxicity(docs, labels, key=key, text=text), toxic_values, TOXIC_AT, key, text)


def judge_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted (score >= QUALITY_AT) of every row; other columns are left out. Nulls, empty and very long
    texts, repeated rows and empty tables: see the module's text."""
    return _judged(spark, docs, fit_quality(docs, labels, key=key, text=text), quality_values, QUALITY_AT, key, text)
