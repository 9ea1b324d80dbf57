"""Personal data: fixed base spans, and more from a semi-Markov conditional random field.

Base spans are found by linear scans (`base_spans`). The field works on regions around digits and
@ signs: a region is cut into tokens, a segment is one token outside or up to MAX_TOKENS tokens (and MAX_CHARS characters, MAX_DIGITS
digits) of one kind (numbers with signs and spaces between, or unbroken text around an @), and a segment is scored as a whole (shape, digits,
check sum, parts, neighbours) together with the kind before it. Forward and backward sums over all segmentations give likelihood
gradients for training and the posterior of a segment; Viterbi picks boundaries and kinds jointly. What no base span covers
is decoded, and segments that are picked and likely enough are added; base spans always stay. Added spans come from the field alone.

It is trained here, on at most `max_regions` regions (of at most REGION_CHARS characters and REGION_TOKENS tokens each) of the
corpus with the base spans as labels, and what `gold_tokens` finds beside them. The phone number or card number of most such regions is
written in another form first (`written_anew`: without its country prefix, with brackets, a trunk zero, other signs), and a second copy of the region has a date, an
amount, a row of numbers or the like in its place (`no_number`), so the field has to know such numbers without what the base patterns ask for. All work is within one text and linear in its length: regions of more than WINDOW_TOKENS tokens, such as tables of numbers, are decoded
in windows that overlap by OVERLAP_TOKENS on either side, and a span counts in the window in whose own part it starts.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.textbuf import arrow_map


KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping for each kind, in linear time: an e-mail is
    found from its @, and no pattern can start inside a run of digits that it has left."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > end and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, end := m.end(), 0))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = len(_DIGIT.findall(m.group()))
                if 10 <= n <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# --- the field ------------------------------------------------------------------------------

#: Bounds of a segment.
MAX_TOKENS, MAX_CHARS, MAX_DIGITS = 16, 64, 20
WINDOW_TOKENS, OVERLAP_TOKENS = 2048, 4 * MAX_TOKENS
LABELS = 1 + len(KINDS)  # 0 is outside
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\s+|[^\w\s]|_")
_NUMERIC = re.compile(r"[0-9@+(][0-9@ ().+-]*")
_MARGIN, _JOIN = 24, 3
FEATURE_BITS = 16


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and @ signs with some characters of context; they don't overlap, and
    together they hold every digit and @ of the text."""
    out: list[list[int]] = []
    for m in _NUMERIC.finditer(text):
        if not _TRIGGER.search(m.group()):
            continue
        a, b = m.start(), m.end()
        lo, hi = max(0, a - _MARGIN), min(len(text), b + _MARGIN)
        while a > lo and not text[a - 1].isspace():
            a -= 1
        while b < hi and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1] + _JOIN:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << FEATURE_BITS) - 1)


_RUN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")


_PATTERN = str.maketrans("0123456789" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "a" * 52)
#: What a segment's features depend on: digits as 9 and letters as a, whether it is a card number or an address by its digits, and
#: what lies before and after it.
Look = tuple[str, bool, bool, str, str]


def _beside(text: str, at: int, way: int) -> str:
    """The kind of the character at a place, with a mark where a digit lies beyond a space or sign."""
    c = text[at] if 0 <= at < len(text) else ""
    kind = "d" if c.isdigit() else "w" if c.isalpha() else "s" if not c.strip() else c
    beyond = at + way
    return f"{kind}d" if kind not in "dw" and 0 <= beyond < len(text) and text[beyond].isdigit() else kind


def look(text: str, a: int, b: int) -> Look:
    """What there is to see of a whole candidate span."""
    s = text[a:b]
    pattern = s.translate(_PATTERN)
    n = pattern.count("9")
    card = 14 <= n <= 19 and luhn("".join(_DIGIT.findall(s)))
    ip = False
    if s.count(".") == 3:
        parts = s.split(".")
        ip = all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    return pattern, card, ip, _beside(text, a - 1, -1), _beside(text, b, 1)


@functools.lru_cache(1 << 15)
def segment_features(seen: Look) -> tuple[int, ...]:
    """Features of a candidate span."""
    s, card, ip, before, after = seen
    n = s.count("9")
    shape = "".join("9" if r[0] == "9" else "a" if r[0] == "a" else "_" if r.isspace() else r for r in _RUN.findall(s))
    names = [
        f"n{n}", f"shape{shape[:16]}", f"digits{shape[:16]}:{n}", f"long{min(8, len(s) // 4)}", f"before{before}", f"after{after}",
        f"plus{s[0] == '+'}", f"at{s.count('@')}:{'.' in s[s.find('@') :]}", f"luhn{card}:{n}", f"ip{ip}", f"ends{s[-1].isalnum()}", f"only{n == len(s)}",
    ]
    return tuple(_feature(n) for n in names)


@functools.lru_cache(1 << 12)
def outside_features(kind: str, length: int) -> tuple[int, ...]:
    return _feature(f"o{kind}"), _feature(f"o{kind}{length if kind == 'd' else ''}")


def outside_look(token: str) -> tuple[str, int]:
    kind = "d" if token[0].isdigit() else "w" if token[0].isalpha() else "s" if token.isspace() else token
    return kind, min(len(token), 20) if kind == "d" else 0


class Lattice:
    """Tokens of one region and its candidate segments, without weights."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], end: int):
        self.bounds = [t[0] for t in tokens] + [tokens[-1][1] if tokens else end]
        self.n = len(tokens)
        words = [text[x:y] for x, y in tokens]
        self.outside = [outside_look(t) for t in words]
        self.ends: list[list[tuple[int, Look]]] = [[] for _ in range(self.n + 1)]  # by end: (start token, look)
        numbers = [0, *accumulate(len(t) if t[0].isdigit() and t[0].isascii() else 0 for t in words)]
        marks = [0, *accumulate(t == "@" for t in words)]
        letters = [0, *accumulate(t[0].isalpha() for t in words)]
        spaces = [t.isspace() for t in words]
        blanks = [0, *accumulate(spaces)]
        for i in range(self.n):
            if spaces[i]:
                continue
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                if self.bounds[j] - self.bounds[i] > MAX_CHARS or numbers[j] - numbers[i] > MAX_DIGITS:
                    break
                numeric = numbers[j] - numbers[i] >= 4 and letters[j] == letters[i]
                if not spaces[j - 1] and (numeric or (marks[j] > marks[i] and blanks[j] == blanks[i])):
                    self.ends[j].append((i, look(text, self.bounds[i], self.bounds[j])))

    def scores(self, field: SemiMarkovField) -> tuple[list[float], list[list[tuple[int, list[float]]]]]:
        """Score of each outside token; of each segment by kind."""
        known, w = field.known, field.w

        def of(seen: tuple, features: Callable) -> list[float]:
            if (found := known.get(seen)) is None:
                if len(known) >= KNOWN_LOOKS:
                    known.clear()
                found = known[seen] = w[list(features)].sum(0).tolist()
            return found

        return [of(t, outside_features(*t))[0] for t in self.outside], [[(i, of(t, segment_features(t))[1:]) for i, t in at] for at in self.ends]


def lattices(text: str, a: int, b: int) -> Iterator[tuple[Lattice, int, int]]:
    """(lattice, first and end character of its own part) of the windows of text[a:b]."""
    held: list[tuple[int, int]] = []
    begin = a
    for m in _TOKEN.finditer(text, a, b):
        held.append(m.span())
        if len(held) == WINDOW_TOKENS + 2 * OVERLAP_TOKENS:
            stop = held[-OVERLAP_TOKENS][0]
            yield Lattice(text, held, m.end()), begin, stop
            begin, held = stop, held[-2 * OVERLAP_TOKENS :]
    yield Lattice(text, held, b), begin, b


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


#: Looks whose scores a worker remembers.
KNOWN_LOOKS = 1 << 16


class SemiMarkovField:
    """Weights by (feature, label), and of label pairs of neighbouring segments."""

    def __init__(self) -> None:
        self.w = np.zeros((1 << FEATURE_BITS, LABELS))
        self.t = np.zeros((LABELS, LABELS))
        self.known: dict[tuple, list[float]] = {}

    def __getstate__(self) -> dict:
        return {"w": self.w, "t": self.t, "known": {}}

    def viterbi(self, x: Lattice) -> list[tuple[int, int, int]]:
        """(start token, end token, kind) of the best segmentation."""
        outside, segments = x.scores(self)
        t = self.t.T.tolist()  # by label, from the label before
        best = [[0.0] + [-math.inf] * (LABELS - 1)]
        back: list[list] = [[None] * LABELS]
        # by position: the best score of going on with each label, and the label before it
        into = []
        for e in range(1, x.n + 1):
            reach = [max((p + q, -k) for k, (p, q) in enumerate(zip(best[-1], row, strict=True))) for row in t]
            into.append(reach)
            now, way = [-math.inf] * LABELS, [None] * LABELS
            now[0], way[0] = reach[0][0] + outside[e - 1], (e - 1, -reach[0][1])
            for i, s in segments[e]:
                for y, v in enumerate(s, 1):
                    total = into[i][y][0] + v
                    if total > now[y]:
                        now[y], way[y] = total, (i, -into[i][y][1])
            best.append(now)
            back.append(way)
        out, e = [], x.n
        y = best[e].index(max(best[e])) if x.n else 0
        while e > 0:
            i, prev = back[e][y]
            if y:
                out.append((i, e, y - 1))
            e, y = i, prev
        return out[::-1]

    def sums(self, x: Lattice) -> tuple[list[list[float]], list[list[float]], list[list[float]], float, list[float], list]:
        """By position: forward log sums by label, backward ones, forward ones of going on with each label; the log
        partition sum, and the scores."""
        outside, segments = x.scores(self)
        to, t = self.t.T.tolist(), self.t.tolist()
        f = [[0.0] + [-math.inf] * (LABELS - 1)]
        on = []
        for e in range(1, x.n + 1):
            on.append([_logsum([p + q for p, q in zip(f[-1], row, strict=True)]) for row in to])
            now = [[on[e - 1][0] + outside[e - 1]]] + [[on[i][y] + s[y - 1] for i, s in segments[e]] or [-math.inf] for y in range(1, LABELS)]
            f.append([_logsum(v) for v in now])
        on.append([_logsum([p + q for p, q in zip(f[-1], row, strict=True)]) for row in to])
        # backward, by label of what comes next: then over the label before
        ahead: list[list[list[float]]] = [[[] for _ in range(LABELS)] for _ in range(x.n + 1)]
        g = [[-math.inf] * LABELS for _ in range(x.n + 1)]
        g[x.n] = [0.0] * LABELS
        for e in range(x.n, -1, -1):
            if e < x.n:
                best = [_logsum(v) if v else -math.inf for v in ahead[e]]
                g[e] = [_logsum([p + q for p, q in zip(row, best, strict=True)]) for row in t]
            if e:
                ahead[e - 1][0].append(outside[e - 1] + g[e][0])
                for i, s in segments[e]:
                    for y in range(1, LABELS):
                        ahead[i][y].append(s[y - 1] + g[e][y])
        return f, g, on, _logsum(f[x.n]), outside, segments

    def posterior(self, x: Lattice) -> dict[tuple[int, int, int], float]:
        """Probability of each candidate (start token, end token, kind)."""
        _, g, on, z, _, segments = self.sums(x)
        return {(i, e, y - 1): math.exp(on[i][y] + s[y - 1] + g[e][y] - z) for e in range(1, x.n + 1) for i, s in segments[e] for y in range(1, LABELS)}

    def learn(self, x: Lattice, gold: list[tuple[int, int, int]], rate: float, decay: float) -> None:
        """A step up the log likelihood of the gold segmentation."""
        f, g, on, z, outside, segments = self.sums(x)
        was = self.t.copy()
        self.known.clear()
        if not math.isfinite(z):
            return
        feature = {(i, e): list(segment_features(v)) for e in range(x.n + 1) for i, v in x.ends[e]}
        starts = {s[0]: s for s in gold if (s[0], s[1]) in feature}
        k = y = 0
        while k < x.n:  # gold counts
            if k in starts:
                _, e, kind = starts[k]
                self.w[feature[k, e], kind + 1] += rate
            else:
                e, kind = k + 1, -1
                self.w[list(outside_features(*x.outside[k])), 0] += rate
            self.t[y, kind + 1] += rate
            k, y = e, kind + 1
        for e in range(1, x.n + 1):  # expected counts
            p = math.exp(on[e - 1][0] + outside[e - 1] + g[e][0] - z)
            self.w[list(outside_features(*x.outside[e - 1])), 0] -= rate * p
        step = np.zeros_like(self.t)
        for e in range(1, x.n + 1):
            reached = np.exp(np.array(f[e - 1]) + was[:, 0] + outside[e - 1] + g[e][0] - z)
            step[:, 0] += reached
            for i, s in segments[e]:
                p = np.exp(np.array(f[i])[:, None] + was[:, 1:] + np.array(s) + np.array(g[e][1:]) - z)
                np.add.at(self.w, (np.array(feature[i, e])[:, None], np.arange(1, LABELS)), -rate * p.sum(0))
                step[:, 1:] += p
        self.t = (self.t - rate * step) * (1 - decay)


MAX_REGIONS, EPOCHS, RATE, DECAY, SURE = 800, 5, 0.3, 1e-4, 0.9
#: Longest regions that are learnt from.
REGION_CHARS, REGION_TOKENS = 400, 400


def gold_tokens(x: Lattice, text: str, spans: list[Span], settled: tuple[int, int] = (0, 0)) -> list[tuple[int, int, int]]:
    """spans as segments of x, and what they leave: digits in one piece that are a card number, and the shortest phone number from a plus
    sign, where a base pattern runs on into other digits and fails; not in the stretch that is settled."""
    place = {c: i for i, c in enumerate(x.bounds)}
    out, end = [], -1
    for a, b, k in spans:
        if a in place and b in place and a >= end:
            out.append((place[a], place[b], k))
            end = b
    taken = np.zeros(x.n + 1, bool)
    for i, j, _ in out:
        taken[i:j] = True
    for j in range(1, x.n + 1):
        for i, _ in x.ends[j]:
            if (x.bounds[j] <= settled[0] or x.bounds[i] >= settled[1]) and (j == i + 1 or text[x.bounds[i]] == "+") and not taken[i:j].any():
                found = base_spans(text[x.bounds[i] : x.bounds[j]])
                if len(found) == 1 and found[0][:2] == (0, x.bounds[j] - x.bounds[i]) and found[0][2] >= 2:
                    out.append((i, j, found[0][2]))
                    taken[i:j] = True
    return sorted(out)


def written_anew(number: str, kind: int, n: int) -> str:
    """The n-th form (in turn) of a phone or card number that is written in groups of digits; the number itself where the form needs what it lacks."""
    if kind == 2:
        digits = re.sub("[^0-9]", "", number)
        return (number, ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), number, digits)[n % 4]
    m = re.match(r"\+[0-9]{1,3}[ .-]+", number)
    groups = re.findall("[0-9]+", number[m.end() :]) if m else []
    digits = "".join(groups)
    if not m or not 7 <= len(digits) <= 12:
        return number
    area, middle, last = digits[:3], digits[3:-4], digits[-4:]
    whole = len(digits) >= 9  # an area, a middle and four digits
    return (
        number, number[m.end() :], "-".join(groups), ".".join(groups), f"({area}) {middle} {last}" if whole else number, f"({area}) {middle}-{last}" if whole else number,
        f"0{digits[:2]} {digits[2:-4]} {last}" if whole else number, f"{area} {middle} {last}" if whole else number, f"({area}){middle}-{last}" if whole else number,
        f"{area}-{middle}-{last}" if whole else number, f"00{number[1:]}", f"{area}.{middle}.{last}" if whole else number,
    )[n % 12]


def no_number(rng: np.random.Generator, n: int) -> str:
    """Something with digits that is no personal data, of the n-th kind in turn."""
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    year, month, day = f"{rng.integers(1900, 2030)}", f"{rng.integers(1, 13):02}", f"{rng.integers(1, 29):02}"
    rows = " ".join(str(rng.integers(1, 10 ** int(rng.integers(1, 6)))) for _ in range(8))
    return (
        f"{year}-{month}-{day}", f"{day}/{month}/{year} 1{d(1)}:3{d(1)}", f"{day}.{month}.{year}", f"{1 + rng.integers(0, 9)},{d(3)},{d(3)}", f"${d(2)},{d(3)}.{d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        f"v{d(1)}.{d(2)}.{d(1)} build {d(5)}", f"{year}-{year}", f"{d(4)}-{d(4)}", f"#{d(5)}-{d(4)}", f"{d(2)}.{d(4)}, {d(1)}.{d(4)}", rows, rows.replace(" ", ", "), d(8), f"{year} {d(3)} {d(3)} {d(2)} {d(4)}",
        f"{year}-{month}-{day}T1{d(1)}:2{d(1)}:3{d(1)}", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", f"({year})", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(3)} x {d(3)} x {d(4)}", f"{d(10)}", f"{d(12)}", f"id={d(9)}",
    )[n % 23]


def fit(texts: list[str]) -> SemiMarkovField:
    """Train on region texts, labelled by their base spans."""
    field, rng, data = SemiMarkovField(), np.random.default_rng(17), []

    def add(t: str, a: int, b: int, other: str, kind: int | None) -> None:
        """t with `other` in the place of t[a:b], which is of this kind or no personal data."""
        t, end = t[:a] + other + t[b:], a + len(other)
        tokens = [m.span() for m in _TOKEN.finditer(t)]
        if len(tokens) <= REGION_TOKENS:
            x = Lattice(t, tokens, len(t))
            spans = [s for s in base_spans(t) if s[1] <= a or s[0] >= end] + ([] if kind is None else [(a, end, kind)])
            data.append((x, gold_tokens(x, t, sorted(spans), (a, end))))

    turn = 0
    for t in texts:
        numbers = [s for s in base_spans(t) if s[2] >= 2]
        if not numbers:
            add(t, 0, 0, "", None)
            continue
        a, b, kind = numbers[turn % len(numbers)]
        add(t, a, b, written_anew(t[a:b], kind, turn), kind)
        add(t, a, b, no_number(rng, turn), None)
        turn += 1
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(data)):
            field.learn(*data[i], RATE / (1 + epoch), DECAY)
    return field


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", max_regions: int = MAX_REGIONS) -> SemiMarkovField:
    """Fit on a sample of at most max_regions regions (of at most REGION_CHARS characters), chosen by a hash of their text over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: set[tuple[int, str]] = set()  # the task's least ones so far
        for batch in batches:
            best: list[tuple[int, str]] = []
            for t in batch.column(0):
                s = t.as_py()
                if s and _TRIGGER.search(s):
                    for a, b in regions(s):
                        if b - a <= REGION_CHARS:
                            r = s[max(0, a - 12) : b + 12]
                            best.append((zlib.crc32(r.encode()), r))
            kept = set(sorted(kept.union(best))[:max_regions])
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.string())], ["h", "region"])

    found = docs.select(F.col(text).cast("string").alias("text")).transform(arrow_map, run, "h bigint, region string")
    rows = found.distinct().orderBy("h", "region").limit(max_regions).collect()
    return fit([r["region"] for r in rows])


def gaps(spans: list[Span], a: int, b: int) -> list[tuple[int, int]]:
    """Stretches of a to b that no span covers; spans in order of their start."""
    out = []
    for c, d, _ in spans:
        if c > a:
            out.append((a, c))
        a = max(a, d)
    return [*out, (a, b)] if a < b else out


def added_spans(field: SemiMarkovField, text: str, base: list[Span]) -> list[Span]:
    """Segments that the field finds beside the base spans: each stretch between base spans is decoded by itself."""
    out: list[Span] = []
    at = 0
    reach = list(accumulate((s[1] for s in base), max))  # how far the spans up to each one go
    for a, b in regions(text):
        lo, hi = max(0, a - 12), min(len(text), b + 12)
        while at < len(base) and reach[at] <= lo:
            at += 1
        near = at
        while near < len(base) and base[near][0] < hi:
            near += 1
        for c, d in gaps(base[at:near], lo, hi):
            if not _TRIGGER.search(text, c, d):
                continue
            for x, begin, end in lattices(text, c, d):
                if not any(x.ends):
                    continue
                path = field.viterbi(x)
                if path:
                    p = field.posterior(x)
                    found = ((x.bounds[i], x.bounds[e], k) for i, e, k in path if p[i, e, k] >= SURE)
                    out += [s for s in found if begin <= s[0] < end]
    kept: list[Span] = []
    for s in sorted(set(out)):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def all_spans(field: SemiMarkovField, text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the field adds)."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, added_spans(field, text, base)


def find(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", field: SemiMarkovField | None = None, keep_text: bool = False) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added of every row,
    and with keep_text the text with every span replaced by its kind (column redacted).

    Null and empty texts have no spans and the digest of nothing; repeated rows are each returned; an empty table gives no rows;
    other columns are left out. Texts of any length are read whole; beside the text and its spans a task holds one window."""
    shared = spark.sparkContext.broadcast(field or train(docs, key, text))
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *(["redacted"] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cells: list[list] = [[] for _ in names]
                for t in part.column(1):
                    s = t.as_py()
                    base, more = all_spans(model, s)
                    every = sorted([*base, *more], key=lambda x: (x[0], x[2]))
                    row = [*(sum(x[2] == k for x in base) for k in range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(more)]
                    if keep_text:
                        row.append(s if not every else redact(s, every))
                    for c, v in zip(cells, row, strict=True):
                        c.append(v)
                kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=False))], ["key", *names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint" + ", redacted string" * keep_text
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.transform(arrow_map, run, schema).withColumnRenamed("key", key)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by <KIND>; spans that overlap are replaced as one, by the first kind."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with personal data replaced in the text; a column `length` is counted anew.
    Rows and columns stay as they are otherwise; null and empty texts, repeated rows and empty tables too."""
    shared = spark.sparkContext.broadcast(train(docs, key, text))
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = []
                for t in part.column(at):
                    s = t.as_py()
                    base, more = all_spans(model, s)
                    spans = sorted([*base, *more], key=lambda x: (x[0], x[2]))
                    texts.append(redact(s, spans) if spans else s)
                cells = list(part.columns)
                cells[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cells, names)

    out = docs.transform(arrow_map, run, docs.schema)
    if length in names:
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.char_length(text).cast(docs.schema[length].dataType)))
    return out
