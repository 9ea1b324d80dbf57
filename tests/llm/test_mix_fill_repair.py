"""Mixing, fill-in-the-middle and conversation repair against plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from darkslide.llm import conversations, fill_middle, mixing
from tests.conftest import SMALL

WS = " \t\n\x0b\x0c\r"


# mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by source, in exact rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.fixture(scope="module")
def mixed_rows():
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(0.8) * 4)), ["b", "a", "é", None, "big", "big", "big", "tiny"][i % 8] if i % 8 < 7 or i < 80 else "big") for i in range(3000)]
    return rows + [(5000, None, "a"), (5001, "", "a"), (5002, " \t ", None), (None, "x y", "b"), (None, "x y", "b")] + [(7, "same text here", "big")] * 1500


def test_mix_meets_targets_and_bounds(spark, mixed_rows):
    docs = spark.createDataFrame(mixed_rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.plan(docs).collect()
    assert len(got) == len(mixed_rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(i), str(s), words(t)) for i, t, s in mixed_rows)
    sizes, longest = {}, {}
    for _, t, s in mixed_rows:
        sizes[s] = sizes.get(s, 0) + words(t)
        longest[s] = max(longest.get(s, 0), words(t))
    target = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(r.target == pytest.approx(target[s]) for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= longest[s]
        p = target[s] / sizes[s]
        assert all(r.taken in (int(p + 1e-9) * r.size, (int(p + 1e-9) + 1) * r.size) or r.size == 0 for r in own)
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    assert any(r.taken == 3 * r.size and r.size for r in got)  # some source is at its limit


def test_mix_is_the_same_however_rows_are_dealt(spark, mixed_rows):
    a = mixing.plan(spark.createDataFrame(mixed_rows, "doc_id long, text string, source string").repartition(3))
    b = mixing.plan(spark.createDataFrame(mixed_rows[::-1], "doc_id long, text string, source string").repartition(11))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("bucket", [64, 4])
def test_pivotal_keeps_expectations_and_sums(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    n, sources, x = 40, 600, 0.37
    octaves = {o: sum(1 for k in range(n) if len(bin(1 + k % 9)) - 2 == o) for o in range(1, 5)}
    rows = [(s, k, 1 + k % 9, 0, x, octaves[len(bin(1 + k % 9)) - 2]) for s in range(sources) for k in range(n)]
    got = mixing.pivotal(spark.createDataFrame(rows, "s long, k long, size long, copy long, x double, n long"), 1, max(octaves.values())).collect()
    assert len(got) == n * sources and {r.up for r in got} == {0, 1}
    share, words = [0] * n, [0] * sources
    for r in got:
        share[r.k] += r.up / sources
        words[r.s] += r.up * r["size"]
    assert all(abs(v - x) < 0.09 for v in share)  # 4.5 standard deviations
    target = x * sum(1 + k % 9 for k in range(n))
    assert all(abs(v - target) <= 9 for v in words)
    assert len({tuple(sorted(r.k for r in got if r.s == s and r.up)) for s in range(50)}) == 50


def test_mixture_repeats_rows(spark, mixed_rows):
    docs = spark.createDataFrame([(*r, 1) for r in mixed_rows], "doc_id long, text string, source string, size int")
    out = mixing.mixture(docs).cache()
    assert out.columns == docs.columns
    planned = mixing.plan(docs).agg(F.sum("copies")).first()[0]
    assert out.count() == planned


def test_mix_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(docs).collect() == []
    assert [tuple(r) for r in mixing.plan(spark.createDataFrame([(1, None, None)], docs.schema)).select("doc_id", "size", "target", "taken").collect()] == [(1, 0, 0.0, 0)]


def test_word_count_of_a_very_long_text(spark):
    n = spark.range(1).select(F.expr("repeat('some words \t\n', 2000000)").alias("t")).select(mixing.word_count(F.col("t")).alias("n"))
    assert n.first()[0] == 4_000_000


# fill in the middle


def plain_fill(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


FILL = [(i, t) for i, t in enumerate([None, "", "a", "é", "one <P> two", "<M>", "< P>", "ab1cd", "\n\n", "\U0001f600 x" * 9, "a" * 300_000, "é, " * 100_000, ("word " * 40_000 + "<") * 9, "<S", "x" * 2_000_000 + "é" * 500_000])] + [(3, "same")] * 5 + [(None, "no key"), (None, "no key"), (-7, "minus seven words")]


def test_fill_against_plain(spark):
    docs = spark.createDataFrame([(*r, "c") for r in FILL], "doc_id long, text string, form string").repartition(4)
    key = lambda r: tuple(map(str, r))
    want = [plain_fill(*r) for r in FILL]
    got = fill_middle.digests(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted([(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, FILL, strict=True)], key=key)
    out = fill_middle.outputs(docs).cache()
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    back = fill_middle.restore(out).collect()
    assert sorted(map(tuple, back), key=key) == sorted([(i, t or "") for i, t in FILL], key=key)


def test_fill_query_against_plain(spark):
    from darkslide.llm.queries import op12_fill_middle

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = [(*w[:5], sha(w[5]), sha(r.text or "")) for r in docs for w in [plain_fill(r.doc_id, r.text)]]
    assert sorted(map(tuple, op12_fill_middle(spark, SMALL).collect())) == sorted(want)


def test_fill_of_an_empty_table(spark):
    assert fill_middle.digests(spark.createDataFrame([], "doc_id string, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<P>", "<S>", "<M>", "<", "P", ">", "é", "ab", "1", " "]), max_size=12), st.integers(1, 4), st.sampled_from(["psm", "spm"]))
def test_stretches_are_found_however_pieces_are_cut(parts, size, form):
    order = fill_middle.ORDERS[form]
    bodies = [re.sub("<[PSM]>", "", "".join(parts[i::3])).encode() for i in range(3)]
    if any(re.search(b"<[PSM]>", x) for x in bodies):
        return
    data = b"".join(fill_middle.MARKS[o] + b for o, b in zip(order, bodies, strict=True))
    if [m.start() for m in re.finditer(b"<[PSM]>", data)] != [sum(3 + len(b) for b in bodies[:i]) for i in range(3)]:
        return
    found = {}
    for place, some in fill_middle.stretches_of(form, (data[i : i + size] for i in range(0, len(data), size))):
        found[place] = found.get(place, b"") + some
    assert {fill_middle.PLACE[o]: b for o, b in zip(order, bodies, strict=True) if b} == found


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1 é\U0001f600<"), max_size=40), st.integers(1, 8), st.integers(1, 8))
def test_units_in_windows(monkeypatched, text, window, piece):
    monkeypatched(window, piece)
    data = text.encode()
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    import numpy as np

    view = np.frombuffer(data, np.uint8)
    counts = fill_middle.count_units(view)
    assert sum(counts) == len(units)
    for k in range(len(units) + 1):
        assert fill_middle.offset_of(view, counts, k) == len("".join(units[:k]).encode())
    cuts = list(fill_middle.chunks(view, 0, len(data)))
    assert b"".join(data[a:b] for a, b in cuts) == data


@pytest.fixture(scope="module")
def monkeypatched():
    before = fill_middle.WINDOW, fill_middle.PIECE

    def put(window, piece):
        fill_middle.WINDOW, fill_middle.PIECE = window, piece

    yield put
    fill_middle.WINDOW, fill_middle.PIECE = before


# conversations


def plain_repair(rows):
    """Every repair of every conversation, the best by cost and letters."""
    one = lambda x: " " if x is None else str(x)
    found = {}
    for c, t, r, x in rows:
        out = found.setdefault(c, [])
        r, x, k = one(r), one(x), zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        x = "" if k == 1 else re.sub(r"[.!?]", "", x) if k == 2 else x
        out += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: _plain_repair_of(v) for c, v in found.items()}


def _plain_repair_of(rows):
    digest = lambda a: hashlib.sha256(f"{len(a[1])}:{a[1]}{a[2]}".encode()).hexdigest()
    rows = sorted(rows, key=lambda a: (a[0] is not None, a[0] or 0, a[1].encode(), digest(a)))
    seen, faults = set(), []
    for _, r, x in rows:
        end = x.rstrip(WS)
        faults.append("b" if not end else "d" if (r, x) in seen else "t" if end[-1] not in ".!?" else "o")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    due = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    @lru_cache(None)
    def best(i, state, put):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, r, x = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, out))
            if faults[i] not in "bd":
                late = 5 * (faults[i] == "t")
                if (state, r[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    cost, audit, out = best(i + 1, r[:1], 0)
                    ways.append((cost + late, "K" + audit, (f"{r}:{x}", *out)))
                cost, audit, out = best(i + 1, due[state][0], 0)
                ways.append((cost + late + 1, "R" + audit, (f"{due[state]}:{x}", *out)))
        if put < 3:
            cost, audit, out = best(i, due[state][0], put + 1)
            ways.append((cost + 5, "I" + audit, (f"{due[state]}:", *out)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    cost, audit, out = best(0, "", 0)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(out))


CONV = "conv_id long, turn long, role string, text string"


def check_repair(spark, rows, schema=CONV):
    want = plain_repair([r[:4] for r in rows])
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    assert got == want


def test_repair_of_the_table(spark):
    from darkslide.llm.queries import op13_conversations

    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert {r[0]: tuple(r)[1:] for r in op13_conversations(spark, SMALL).collect()} == plain_repair([tuple(r) for r in rows])


def test_repair_of_random_conversations(spark):
    r = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "\U0001f600"]
    texts = ["Yes.", "No!", "Why", " ", "", None, "Fine?\n", "a. b", "Yes.", "\xa0"]
    rows = [(c, r.choice([*range(8), None]), r.choice(roles), r.choice(texts)) for c in [*range(300), None] for _ in range(r.randrange(1, 9))]
    check_repair(spark, rows + rows[:40])


def test_repair_of_hot_conversations_over_many_blocks(spark):
    r = random.Random(6)
    rows = [(1, t, r.choice(["user", "assistant", "tool"]), r.choice([f"text {t}.", f"text {t % 50}.", "cut", "Hm."])) for t in range(700)]
    rows += [(2, 5, "user", "again.")] * 600 + [(3, t, "user", "the same.") for t in range(300)] + [(4, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(0, 900, 2)]
    import sys

    sys.setrecursionlimit(50_000)
    check_repair(spark, [(*x, 1, 2) for x in rows], CONV + ", n int, kind int")


def test_repair_where_nothing_is_left(spark):
    dropped = next((c, t) for c in range(999) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    check_repair(spark, [(*dropped, "user", "Hi.")])
    assert conversations.repair(spark.createDataFrame([], CONV)).collect() == []


def test_repair_of_long_texts_and_named_conversations(spark):
    rows = [("a", 0, "user", "long " * 400_000 + "."), ("a", 1, "assistant", "x" * 1_000_000 + "?"), ("b:1", 0, "system", "S."), ("b:1", 1, "user", "Q?"), ("b:1", 2, "assistant", "A.")]
    check_repair(spark, rows, "conv_id string, turn int, role string, text string")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax\0"), st.sampled_from("otbd")).map("".join), max_size=20), st.integers(1, 5))
def test_blocks_give_what_one_pass_gives(codes, length):
    whole, _ = conversations.walked("".join(codes), conversations.END, conversations.START)
    parts = [codes[i : i + length] for i in range(0, len(codes), length)]
    after = [conversations.END]
    for p in reversed(parts):
        m = [x for row in conversations.matrix("".join(p), 0) for x in row]
        after.append(conversations.through(m, after[-1]))
        assert after[-1] == conversations.backwards("".join(p), 0, after[-2])
    after = after[::-1][1:]
    state, letters = conversations.START, []
    for p, v in zip(parts, after, strict=True):
        some, state = conversations.walked("".join(p), v, state)
        letters += some
    assert letters == whole
