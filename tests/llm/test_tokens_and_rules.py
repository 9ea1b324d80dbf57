"""BPE, token files and quality rules against plain Python on small rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from darkslide.llm import bpe, quality_rules, token_store, tokenize_op
from darkslide.llm.bpe import encoder, forced_pairs

TEXTS = [
    (1, "The cat sat on the mat.\nThe cat sat on the mat.\n\n  twice # $ | "), (2, ""), (3, None), (4, "x"), (5, "word " * 20_000), (6, "it's   we'll   <|endoftext|> café!'s \U0001f600"),
    (7, "a b c a b c a b"), (8, "a a a a"), (8, "a a a a"), (9, " \t\n\x0b"), (10, "UP UP!! " * 60), (11, "one two\r\nthree"),
]
PIECES = ["a", "b", "'", "'s", "'ll", " ", "  ", "\n", " ", "é", "23", "!", "“", "\U0001f600", " ", "<|endoftext|>", "\x1c", "\x85", "中", "re"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenize_op.default_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_forced_boundaries_change_no_id(parts):
    coder, text = encoder(tokenize_op.default_path()), "".join(parts)
    found = coder.tokenizer.encode(text, add_special_tokens=False)
    packed = coder.encode(text.encode())
    assert np.frombuffer(packed, "<u4").tolist() == found.ids
    assert coder.decode(packed) == coder.tokenizer.decode(found.ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, "<|endof", "text|>", "antidisestablishment"]), max_size=10), max_size=6), st.sampled_from([7, 40, 1 << 20]))
def test_rows_are_encoded_together_and_in_windows(rows, window):
    coder, texts = encoder(tokenize_op.default_path()), ["".join(r) for r in rows]
    raw = [t.encode() for t in texts]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "WINDOW_BYTES", window)
        ids, counts = coder.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [t.decode() for t in coder.decode_rows(ids, counts)] == texts


def test_a_full_table_and_long_fragments_change_no_id(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_FRAGMENTS", 40)
    coder = bpe.ForcedBoundaryBpe(tokenize_op.default_path())
    rng = np.random.default_rng(1)
    for _ in range(6):
        text = " ".join("".join(rng.choice(list("abcé"), rng.integers(1, 90))) for _ in range(60)) + "<|endoftext|> end"
        assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(coder.memo) <= 40 + len(coder.fragments(text.encode()))


def test_a_text_of_50_mb(library):
    text = ("Some words, 23 of them; and a newline\n" * 1000 + "x" * 5000) * 1200
    ids, counts = encoder(tokenize_op.default_path()).encode_rows(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    part = library.encode(text[: len(text) // 1200], add_special_tokens=False).ids
    assert len(text) > 50_000_000 and counts.tolist() == [1200 * len(part)] and (ids.reshape(1200, -1) == part).all()


def test_forced_pairs_come_from_the_vocabulary():
    forced = forced_pairs([b"ab", b"bc"])
    assert not forced[97, 98] and not forced[98, 99] and forced[97, 99] and forced[98, 97]


def test_round_trip(spark, docs, library):
    got = sorted(map(tuple, tokenize_op.round_trip(docs).collect()))
    want = []
    for k, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
    assert got == sorted(want)
    assert tokenize_op.round_trip(docs.limit(0)).count() == 0


def test_clashing_columns_are_refused(docs):
    with pytest.raises(ValueError):
        tokenize_op.decode_column(tokenize_op.encode_column(docs, "doc_id", "text"), "ids", "IDS")


def test_token_files(spark, docs, library, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_IDS", 50)
    got = sorted(map(tuple, token_store.store_and_read(spark, docs).collect()))
    at, want = 0, []
    for k, t in sorted(TEXTS, key=lambda x: (x[0], x[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert token_store.store_and_read(spark, docs.limit(0)).count() == 0


def test_a_key_that_all_rows_share_is_dealt_over_parts(spark, tmp_path):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('text ', id % 7) as text")
    token_store.write_tokens(spark, docs, str(tmp_path / "t"), partitions=8)
    per = [r.n for r in spark.read.parquet(str(tmp_path / "t")).selectExpr("part", "size(keys) as n").groupBy("part").sum("n").toDF("part", "n").collect()]
    assert sum(per) == 4000 and max(per) < 1000
    assert sorted(r.start for r in token_store.read_tokens(spark, str(tmp_path / "t")).collect())[0] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.integers(0, 1500), st.integers(0, 1500))
def test_codes_are_directly_addressable(values, a, b):
    ids = np.array(values, np.uint32)
    reader = token_store.DacReader(token_store.dac_encode(ids))
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert reader.read(a, b).tolist() == values[a:b]
    assert [reader.get(i) for i in range(0, len(ids), 37)] == values[::37]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(words) < 3000 else set(range(len(words)))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_statistics(docs):
    rows = quality_rules.judge(docs).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = []
    for k, t in TEXTS:
        s = brute(t)
        want.append((k, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(want)
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_votes_are_weighed_by_estimated_accuracy():
    patterns = {(1, 1, 1): 700, (-1, -1, 1): 180, (-1, -1, -1): 60, (1, 1, -1): 60}
    m = quality_rules.fit_votes(patterns, 3)
    odds = {p: m.log_odds(p) for p in patterns}
    assert max(m.tables[0][1][-1], m.tables[1][1][-1]) > m.tables[2][1][-1]
    assert odds[1, 1, 1] > odds[1, 1, -1] > 0 > odds[-1, -1, 1] > odds[-1, -1, -1]


def test_expectation_maximisation_equals_a_plain_one():
    patterns = {(1, 1, 0): 40, (-1, 0, 1): 25, (-1, -1, -1): 20, (0, 1, 1): 15}
    share = {p: 0.1 if -1 in p else 0.9 for p in patterns}
    total, prior = sum(patterns.values()), 0.5
    for _ in range(7):
        prior = (sum(n * share[p] for p, n in patterns.items()) + 1) / (total + 2)
        weight = 1 + quality_rules.PRIOR_WEIGHT * total
        tables = []
        for k in range(3):
            row = []
            for c in (0, 1):
                n = {v: weight * quality_rules.EXPECTED[c][v] + sum(m * (share[p] if c == 0 else 1 - share[p]) for p, m in patterns.items() if p[k] == v) for v in (-1, 0, 1)}
                row.append({v: n[v] / sum(n.values()) for v in n})
            tables.append(row)
        for p in patterns:
            good, bad = prior, 1 - prior
            for k, v in enumerate(p):
                good, bad = good * tables[k][0][v], bad * tables[k][1][v]
            share[p] = good / (good + bad)
    m = quality_rules.fit_votes(patterns, 3, rounds=7)
    assert abs(m.prior - prior) < 1e-9
    for p in patterns:
        assert abs(1 / (1 + np.exp(-m.log_odds(p))) - share[p]) < 1e-9


def test_statistics_keep_all_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8)], "q2 int, text string, _n int, _words int")
    assert quality_rules.text_statistics(df).select("q2", "_n", "_words", "q.n_words").first()[:] == (1, 7, 8, 2)
    with pytest.raises(ValueError):
        quality_rules.text_statistics(df.withColumnRenamed("q2", "Q"))
    assert quality_rules.judge(df.withColumnRenamed("q2", "q"), key="q").first()["q"] == 1


def test_rules_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = quality_rules.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in kept if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in kept if r.quality == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.1 * len(bad)


def test_columns_of_ids_go_back_to_texts(docs):
    back = tokenize_op.decode_column(tokenize_op.encode_column(docs, "doc_id", "text"), "ids", "decoded").collect()
    assert sorted((r.doc_id, r.decoded) for r in back) == sorted((k, t or "") for k, t in TEXTS)
