"""The pipeline's stages over small documents, each against plain Python on what it was given."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from darkslide.llm import pii, tokenize_op
from tests.llm.test_document_ops import SCHEMA, brute_links, brute_overlaps, brute_spans

D = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()

    kept = {r.doc_id for r in seen["quality"]}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) > 0.97 * len(good) and sum(d in kept for d in bad) < 0.1 * len(bad)

    groups = brute_links([(r.doc_id, r.text) for r in seen["quality"]])
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted({g for _, g, _ in groups})

    rows = [(r.doc_id, r.text) for r in seen["near_duplicates"] if len(r.text) < 2500]
    leaks = {k for k, _ in brute_overlaps(rows, items)}
    left = {r.doc_id for r in seen["decontamination"]}
    assert leaks and not leaks & left and {k for k, _ in rows} - leaks <= left

    was = {r.doc_id: r for r in seen["decontamination"]}
    assert len(seen["personal_data"]) == len(was)
    for r in seen["personal_data"]:
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if not pii._TRIGGER.search(was[r.doc_id].text):
            assert r == was[r.doc_id]

    library = Tokenizer.from_file(tokenize_op.default_path())
    text = {r.doc_id: r.text for r in seen["personal_data"]}
    for r in seen["tokens"]:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert len(seen["tokens"]) == len(text) < len(before)


def test_odd_and_empty_documents(spark):
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None), (None, "plain words in a row here", "en", "s", 25), (3, "mail a@b.c or more " * 30, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() <= len(rows), name
        assert stage(spark, docs.limit(0), D).count() == 0, name
    redacted = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, D).collect() if r.doc_id}
    assert redacted[3].text == "mail <EMAIL> or more " * 30 and redacted[3].n_chars == len(redacted[3].text)
    assert redacted[1].text is None and redacted[1].n_chars == 0


CLASHING = ["key", "text_", "ids", "d1", "cid", "rep", "count", "score", "digest", "quality_score", "h", "class_id", "y", "order", "item", "url", "posterior", "n_words"]


def test_columns_with_names_that_the_operators_use(spark):
    docs = spark.createDataFrame([(1, "a plain text of some words", "en", "s", 26), (2, "a plain text of some words", "en", "s", 26), (2, "a plain text of some words", "en", "s", 26)], SCHEMA)
    wide = docs.selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(CLASHING)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, D)
        if name != "tokens":
            assert out.columns == wide.columns, name
        rows = out.collect()
        assert all(r["posterior"] == CLASHING.index("posterior") for r in rows if name != "tokens"), name
    assert corpus_pipeline.near_duplicates(spark, wide, D).count() == 1
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "1 as y", "2 as `order`", "'x' as text")
    from darkslide.llm import classifiers, license_scan, pii, quality_rules, token_store

    assert classifiers.judge_quality(spark, wide, labels).count() == classifiers.judge_toxicity(spark, wide, labels).count() == 3
    assert license_scan.scan(spark, wide).count() == 0
    assert quality_rules.judge(wide).count() == pii.find(spark, wide).count() == token_store.store_and_read(spark, wide).count() == 3


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
