"""Corpus preparation: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, written as Parquet and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from darkslide.llm import classifiers, decontaminate, jaccard_join, pii, tokenize_op
from darkslide.plans.session import materialize, unused_name

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is trained on labelled rows of docs. Null and empty texts have the score of
    the intercept; repeated rows go or stay together; long texts are scored whole."""
    model = classifiers.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = unused_name(docs, "quality_score")
    scored = classifiers.score(spark, docs, model, classifiers.quality_values, out=out)
    return scored.where(scored[out] >= classifiers.QUALITY_AT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word n-grams at a similarity of 0.8 tie together. Texts without words and rows
    without a key stay; rows of one doc_id are told apart by their texts; the least doc_id stays, of repeated rows one."""
    return jaccard_join.one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item, each row judged by its own text; null and empty texts stay."""
    return decontaminate.clean_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew; null and empty texts as they are."""
    return pii.redact_documents(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; null and empty texts have no tokens."""
    return tokenize_op.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't express the classifier, the field or the tokenizer; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
