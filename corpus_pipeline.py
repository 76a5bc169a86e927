"""The corpus pipeline: documents in, token ids out.

toxicity drops what it rejects, SimHash near-dedup keeps one document of each group, PII puts
pseudonyms in, mixing repeats and cuts documents to its sources' budgets, and SentencePiece
encodes what is there. Each stage is written and read again before the next one runs.

Defined results: a null or empty text is not toxic unless the labels say that such texts are, counts as
one document with all others of its kind in near-dedup, and has no words to mix, so it takes no part in
the mix; a null doc_id or source passes all stages (a null source is a source of its own); different texts
under one doc_id are documents each, repeated rows one; an empty table gives an empty result; other
columns pass all stages but the last, which returns its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somalog.llm import mixing, near_copies, pieces, pii, toxicity
from somalog.llm.common import checkpoint_root
from somalog.llm.queries import pseudonym_key, vocabulary_path
from somalog.session import ship

REJECTED_FROM = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under REJECTED_FROM; the scorer learns from the labels of docs."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < REJECTED_FROM).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8 or more),
    the one with the smallest doc_id."""
    return near_copies.keep_one(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal numbers and dates."""
    return pii.pseudonymize(docs, pseudonym_key(spark)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at most one a source is cut, at its budget."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' token ids, whose decoding is checked."""
    return pieces.encode(docs, vocabulary_path()).select("doc_id", "source", "n_ids", "exact", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("pii", with_pseudonyms),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL can express neither the scorer nor the fingerprints; tests compare run() with plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage returns is written in between."""
    ship(spark)
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
