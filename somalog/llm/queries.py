"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somalog.llm import ann, filter_audit, hard_negatives, license_scan, media, mixing, ngram_join, pieces, pii, quality, simhash, substring, toxicity
from somalog.llm.common import cut

#: The vocabulary that op5 and the pipeline encode with.
VOCABULARY = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, pseudonym_key(spark))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The session's key. Where it sets none, as on test tables, the queries take a public one,
    with which anybody can turn pseudonyms back."""
    if spark.conf.get(pii.KEY_SETTING, None):
        return pii.key_of(spark)
    warnings.warn(f"{pii.KEY_SETTING} is not set: pseudonyms are made with a public test key", stacklevel=2)
    return b"public key of the test tables"


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer files are on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, vocabulary_path()).select("doc_id", "n_ids", "exact", "ids")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = media.media_columns(_table(spark, sf_dir, "documents"))
    return columns.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "depth")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.with_size(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    return mixing.mix(cut(sized)).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_table(spark, sf_dir, "documents"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut(hard_negatives.quantized(_table(spark, sf_dir, "embeddings"), label))
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))


OP9_SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
    FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i
    FROM d GROUP BY source),
w AS (SELECT source, source_size, i, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS cap FROM s),
r AS (
    SELECT source, source_size, cap, w,
           (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
            - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
           / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM w),
t AS (
    SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * CAST(w AS DOUBLE)) AS target FROM r),
b AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
           CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM b
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle_sql(), "op9_mix_sources": OP9_SQL, "op11_ngram_join": ngram_join.ORACLE_SQL, "op12_filter_interactions": filter_audit.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
