"""Quality by importance resampling.

Two generative models over hashed n-grams (a bag of words and word pairs in a fixed number of
buckets) are estimated, one of the raw corpus and one of target text. A document's log weight is
the log likelihood ratio of its n-grams, and the sample is the top k of log weight plus Gumbel
noise, which draws without replacement in proportion to the weights. Noise comes from a hash of
doc_id and a seed, so reruns agree.

The raw model counts all documents. The target model counts the labelled good documents, at
most `target_docs` of them by hash of doc_id. The k-th key is found by narrowing its range with
counts, never by sorting the corpus in one place.

Defined results: null and empty texts have no n-grams and log weight 0; a null doc_id draws noise
as one more id; repeated rows draw the same noise and are kept or dropped alike, ties at the
k-th key too; without target text all log weights are 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.llm.common import cut

BUCKETS, TARGET_DOCS, KEEP, SEED = 10_000, 10_000, 0.8, 20
CACHED = 100_000
_TOKENS = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Bucket numbers of a text's words, runs of punctuation, and neighbouring pairs of them."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = np.uint64(buckets), {}

    def of(self, text: bytes | None) -> np.ndarray:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        tokens = _TOKENS.findall((text or b"").lower())
        one = np.array([known.get(t) or known.setdefault(t, xxhash.xxh3_64_intdigest(t) | 1) for t in tokens], np.uint64)
        two = (one[:-1] * _PAIR) ^ (one[1:] >> np.uint64(7))
        two = (two ^ (two >> np.uint64(31))) * _PAIR
        return np.concatenate(((one >> np.uint64(20)) % self.buckets, (two >> np.uint64(20)) % self.buckets)).astype(np.int64)


def counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of those with target = true."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(buckets)
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"], strict=True):
                n = np.bincount(grams.of(text), minlength=buckets)
                total[0] += n
                if target:
                    total[1] += n
        seen = np.nonzero(total[0])[0]
        yield pd.DataFrame({"bucket": seen, "raw": total[0][seen], "target": total[1][seen]})

    texts = docs.select(F.col("text").cast("binary").alias("text"), "target")
    return texts.mapInPandas(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def target_ids(labels: DataFrame, target_docs: int = TARGET_DOCS) -> DataFrame:
    """doc_id of labelled good documents, at most target_docs."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)


def log_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """For each bucket the log of its share in target text over its share in the corpus."""
    good = F.broadcast(target_ids(labels, target_docs).withColumn("target", F.lit(True)))  # at most target_docs rows
    found = counts(docs.select("doc_id", "text").join(good, "doc_id", "left"), buckets).collect()  # a row a bucket
    raw, target = np.ones(buckets), np.ones(buckets)  # so that none is empty
    for r in found:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight)"""
    kind = T.StructType([T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    @F.pandas_udf(kind)
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams(len(ratio))
        for texts in batches:
            found = [grams.of(t) for t in texts]
            yield pd.DataFrame({"n_grams": [len(g) for g in found], "log_weight": [math.fsum(ratio[g]) for g in found]})

    return docs.select("doc_id", weigh(F.col("text").cast("binary")).alias("w")).select("doc_id", "w.*")


def threshold(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, by counting values in ever narrower ranges."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return math.inf
    if k >= n:
        return low
    above = 0  # values over high
    while low < high:
        step = (high - low) / 1024
        if step == 0 or low + step == low:
            break
        slot = F.least(F.floor((F.col(column) - low) / step), F.lit(1023))
        inside = keys.where(F.col(column).between(low, high)).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).orderBy(F.desc("slot")).collect()
        for r in inside:
            if above + r.n >= k:
                low, high = r.least, r.most
                break
            above += r.n
    return low


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, sample_key, selected): all documents; selected are the
    share `keep` with the greatest keys, ties included."""
    weights = log_weights(docs, log_ratio(docs, labels, buckets, target_docs))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keys = cut(weights.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))))
    least = threshold(keys, "sample_key", math.ceil(keep * keys.count()))
    return keys.withColumn("selected", F.col("sample_key") >= least)
