"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. Every pivot has an inverted file of the
vectors that count it among their `prefix` nearest, with its place in their order. A query
visits the files of its own nearest pivots and adds up, from the places alone, the footrule
distance between the orders (with places beyond the prefix taken as `prefix`). The share
`rerank` of vectors with the least footrule distance is then ranked by exact cosine in double
precision.

The index is cut into shards of a bounded number of vectors, each dealt to a task once. The
queries, a small share of all rows, are sent to every shard and stream past its inverted files, so a
task holds one shard and a batch of queries, and gives its best `k` for each. Equal vectors are
indexed as one, with the k + 1 smallest ids, which is all that any answer can hold. Pivots
are a sample of `pivots` vectors by hash of vec_id; every vector is indexed.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part; vectors of another length than the query's are no candidates; equal scores go by
vec_id; repeated rows of one vec_id are one, and of different vectors under one vec_id the
least, component by component, counts; a null vec_id takes no part; with too few
candidates a query gets all there are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somalog.llm.common import cut

PIVOTS, PREFIX, RERANK = 256, 64, 0.35
SHARD_ROWS = 16_384
SALTS = 64
#: So many rows are taken from Arrow at once.
ROWS = 1024
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part, brought near length 1 by a
    power of two, which changes no cosine and keeps squares of huge and tiny components in range."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine).where(some)
    one = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("embedding", F.abs)))))
    return one.withColumn("_by", power).select("vec_id", F.transform("embedding", lambda x: x / F.col("_by")).alias("embedding"))


def unique(vectors: DataFrame, ids: int) -> DataFrame:
    """(embedding, vec_ids): equal vectors as one row, with their smallest ids. Ids are cut to
    that number in salted parts first, so that no copied vector fills a task."""
    for keys in (["embedding", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))], ["embedding"]):
        least = Window.partitionBy(*keys).orderBy("vec_id")
        vectors = vectors.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= ids).drop("_n")
    return vectors.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("vec_ids"))


def _nearest(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots in order."""
    scaled = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.argsort(-(scaled @ pivots.T), axis=1, kind="stable")[:, :prefix]


class Shard:
    """The inverted files of some vectors."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> None:
        self.vectors, self.norms = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.pivots, self.prefix = pivots, min(prefix, len(pivots))
        if len(pivots):
            order = _nearest(vectors, pivots, self.prefix)
            by_pivot = np.argsort(order.ravel(), kind="stable")
            rows, places = np.divmod(by_pivot, self.prefix)
            cuts = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))
            self.files = [(rows[a:b], (self.prefix - places[a:b]).astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def candidates(self, order: np.ndarray, n: int) -> np.ndarray:
        """The n vectors whose orders are nearest by footrule. Two prefixes differ by what all
        differ by, less twice the smaller closeness for each pivot that both hold."""
        saved = np.zeros(len(self.vectors), np.int32)
        for place, pivot in enumerate(order.tolist()):
            rows, close = self.files[pivot]
            saved[rows] += np.minimum(close, self.prefix - place)
        return np.argpartition(-saved, n - 1)[:n]

    def search(self, queries: np.ndarray, k: int, rerank: float):
        """For each query the places and scores of candidates that may be in its best k."""
        n = max(min(len(self.vectors), 16 * k), int(np.ceil(rerank * len(self.vectors))))
        orders = _nearest(queries, self.pivots, self.prefix) if len(self.pivots) and n < len(self.vectors) else None
        for i, query in enumerate(queries):
            at = np.arange(len(self.vectors)) if orders is None else self.candidates(orders[i], n)
            score = (self.vectors[at] * query).sum(axis=1) / (self.norms[at] * np.sqrt((query * query).sum()))
            if len(at) > k + 1:
                best = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                at, score = at[best], score[best]
            yield at, score


def _searched(pivots: dict[int, np.ndarray], k: int, prefix: int, rerank: float):
    """Rows sorted by shard (dim, shard), vectors before queries, to each shard's best of each query."""

    def found(shard: Shard, ids: list[list[int]], asked: list[dict]):
        for r, (at, score) in zip(asked, shard.search(np.array([r["embedding"] for r in asked]), k, rerank), strict=True):
            best = sorted((-s, v) for a, s in zip(at.tolist(), score.tolist(), strict=True) for v in ids[a] if v != r["query_id"])
            yield from ((r["query_id"], v, -s) for s, v in best[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, shard = None, [], [], None
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            out, asked = [], []
            for r in batch.to_pylist():
                if (r["dim"], r["shard"]) != at:
                    if shard and asked:
                        out += found(shard, ids, asked)
                    at, ids, vectors, shard, asked = (r["dim"], r["shard"]), [], [], None, []
                if r["query_id"] is None:
                    ids.append(r["vec_ids"])
                    vectors.append(np.array(r["embedding"]))
                elif vectors:
                    if not shard:
                        shard = Shard(np.stack(vectors), pivots.get(r["dim"], np.zeros((0, r["dim"]))), prefix)
                    asked.append(r)
            if shard and asked:
                out += found(shard, ids, asked)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k vectors of largest cosine
    among those with another vec_id. Both tables have vec_id and embedding."""
    fine = usable(vectors)
    index = cut(unique(fine, k + 1))
    asked = cut(usable(queries).select(F.col("vec_id").alias("query_id"), "embedding"))
    shards = max(1, -(-index.count() // shard_rows))
    first = Window.partitionBy(F.size("embedding")).orderBy("_h", "vec_ids")
    sample = index.withColumn("_h", F.xxhash64("vec_ids")).orderBy("_h", "vec_ids").limit(4 * pivots).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= pivots)
    chosen: dict[int, list] = {}
    for r in sample.orderBy("_n").select("embedding").collect():  # at most 4 x pivots rows
        chosen.setdefault(len(r.embedding), []).append(np.array(r.embedding) / np.linalg.norm(r.embedding))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = index.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_ids"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("query_id"), "vec_ids", "embedding")
    right = asked.select(F.size("embedding").alias("dim"), everywhere.alias("shard"), "query_id", F.lit(None).cast("array<long>").alias("vec_ids"), "embedding")
    run = _searched({d: np.stack(x) for d, x in chosen.items()}, k, prefix, rerank)
    dealt = left.union(right).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("query_id").isNotNull())
    found = dealt.mapInArrow(run, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
