"""Hard negatives by exact integer scores, with the Four-Russians method.

Components are quantized to integers. A candidate's are cut into bit planes (two's complement),
and each plane's bits are packed into bytes, one for eight dimensions. For an anchor and each group
of eight dimensions a table holds the sums of all 256 subsets of the anchor's components there. A
candidate's byte looks up what its plane adds in the group, so a score is as many look-ups as
candidates have bytes, joined by shifts and adds from the top plane down: exact, whatever the
numbers are, and without a multiplication.

Candidates are dealt once, by hash of vec_id, to shards of `shard_rows`; they are never copied. The
anchors, a stated small share of all rows, are sent to every shard and stream past its packed
planes in blocks of `block_rows`, so a task holds one shard and one block. A first pass gives every
anchor's best rows of its label; a second, which knows their scores, gives for every anchor and
positive the best rows of other labels inside the margin. A shard sends `k` rows for each, and a
window per anchor (and positive) ranks those.

Defined results: rows with a null label, null vector, or null or non-finite components take no
part, nor do rows without vec_id, empty vectors or those of another length than the anchor's;
repeated rows of a vec_id are one, and of different rows under one vec_id the least by label, then
component by component, counts; equal scores go by vec_id; an anchor without positives, and a
positive without negatives inside the margin, have no rows; empty tables give an empty result;
other columns are ignored. Scores that might not fit a long raise an error, they are never rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from somalog.llm.common import cut

SHARD_ROWS, BLOCK_ROWS = 65_536, 64
POSITIVES = NEGATIVES = 5
#: A negative's score is from LEAST % to MOST % of its positive's.
LEAST, MOST = 80, 100
GROUP = 8
TILE = 8192
_LONG = (1 << 63) - 1


def quantized(vectors: DataFrame, label: Column, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, x array<long>) of the rows that take part, one a vec_id: floor(scale * x).
    label is a column of whole numbers."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").where(fine)
    scaled = F.transform("embedding", lambda x: F.floor(x * F.lit(scale)))
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x * F.lit(scale))))
    whole = F.when(largest < F.lit(2.0**62), scaled).otherwise(F.raise_error(F.lit("a component is too large for exact integer scores")))
    one = rows.select("vec_id", F.struct("label", whole.alias("x")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", "row.x")


def planes(x: np.ndarray) -> np.ndarray:
    """Rows of integers as bit planes, the sign's first: (planes, groups of eight, rows) bytes."""
    n = max(int(x.max(initial=0)).bit_length(), int(-(x.min(initial=0) + 1)).bit_length() if (x < 0).any() else 0) + 1
    return np.stack([np.packbits((x >> k & 1).astype(np.uint8), axis=1).T for k in range(n - 1, -1, -1)])


def subset_sums(x: np.ndarray) -> np.ndarray:
    """Of rows of integers, for each group of eight dimensions and byte, the sum of the components
    whose bit is set: (groups, 256, rows). The byte's top bit is the group's first dimension."""
    rows, dim = x.shape
    groups = -(-dim // GROUP)
    padded = np.zeros((rows, groups * GROUP), np.int64)
    padded[:, :dim] = x
    parts = padded.reshape(rows, groups, GROUP).transpose(1, 2, 0)
    table = np.zeros((groups, 1, rows), np.int64)
    for k in range(GROUP - 1, -1, -1):  # lowest bit first: each bit doubles the table
        table = np.concatenate([table, table + parts[:, k, None]], axis=1)
    return table


def scores(bits: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Exact inner products, (candidates, anchors), from planes() and subset_sums()."""
    out = np.zeros((bits.shape[2], tables.shape[2]), np.int64)
    for k, plane in enumerate(bits):
        out <<= 1
        for group, byte in enumerate(plane):
            if k:
                out += tables[group][byte]
            else:  # the sign's plane counts negative
                out -= tables[group][byte]
    return out


def _fits(x: np.ndarray, other: np.ndarray) -> None:
    """Raise unless 100 times each score of these fits a long, and all sums on the way to it."""
    top = lambda v: max(int(v.max(initial=0)), -int(v.min(initial=0)))
    if 4 * MOST * x.shape[1] * max(1, top(x)) * max(1, top(other)) > _LONG:
        raise OverflowError("components are too large for exact integer scores in a long")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by id."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.nonzero(score >= np.partition(score, len(score) - k)[len(score) - k])[0]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


class _Shard:
    """The candidates of a shard by vector length, as bit planes."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts)
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        x = table.column("x").combine_chunks()
        lengths = np.diff(x.offsets.to_numpy())
        values, starts = x.values.to_numpy(), x.offsets.to_numpy()[:-1]
        self.by = {}
        for dim in np.unique(lengths).tolist():
            at = np.nonzero(lengths == dim)[0]
            own = values[starts[at][:, None] + np.arange(dim)]
            self.by[dim] = ids[at], labels[at], own, planes(own)

    def score(self, anchors: np.ndarray):
        """(ids, labels, scores) of tiles of candidates against anchors of one length."""
        if anchors.shape[1] in self.by:
            ids, labels, own, bits = self.by[anchors.shape[1]]
            _fits(own, anchors)
            tables = subset_sums(anchors)
            for at in range(0, len(ids), TILE):
                yield ids[at : at + TILE], labels[at : at + TILE], scores(bits[:, :, at : at + TILE], tables)


def _blocks(batch: pa.RecordBatch, block_rows: int) -> Iterator[list[dict]]:
    """Anchors of one length, a few at a time."""
    for at in range(0, batch.num_rows, block_rows):
        rows = batch.slice(at, block_rows).to_pylist()
        for dim in {len(r["x"]) for r in rows}:
            yield [r for r in rows if len(r["x"]) == dim]


def _kept(found: dict, key, ids: np.ndarray, score: np.ndarray, k: int) -> None:
    """Add the best of a tile to the best of the tiles before it."""
    at = _best(score, ids, k)
    if len(at):
        found[key] = sorted([*found.get(key, ()), *zip((-score[at]).tolist(), ids[at].tolist(), strict=True)])[:k]


def _positives(shard: _Shard, rows: list[dict], k: int) -> Iterator[tuple]:
    found: dict = {}
    for ids, labels, score in shard.score(np.array([r["x"] for r in rows], np.int64)):
        for j, r in enumerate(rows):
            at = np.nonzero((labels == r["label"]) & (ids != r["vec_id"]))[0]
            _kept(found, j, ids[at], score[at, j], k)
    for j, best in found.items():
        for s, v in best:
            yield rows[j]["vec_id"], rows[j]["vec_id"], 0, v, -s


def _negatives(shard: _Shard, rows: list[dict], k: int) -> Iterator[tuple]:
    found: dict = {}
    for ids, labels, score in shard.score(np.array([r["x"] for r in rows], np.int64)):
        for j, r in enumerate(rows):
            other = np.nonzero(labels != r["label"])[0]
            theirs = score[other, j]
            for p in r["positives"]:
                at = np.nonzero((100 * theirs >= LEAST * p["score"]) & (100 * theirs <= MOST * p["score"]))[0]
                _kept(found, (j, p["vec_id"], p["score"]), ids[other[at]], theirs[at], k)
    for (j, positive, their), best in found.items():
        for s, v in best:
            yield rows[j]["vec_id"], positive, their, v, -s


_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _streamed(of, k: int, block_rows: int):
    """Rows sorted by shard, candidates before anchors, to what `of` finds in each shard."""
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for batch in batches:
            key = batch.column("shard").to_numpy(zero_copy_only=False) * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                now, asks = divmod(int(key[a]), 2)
                if now != at:
                    at, parts, shard = now, [], None
                if not asks:
                    parts.append(batch.slice(a, b - a))
                    continue
                shard = shard or _Shard(parts)
                parts = []
                for rows in _blocks(batch.slice(a, b - a), block_rows):
                    if out := list(of(shard, rows, k)):
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def _searched(candidates: DataFrame, anchors: DataFrame, shards: int, of, k: int, block_rows: int) -> DataFrame:
    """candidates (shard, vec_id, label, x) and anchors (vec_id, label, x, positives) to _FOUND."""
    kind = "array<struct<vec_id: bigint, score: bigint>>"
    left = candidates.select("shard", F.lit(0).alias("asks"), "vec_id", "label", "x", F.lit(None).cast(kind).alias("positives"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    right = anchors.select(everywhere.alias("shard"), F.lit(1).alias("asks"), "vec_id", "label", "x", F.col("positives").cast(kind).alias("positives"))
    dealt = left.union(right).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInArrow(_streamed(of, k, block_rows), _FOUND)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors
    among rows; both are quantized() rows."""
    placed = cut(rows.select(*(F.col(c).cast("long").alias(c) for c in ("vec_id", "label")), "x"))
    shards = max(1, -(-placed.count() // shard_rows))
    candidates = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = placed.join(anchors.select("vec_id"), "vec_id", "left_semi")
    none = asked.withColumn("positives", F.array())
    near = _ranked(_searched(candidates, none, shards, _positives, positives, block_rows), ["anchor_id"], positives)
    listed = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))  # `positives` at most
    known = cut(asked.join(listed, "vec_id").select("vec_id", "label", "x", "positives"))
    found = _ranked(_searched(candidates, known, shards, _negatives, negatives, block_rows), ["anchor_id", "positive_id"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
    FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.x) = len(c.x)),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""
