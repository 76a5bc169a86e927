"""Substring dedup over the De Bruijn graph of the corpus's words.

A window of `width` words is an edge of the graph (from its first to its last width - 1 words).
An edge that occurs more than once marks repeated text, and all its occurrences but the first
are to go. Edges are far more than documents, so they are kept compact all the way:

* Every edge is dealt by its minimizer, the least hash of the short k-mers in it. Consecutive
  edges mostly share it, so a path's edges travel as one run: one document, one start, and
  the edges' hashes. Equal edges have equal minimizers and always meet in one bucket.
* Before that, each chunk of documents settles what repeats inside it. However often a passage
  occurs, a bucket gets it once from a chunk, so no bucket fills up with one hot passage.
* Windows around a hot phrase, or over the edge of a hot passage, share a minimizer but differ.
  Minimizers are counted on a sample first, and edges of hot ones are dealt by minimizer and
  window, each edge by itself. Equal edges still meet; only where they meet depends on the sample.
* A bucket compares the edges that meet in it and emits repeated ones as paths: consecutive
  edges of one document whose earlier occurrences are consecutive in one source document,
  with the source's coordinates. A path ends where the graph branches.
* Paths of all buckets and chunks that go on where another one ends, in the document and in the
  source, are compacted to spans: one for each stretch of a diagonal of the two.
* Each span is verified: documents are joined to the stretches that are asked of them, as copy or
  as source, each stretch is digested (SHA-256 of its words), and a span stands if both digests
  are equal. Of one that does not stand each window is verified by itself. Only verified windows
  are removed, so no hash decides that a word goes.
* Verified spans are joined to their documents, and the words they cover leave.

Edges meet if 112 bits of two hashes agree (64 of the minimizer, 48 of the window). Should windows
of different words ever agree in these, the later one stays, even if it has yet another source.

Defined results: null and empty texts have no words; occurrences are ordered by doc_id (null
last, those by a hash of the text), then by start; rows that share a doc_id share its coordinates,
as do equal texts without one, so a repeated row does not repeat itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somalog.llm.common import cut

WIDTH, MER = 20, 5
CHUNK_WORDS = 1_500_000
#: Edges from which a minimizer is hot, one document in so many is counted for that, and the
#: least edges of a minimizer in a chunk that count.
HOT, SAMPLE, COUNTED = 200_000, 8, 3
NONE = np.empty(0, np.uint64)
#: About so many edges meet in a bucket.
BUCKET_EDGES = 500_000
_BASE = 0x9E3779B97F4A7C15
_LOW48 = np.uint64((1 << 48) - 1)
LAST = (1 << 63) - 1
SPANS = "doc long, uid long, start int, n int, source long, source_uid long, source_start int"
_PATH = ("doc", "uid", "start", "n", "source", "source_uid", "source_start")


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; element i is that of the run from i on."""
    done, out, power, block, step = 0, None, 1, words, 1
    while True:
        if width & step:
            out = block if out is None else out[: len(block) - done] + np.uint64(pow(_BASE, done, 1 << 64)) * block[done:] if done < len(block) else block[:0]
            done += step
        if done == width or len(block) <= step:
            break
        power = np.uint64(pow(_BASE, step, 1 << 64))
        block, step = block[:-step] + power * block[step:], step * 2
    n = len(words) - width + 1
    return _mixed(out[:n]) if n > 0 and done == width else words[:0]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` elements."""
    step = 1
    while step * 2 <= width:
        x, step = np.minimum(x[:-step], x[step:]), step * 2
    return x if step == width else np.minimum(x[: len(x) - (width - step)], x[width - step :])


def earlier(key: np.ndarray, check: np.ndarray, doc: np.ndarray, uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the edges that also occur at a smaller (doc, start), and of those first
    occurrences. Edges are equal if key and check are. Without doc_id, texts are told apart by uid."""
    uid = np.where(doc == LAST, uid, 0)
    order = np.argsort(key)
    ranked = key[order]
    equal = ranked[1:] == ranked[:-1]
    pick = order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))] if len(key) > 1 else order[:0]
    if not len(pick):
        return pick, pick
    pick = pick[np.lexsort((start[pick], uid[pick], doc[pick], check[pick], key[pick]))]
    new = np.concatenate(([True], (key[pick[1:]] != key[pick[:-1]]) | (check[pick[1:]] != check[pick[:-1]])))
    lead = pick[np.nonzero(new)[0][np.cumsum(new) - 1]]
    later = (doc[pick] != doc[lead]) | (uid[pick] != uid[lead]) | (start[pick] != start[lead])
    return pick[later], lead[later]


def _paths(at: np.ndarray, lead: np.ndarray, doc: np.ndarray, uid: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Repeated edges as paths with their source's coordinates."""
    order = np.lexsort((start[at], uid[at], doc[at]))
    at, lead = at[order], lead[order]
    d, u, s, sd, su, ss = doc[at], uid[at], start[at], doc[lead], uid[lead], start[lead]
    new = np.ones(len(at), bool)
    new[1:] = (d[1:] != d[:-1]) | (u[1:] != u[:-1]) | (s[1:] != s[:-1] + 1) | (sd[1:] != sd[:-1]) | (su[1:] != su[:-1]) | (ss[1:] != ss[:-1] + 1)
    head = np.nonzero(new)[0]
    return pd.DataFrame({"doc": d[head], "uid": u[head], "start": s[head].astype(np.int32), "n": np.diff(np.append(head, len(at))).astype(np.int32), "source": sd[head], "source_uid": su[head], "source_start": ss[head].astype(np.int32)})


class _Chunk:
    """Some documents' edges, in flat arrays."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray]], width: int, mer: int) -> None:
        docs.sort(key=lambda x: x[:2])
        sizes = np.array([len(w) for _, _, w in docs])
        words = np.concatenate([w for _, _, w in docs])
        hashes, least = rolling(words, width), _least(rolling(words, mer), width - mer + 1)
        within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.nonzero((within + width <= np.repeat(sizes, sizes))[: len(hashes)])[0]
        self.key, self.least, self.start = hashes[whole], least[whole], within[whole]
        self.index = np.repeat(np.arange(len(docs)), sizes)[whole]
        self.ids, self.uids = (np.array([x[k] for x in docs], np.int64) for k in (0, 1))

    def settle(self) -> pd.DataFrame:
        """Paths that repeat inside the chunk; their edges leave it."""
        doc, uid = self.ids[self.index], self.uids[self.index]
        at, lead = earlier(self.key, self.least, doc, uid, self.start)
        out = _paths(at, lead, doc, uid, self.start)
        keep = np.ones(len(self.key), bool)
        keep[at] = False
        self.key, self.least, self.start, self.index = (x[keep] for x in (self.key, self.least, self.start, self.index))
        return out

    def packed(self, buckets: int, hot: np.ndarray = NONE) -> Iterator[tuple[int, bytes]]:
        """The edges by bucket, in runs of one document that share a minimizer; hot ones alone."""
        if not len(self.key):
            return
        alone = np.isin(self.least, hot)
        new = np.ones(len(self.key), bool)
        new[1:] = (self.index[1:] != self.index[:-1]) | (self.start[1:] != self.start[:-1] + 1) | (self.least[1:] != self.least[:-1]) | alone[1:]
        head = np.nonzero(new)[0]
        size = np.diff(np.append(head, len(new)))
        dealt = np.where(alone[head], self.least[head] ^ _mixed(self.key[head]), self.least[head])
        bucket = (_mixed(dealt) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.nonzero(np.diff(bucket[order]))[0] + 1
        for runs in np.split(order, cuts):
            n = size[runs]
            spot = np.repeat(head[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            local, index = np.unique(self.index[head[runs]], return_inverse=True)
            key = self.key[spot]
            parts = (self.ids[local], self.uids[local], self.least[head[runs]], index.astype(np.uint32), self.start[head[runs]].astype(np.uint32), n.astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.uint16))
            yield int(bucket[runs[0]]), np.array([len(local), len(runs), len(spot)], np.int64).tobytes() + b"".join(x.tobytes() for x in parts)


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    docs, runs, edges = np.frombuffer(blob, np.int64, 3)
    at, out = 24, []
    for kind, n in ((np.int64, docs), (np.int64, docs), (np.uint64, runs), (np.uint32, runs), (np.uint32, runs), (np.uint32, runs), (np.uint32, edges), (np.uint16, edges)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    ids, uids, least, index, start, size, low, high = out
    size = size.astype(np.int64)
    key = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    inside = np.arange(int(edges)) - np.repeat(np.cumsum(size) - size, size)
    return key, np.repeat(least, size), np.repeat(ids[index], size), np.repeat(uids[index], size), np.repeat(start.astype(np.int64), size) + inside


_EDGES = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("source_uid", pa.int64()), ("source_start", pa.int32())])


def _chunks(batches: Iterator[pa.RecordBatch], width: int, mer: int, chunk_words: int) -> Iterator[_Chunk]:
    held, n = [], 0
    for batch in batches:
        ids, uids, texts = (batch.column(c) for c in ("doc", "uid", "text"))
        for k in range(batch.num_rows):
            words = texts[k].as_py().split()
            if len(words) < width:
                continue
            held.append((ids[k].as_py(), uids[k].as_py(), np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))))
            n += len(words)
            if n >= chunk_words:
                yield _Chunk(held, width, mer)
                held, n = [], 0
    if held:
        yield _Chunk(held, width, mer)


def _edges(buckets: int, width: int, mer: int, chunk_words: int, hot: np.ndarray):
    """Rows with a bucket and its packed edges, and rows with a path settled in its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, width, mer, chunk_words):
            paths = chunk.settle()
            if len(paths):  # they ride along, in buckets of their documents
                bucket = pa.array((_mixed(paths["uid"].to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int32))
                yield pa.record_batch([bucket, pa.nulls(len(paths), pa.binary()), *(pa.array(paths[c]) for c in _PATH)], schema=_EDGES)
            for bucket, blob in chunk.packed(buckets, hot):
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), *(pa.array([0], _EDGES.field(k).type) for k in range(2, 9))], schema=_EDGES)

    return run


def _counts(width: int, mer: int, chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, width, mer, chunk_words):
            chunk.settle()
            least, n = np.unique(chunk.least, return_counts=True)
            often = n >= COUNTED
            yield pa.record_batch([pa.array([None, *least[often].view(np.int64).tolist()], pa.int64()), pa.array([len(chunk.least), *n[often].tolist()], pa.int64())], names=["least", "n"])

    return run


def hot_minimizers(keyed: DataFrame, width: int, mer: int, chunk_words: int, hot: int) -> tuple[np.ndarray, int]:
    """Minimizers of about `hot` edges or more, counted on one document in SAMPLE, and about how
    many edges there are; the minimizers are fewer than edges / hot."""
    sample = keyed.where(F.pmod("uid", F.lit(SAMPLE)) == 0)
    counted = sample.mapInArrow(_counts(width, mer, chunk_words), "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("least").isNull() | (F.col("n") * SAMPLE >= hot)).collect()
    return np.array([r.least for r in rows if r.least is not None], np.int64).view(np.uint64), sum(r.n * SAMPLE for r in rows if r.least is None)


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    edges = rows["blob"].notna()
    settled = rows.loc[~edges, list(_PATH)]
    if not edges.any():
        return settled
    key, least, doc, uid, start = (np.concatenate(x) for x in zip(*map(_unpacked, rows.loc[edges, "blob"]), strict=True))
    at, lead = earlier(_mixed(key ^ least), least, doc, uid, start)
    return pd.concat([settled.astype(np.int64), _paths(at, lead, doc, uid, start)])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long").alias("doc"), F.xxhash64(text).alias("uid"), text.cast("binary").alias("text"))


def repeated_paths(docs: DataFrame, width: int = WIDTH, mer: int = MER, chunk_words: int = CHUNK_WORDS, hot: int = HOT) -> DataFrame:
    """(doc, uid, start, n, source, source_uid, source_start): n consecutive windows of a document,
    from word `start` on, that stand earlier in `source` from word `source_start` on."""
    keyed = _keyed(docs).drop("doc_id")
    often, n = hot_minimizers(keyed, width, mer, chunk_words, hot)
    buckets = max(8, -(-n // BUCKET_EDGES))
    edges = keyed.mapInArrow(_edges(buckets, width, mer, chunk_words, often), "bucket int, blob binary, " + SPANS)
    return edges.groupBy("bucket").applyInPandas(_meet, SPANS)


def compacted(paths: DataFrame) -> DataFrame:
    """Paths to spans: paths that go on where the one before ends, in both documents, as one."""
    diagonal = Window.partitionBy("doc", "uid", "source", "source_uid", F.col("start") - F.col("source_start")).orderBy("start")
    end = F.lag(F.col("start") + F.col("n")).over(diagonal)
    numbered = paths.withColumn("_new", F.coalesce((end < F.col("start")).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(diagonal))
    key = ["doc", "uid", "source", "source_uid", (F.col("start") - F.col("source_start")).alias("_diagonal"), "_island"]
    last = (F.max(F.col("start") + F.col("n")) - F.min("start")).cast("int")
    return numbered.groupBy(*key).agg(F.min("start").alias("start"), last.alias("n"), F.min("source_start").alias("source_start")).select(*_PATH)


def _digests(width: int):
    schema = pa.schema([("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, uid, text, asked in zip(batch.column("doc").to_pylist(), batch.column("uid").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                words = text.split()
                rows += [(doc, uid, x["start"], x["n"], hashlib.sha256(b" ".join(words[x["start"] : x["start"] + x["n"] + width - 1])).digest()) for x in asked]
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _stretches(keyed: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(doc, uid, start, n, digest) of the stretches that spans are and that they come from."""
    copies = spans.select("doc", "uid", "start", "n")
    sources = spans.select(F.col("source").alias("doc"), F.col("source_uid").alias("uid"), F.col("source_start").alias("start"), "n")
    asked = copies.union(sources).distinct().groupBy("doc", "uid").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    found = keyed.join(asked.hint("shuffle_hash"), ["doc", "uid"]).select("doc_id", "doc", "uid", "text", "asked")
    return found.mapInArrow(_digests(width), "doc long, uid long, start int, n int, digest binary").distinct()


def _compared(keyed: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """spans and equal, whether the words of a span are its source's."""
    digests = _stretches(keyed, spans, width)
    source = digests.select(F.col("doc").alias("source"), F.col("uid").alias("source_uid"), F.col("start").alias("source_start"), "n", F.col("digest").alias("_source"))
    both = spans.join(digests, ["doc", "uid", "start", "n"]).join(source, ["source", "source_uid", "source_start", "n"])
    return both.select(*_PATH, (F.col("digest") == F.col("_source")).alias("equal"))


def verified(keyed: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """The spans (doc, uid, start, n) whose words are their source's, and of others the windows
    for which this holds."""
    compared = _compared(keyed, spans, width)
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    windows = compared.where("NOT equal AND n > 1").select("*", at.alias("_at"))
    moved = windows.select("doc", "uid", (F.col("start") + F.col("_at")).alias("start"), F.lit(1).alias("n"), "source", "source_uid", (F.col("source_start") + F.col("_at")).alias("source_start"))
    return compared.where("equal").union(_compared(keyed, moved, width).where("equal")).select("doc", "uid", "start", "n")


def _kept(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, paths in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("paths"), strict=True):
                words = text.split()
                total = len(words)
                if paths.is_valid:
                    edge = np.zeros(total + 1, np.int64)
                    spans = paths.values
                    start, n = spans.field("start").to_numpy(), spans.field("n").to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, np.minimum(start + n + width - 1, total), -1)
                    words = [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not inside]
                kept = b" ".join(words)
                rows.append((doc_id, total, total - len(words), hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def dedup(docs: DataFrame, width: int = WIDTH, mer: int = MER, chunk_words: int = CHUNK_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): a document's words without those that a
    window of `width` words covers that stands earlier in the corpus."""
    spans = cut(compacted(repeated_paths(docs, width, mer, chunk_words, hot)))
    keyed = _keyed(docs)
    paths = verified(keyed, spans, width).groupBy("doc", "uid").agg(F.collect_list(F.struct("start", "n")).alias("paths"))
    glued = keyed.join(paths.hint("shuffle_hash"), ["doc", "uid"], "left").select("doc_id", "text", "paths")
    return glued.mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
