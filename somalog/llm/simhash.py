"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within `distance` bits of each other are linked and the links' connected
components are the groups of near copies. The index works on distinct fingerprints:

* A fingerprint's bits are cut into distance + 2 segments. Two that differ in at most
  `distance` bits agree in two whole segments at least, so for every pair of segments there is
  one order of the bits that starts with it, and linked fingerprints share the leading bits
  in some order.
* In each order fingerprints are sorted by Gray rank. The rank's leading bits depend on the
  fingerprint's leading bits alone, so every upper node (a shared leading pattern) is one
  contiguous run of the sort, and nodes are dealt to tasks whole.
* Inside a node that still has many members a tree is built over the sorted run. Each of its
  nodes keeps the bits all its members share (mask and pattern). Two nodes whose shared bits
  already differ in more than `distance` places are dropped as a whole, and so are two nodes
  that are known to be in one component. What is left is compared bit by bit.

A task emits a spanning forest of the links it finds, not the links: a group of n near copies
gives fewer than n rows in each order, and components are the same.

Defined results: null and empty texts have fingerprint 0, and link as any other; equal texts
share a fingerprint; a null doc_id links as any other row and gets its group's component, but
never names one (null, if no member has a doc_id); repeated rows stay; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.llm.common import cut
from somalog.llm.components import components

BITS = 64
LEAF, FAN, SMALL, CHUNK = 64, 8, 64, 2048


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The SimHash of a text's word shingles, A-Z lower-cased; without words 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        to = min(n, at + (1 << 16))
        last = ends[at + shingle - 1 : to + shingle - 1] - 1 if len(words) >= shingle else ends[-1:] - 1
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:to].tolist(), last.tolist(), strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return docs.select("doc_id", _fingerprints(F.col("text").cast("binary")).alias("fp"))


def _orders(distance: int) -> list[list[tuple[int, int]]]:
    """Orders of the bits as (lowest bit, width) pieces, leading piece first."""
    n = distance + 2
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    pieces = [(sum(widths[:i]), w) for i, w in enumerate(widths)]
    return [[pieces[i], pieces[j], *(p for k, p in enumerate(pieces) if k not in (i, j))] for i, j in combinations(range(n), 2)]


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Places in the Gray sequence; leading bits depend on leading bits alone."""
    for step in (1, 2, 4, 8, 16, 32):
        words = words ^ (words >> np.uint64(step))
    return words


def _posted(distance: int):
    """Rows (fp, rep) to one row an order, with the upper node and the rank inside it."""
    orders = _orders(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, order in enumerate(orders):
                word, free = np.zeros_like(fp), BITS
                for low, width in order:
                    free -= width
                    word |= (fp >> np.uint64(low) & np.uint64((1 << width) - 1)) << np.uint64(free)
                rank, head = gray_rank(word), sum(w for _, w in order[:2])
                node, inside = rank >> np.uint64(BITS - head), rank & np.uint64((1 << BITS - head) - 1)
                columns = (np.full(len(fp), k, np.int32), node.view(np.int64), inside.view(np.int64))
                yield pa.record_batch([*map(pa.array, columns), batch.column("fp"), batch.column("rep")], names=["order", "node", "rank", "fp", "rep"])

    return run


class _Forest:
    """Union-find over positions 0..n-1; keeps the pairs that joined two components."""

    def __init__(self, n: int) -> None:
        self.parent, self.kept = list(range(n)), []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        before = len(self.kept)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.kept.append((x, y))
        return len(self.kept) > before

    def labels(self) -> np.ndarray:
        label = np.array(self.parent)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        return label


def _differ(x: np.ndarray) -> np.ndarray:
    """How many bits each fingerprint of x has set; its last axis holds a fingerprint's words."""
    return np.bitwise_count(x[..., 0]) if x.shape[-1] == 1 else np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _tree(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Levels from the leaves up: shared mask, shared pattern, and members a node."""
    levels, ones, none, span = [], words, words, 1
    while not levels or len(ones) > FAN:
        fan = FAN if levels else LEAF
        cuts = np.arange(0, len(ones), fan)
        ones, none, span = np.bitwise_and.reduceat(ones, cuts, axis=0), np.bitwise_or.reduceat(none, cuts, axis=0), span * fan
        levels.append((ones | ~none, ones, span))
    return levels


def linked(words: np.ndarray, distance: int, forest: _Forest | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links among words sorted by Gray rank.
    A forest that is given grows by them."""
    words = words.reshape(len(words), -1)
    n, forest = len(words), forest or _Forest(len(words))
    for gap in range(1, min(8, n - 1) + 1):  # neighbours in Gray order differ least
        near = np.nonzero(_differ(words[gap:] ^ words[:-gap]) <= distance)[0]
        forest.link(near, near + gap)
    levels = _tree(words)
    label = forest.labels()

    def same(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cuts = np.arange(0, n, levels[level][2])
        low, high = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    todo = [(top, a, b)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > CHUNK:
            todo += [(level, a[CHUNK:], b[CHUNK:])]
            a, b = a[:CHUNK], b[:CHUNK]
        mask, pattern, span = levels[level]
        open_ = (_differ((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance) & ~same(level, a, b)
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        if level:
            children = len(levels[level - 1][0])
            i, j = np.divmod(np.arange(FAN * FAN), FAN)
            x, y = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
            fits = (x <= y) & (y < children)
            todo.append((level - 1, x[fits], y[fits]))
            continue
        found = False
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            left, right = words[x * span : (x + 1) * span], words[y * span : (y + 1) * span]
            i, j = np.nonzero(_differ(left[:, None] ^ right[None, :]) <= distance)
            found |= forest.link(i + x * span, j + y * span)
            if found and k % 32 == 31 and k + 1 < len(a):  # what is joined by now needs no more comparing
                label = forest.labels()
                todo.append((0, a[k + 1 :], b[k + 1 :]))
                break
        if found:
            label = forest.labels()
    return forest.kept


def _links_of(order: np.ndarray, node: np.ndarray, words: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links inside the nodes of a sorted stretch, as pairs of positions."""
    n = len(words)
    heads = np.concatenate(([0], np.nonzero((order[1:] != order[:-1]) | (node[1:] != node[:-1]))[0] + 1))
    sizes = np.diff(np.append(heads, n))
    end = np.repeat(heads + sizes, sizes)
    out: list[tuple[int, int]] = []
    small = np.nonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))[0]
    forest = None
    for gap in range(1, min(SMALL, int(sizes.max(initial=1)))):
        small = small[small + gap < end[small]]
        if not len(small):
            break
        near = small[np.bitwise_count(words[small] ^ words[small + gap]) <= distance]
        if len(near):
            forest = forest or _Forest(n)
            forest.link(near, near + gap)
    out += forest.kept if forest else []
    for k in np.nonzero(sizes > SMALL)[0].tolist():
        at = int(heads[k])
        out += [(x + at, y + at) for x, y in linked(words[at : at + int(sizes[k])], distance)]
    return out


def _index_pass(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def done(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            order, node, words, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
            pairs = np.array(_links_of(order, node, words.view(np.uint64), distance), dtype=np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.record_batch([pa.array(rep[pairs[:, 0]]), pa.array(rep[pairs[:, 1]])], schema=schema)

        for batch in batches:  # sorted by order, node and rank; a node may reach into the next batch
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("order", "node", "fp", "rep"))
            if not len(now[0]):
                continue
            split = np.nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[0]
            last = int(split[-1]) + 1 if len(split) else 0
            if last or (held and (held[-1][0][-1] != now[0][0] or held[-1][1][-1] != now[1][0])):
                if last:
                    yield from done([*held, tuple(x[:last] for x in now)])
                else:
                    yield from done(held)
                held = []
            held.append(tuple(x[last:] for x in now))
        if held:
            yield from done(held)

    return run


def _links(nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, rep), distinct fingerprints, to links (a, b) between their reps."""
    index = (
        nodes.mapInArrow(_posted(distance), "order int, node long, rank long, fp long, rep long")
        .repartition("order", "node")
        .sortWithinPartitions("order", "node", "rank")
    )
    return index.select("order", "node", "fp", "rep").mapInArrow(_index_pass(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint as 16 hex digits, and the smallest
    doc_id that a chain of links of at most `distance` differing bits reaches."""
    prints = cut(with_fingerprint(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(_links(distinct.select("fp", F.col("fp").alias("rep")), distance))
    least = joined.join(distinct, joined["node"] == distinct["fp"]).groupBy("component").agg(F.min("rep").alias("least"))
    named = joined.join(least, "component").select(F.col("node").alias("fp"), "least")
    groups = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return prints.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
