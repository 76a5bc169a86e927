"""Near copies by the similarity of word shingles, found with the Gray-order SimHash index.

Two texts are near copies if the Jaccard similarity of their sets of shingles (five words, A-Z
lower-cased) is `similarity` or more. It goes in steps:

* Texts with equal sets are one, so exact copies need no comparing however many there are.
* Each set gets a SimHash of 256 bits. At a similarity s of sets of like size two bits agree with
  probability p = 1 - arccos(2s / (1 + s)) / pi, so distances gather around 256 (1 - p).
* Tables of the index each start with some of the bits, chosen at random, and sort the rest by
  Gray rank. Sets whose leading bits agree share an upper node, in which the tree of masked
  patterns prunes (see simhash). The number of leading bits follows the number of sets, so nodes
  keep their size, and the number of tables follows from p, so that a pair at the threshold
  shares a node with probability `recall` if tables were independent (they share the 256 bits, so
  of pairs at the threshold itself some 0.95 do; closer ones nearly always). A node gives a spanning
  forest of its pairs within `SPREAD` standard deviations of the threshold's distance, nearest
  pairs first.
* The exact similarity of the forests' pairs decides. First each set is compared with its
  nearest neighbour, and then all pairs that are left between components. A forest has fewer pairs than members, so a group of n near copies
  costs at most n comparisons a table, not n squared.
* Sets that a forest holds go through the index once more, with their component, size and the
  numbers of their hashes in each of `BINS` bins. Bins that differ by d in all mean d differing
  shingles at least, which rules most pairs below the similarity out exactly. Every near pair of different components that is not
  ruled out is given by the first table it shares a node in, and compared: no set has a cap on
  its partners.

Only pairs that reach the similarity become links. A link is missed only where no table has the
pair in a node, or its fingerprints differ beyond `SPREAD`. Pairs of different components that
neither fingerprints nor bins can tell from near copies are all compared; the more shingles a text
has over `BINS`, the blunter the bins get, and pairs just under the similarity stay in.

Defined results: null and empty texts have no shingles and are one group, of which one row stays; a
text of fewer words than a shingle has its whole sequence as one; a row without doc_id groups as any
other, and stays only if no member of its group has a doc_id; rows of equal doc_id and text are one
document, of which any one row stays, also where other columns differ; different texts under one
doc_id are told apart; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.llm.common import cut
from somalog.llm.components import components
from somalog.llm.simhash import SMALL, _Forest, gray_rank, linked
from somalog.llm.substring import rolling

SHINGLE, SIMILARITY, RECALL, SPREAD = 5, 0.8, 0.99, 2.7
WORDS = 4
BITS = 64 * WORDS
#: A node holds about 1 / 2 ** ROOM of what one bit for each doubling of the sets would leave it.
LEAST_HEAD, ROOM = 14, 3
#: Bins that differ are counted in COARSE sums first, which leave few pairs for the rest.
BINS, COARSE = 512, 64
#: So many texts' sets leave a task at once.
ROWS = 500


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; of fewer words, their whole sequence."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(rolling(hashes, min(shingle, len(words))))


def name(of: np.ndarray) -> int:
    """A set's name, as a signed long: equal for equal sets."""
    return int(np.array([xxhash.xxh3_64_intdigest(of.tobytes())], np.uint64).view(np.int64)[0])


def wide_fingerprint(of: np.ndarray) -> bytes:
    """The SimHash of 256 bits of a set of hashes."""
    counts, n = np.zeros(BITS, np.int64), len(of)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        part = of[at : at + (1 << 14)]
        bits = np.empty((len(part), WORDS), np.uint64)
        for k in range(WORDS):
            x = part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            bits[:, k] = x ^ (x >> np.uint64(31))
        counts += np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def bins(of: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each bin (255 stands for more)."""
    place = (of * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=BINS), 255).astype(np.uint8).tobytes()


_PRINT = T.StructType([T.StructField("set", T.LongType()), T.StructField("fp", T.BinaryType())])


def _prints(shingle: int):
    @F.pandas_udf(_PRINT)
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, shingle) for t in texts]
        return pd.DataFrame({"set": [name(s) for s in sets], "fp": [wide_fingerprint(s) for s in sets]})

    return of


def _sets(shingle: int):
    """Rows (text) to rows (set, bins, items), items being 32 bits of each hash."""

    def run(batches):
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            sets = [shingles(t.as_py(), shingle) for t in batch.column("text")]
            ends = np.cumsum([0, *map(len, sets)])
            items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).astype(np.uint32).view(np.int32)))
            columns = (pa.array([of(x) for x in sets]) for of in (name, bins))
            yield pa.record_batch([*columns, items], names=["set", "bins", "items"])

    return run


def agreement(similarity: float) -> float:
    """The probability that a bit agrees."""
    return 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def reach(similarity: float) -> int:
    """The most differing bits that a pair at the similarity is expected to have."""
    p = agreement(similarity)
    return math.ceil(BITS * (1 - p) + SPREAD * math.sqrt(BITS * p * (1 - p)))


def tables(n_sets: int, similarity: float, recall: float) -> tuple[int, int]:
    """How many leading bits a table has, and how many tables there are."""
    head = min(32, max(LEAST_HEAD, math.ceil(math.log2(max(2, n_sets))) - ROOM))
    return head, math.ceil(math.log(1 - recall) / math.log(1 - agreement(similarity) ** head))


def _bit_orders(n: int) -> np.ndarray:
    """For each table, 64 different bits in an order of their own."""
    rng = np.random.default_rng(64)
    return np.array([rng.permutation(BITS)[:64] for _ in range(n)])


def _ranks(prints: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The Gray rank of each fingerprint (rows of bytes) in a table."""
    packed = np.ascontiguousarray(np.packbits(np.unpackbits(prints, axis=1)[:, order], axis=1))
    return gray_rank(packed.view(">u8").ravel().astype(np.uint64))


def _matrix(column: pa.Array) -> np.ndarray:
    """A binary column of values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _posted(head: int, orders: np.ndarray):
    """Rows with a fingerprint fp to one row a table, with its node."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                prints = _matrix(batch.column("fp"))
                for k, order in enumerate(orders):
                    node = (_ranks(prints, order) >> np.uint64(64 - head)).astype(np.int64) | (k << 32)
                    yield pa.record_batch([pa.array(node), *batch.columns], names=["node", *batch.schema.names])

    return run


def _distance(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)


def _small_pairs(sizes: np.ndarray, end: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Near pairs, and their distances, inside the nodes of up to SMALL members."""
    found, small = [np.zeros((3, 0), np.int64)], np.nonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))[0]
    for gap in range(1, SMALL):
        small = small[small + gap < end[small]]
        if not len(small):
            break
        d = _distance(words, small, small + gap)
        near = d <= most
        found.append(np.stack([small[near], small[near] + gap, d[near]]))
    return np.concatenate(found, axis=1)


def _between(words: np.ndarray, home: np.ndarray, most: int, fits, block: int = 128) -> np.ndarray:
    """Near pairs of different homes that may fit; rows come sorted by home, so that blocks of
    one home are passed over."""
    cuts = np.arange(0, len(words), block)
    ones, none = np.bitwise_and.reduceat(words, cuts, axis=0), np.bitwise_or.reduceat(words, cuts, axis=0)
    first, last, mask = home[cuts], home[np.minimum(cuts + block, len(home)) - 1], ones | ~none
    found = [np.zeros((2, 0), np.int64)]
    for x in range(len(cuts)):
        ys = np.arange(x, len(cuts))
        apart = np.bitwise_count((ones[x] ^ ones[ys]) & mask[x] & mask[ys]).sum(axis=1, dtype=np.int64) <= most
        for y in ys[apart & ~((first[x] == last[ys]) & (first[x] == last[x]))].tolist():
            a, b = slice(x * block, (x + 1) * block), slice(y * block, (y + 1) * block)
            d = np.bitwise_count(words[a, None] ^ words[None, b]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero((d <= most) & (home[a, None] < home[None, b]))
            i, j = i + x * block, j + y * block
            may = fits(i, j)
            found.append(np.stack([i[may], j[may]]))
    return np.concatenate(found, axis=1)


def _may_fit(size: np.ndarray, counts: np.ndarray, similarity: float):
    """Whether sets at positions a and b may have the similarity s: then no more than
    (1 - s) / (1 + s) of both sizes together differ."""
    sums = counts.reshape(len(counts), COARSE, -1).sum(axis=2, dtype=np.int32)

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = (size[a] + size[b]) * (1 - similarity) / (1 + similarity) + 1e-6
        may = np.abs(size[a] - size[b]) <= most
        for held in (sums, counts):
            left = np.nonzero(may)[0]
            for at in range(0, len(left), 1 << 13):
                rows = left[at : at + (1 << 13)]
                apart = np.abs(held[a[rows]].astype(np.int32) - held[b[rows]]).sum(axis=1, dtype=np.int64)
                may[rows] = apart <= most[rows]
        return may

    return fits


def _laid_out(node: np.ndarray, home: np.ndarray, prints: np.ndarray, orders: np.ndarray):
    """Positions sorted by node, home and Gray rank, the nodes' heads, sizes and ends, and words."""
    n = len(node)
    rank = np.zeros(n, np.uint64)
    for k in np.unique(node >> 32).tolist():
        rows = np.nonzero(node >> 32 == k)[0]
        rank[rows] = _ranks(prints[rows], orders[k])
    order = np.lexsort((rank, home, node))
    node = node[order]
    heads = np.concatenate(([0], np.nonzero(node[1:] != node[:-1])[0] + 1))
    sizes = np.diff(np.append(heads, n))
    return order, heads, sizes, np.repeat(heads + sizes, sizes), prints[order].view(np.uint64)


def _forests(orders: np.ndarray, head: int, most: int, node: np.ndarray, home: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions, and their distances: a forest of the near pairs inside each node."""
    order, heads, sizes, end, words = _laid_out(node, home, prints, orders)
    forest = _Forest(len(node))
    a, b, d = _small_pairs(sizes, end, words, most)
    by = np.argsort(d, kind="stable")
    forest.link(a[by], b[by])
    kept = forest.kept
    for k in np.nonzero(sizes > SMALL)[0].tolist():
        at, to = int(heads[k]), int(heads[k] + sizes[k])
        inside = _Forest(to - at)
        for part in (0.25, 0.5, 0.75, 1.0):  # nearest pairs first
            linked(words[at:to], int(most * part), inside)
        kept = kept + [(x + at, y + at) for x, y in inside.kept]
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return order[pairs], _distance(words, pairs[:, 0], pairs[:, 1])


def _apart(similarity: float):
    def of(orders: np.ndarray, head: int, most: int, node: np.ndarray, home: np.ndarray, prints: np.ndarray, size: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions, and their distances: near ones of different homes that may fit,
        and that share no node in an earlier table."""
        order, heads, sizes, end, words = _laid_out(node, home, prints, orders)
        home, table = home[order], node[order] >> 32
        bins_fit = _may_fit(size[order].astype(np.int64), counts[order], similarity)

        def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            may = bins_fit(a, b)
            for at in range(0, len(a), 1 << 13):
                rows = at + np.nonzero(may[at : at + (1 << 13)])[0]
                bits = np.unpackbits((words[a[rows]] ^ words[b[rows]]).view(np.uint8), axis=1)
                for k in range(int(table[a[rows]].max(initial=0))):
                    may[rows] &= bits[:, orders[k][:head]].any(axis=1) | (table[a[rows]] <= k)
            return may

        small = _small_pairs(sizes, end, words, most)[:2]
        small = small[:, home[small[0]] != home[small[1]]]
        found = [small[:, fits(small[0], small[1])]]
        for k in np.nonzero(sizes > SMALL)[0].tolist():
            at, to = int(heads[k]), int(heads[k] + sizes[k])
            inside = lambda i, j, at=at: fits(i + at, j + at)
            found.append(_between(words[at:to], home[at:to], most, inside) + at)
        pairs = np.concatenate(found, axis=1).T
        return order[pairs], _distance(words, pairs[:, 0], pairs[:, 1])

    return of


def _searched(orders: np.ndarray, head: int, most: int, of):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])

    def done(parts):
        node, ids, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
        pairs, d = of(orders, head, most, node, *columns)
        if len(pairs):
            a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], schema=schema)

    def run(batches):
        held = []
        for batch in batches:  # sorted by node, which may reach into the next batch
            if not batch.num_rows:
                continue
            now = tuple(_matrix(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns)
            node = now[0]
            last = int(np.searchsorted(node, node[-1]))
            if last or (held and held[-1][0][-1] != node[0]):
                yield from done([*held, *([tuple(x[:last] for x in now)] if last else [])])
                held = []
            held.append(tuple(x[last:] for x in now))
        if held:
            yield from done(held)

    return run


def _met(prints: DataFrame, n: int, similarity: float, recall: float, of) -> DataFrame:
    """(set, home, fp, and what else `of` takes), of n distinct sets, to pairs (a, b, d): a < b,
    and d bits differ."""
    head, n_tables = tables(n, similarity, recall)
    orders, most = _bit_orders(n_tables), reach(similarity)
    schema = T.StructType([T.StructField("node", T.LongType()), *prints.schema.fields])
    index = prints.mapInArrow(_posted(head, orders), schema).repartition("node").sortWithinPartitions("node")
    return index.mapInArrow(_searched(orders, head, most, of), "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) of similarity or more."""
    left = sets.select(F.col("set").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("set").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def with_group(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """(doc_id, row, group): a hash of doc_id and text for each row of docs, and what its near
    copies share. Null and empty texts have no shingles and are one group."""
    text = F.col("text").cast("binary")
    rows = cut(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _prints(shingle)(text).alias("p")).select("doc_id", "row", "p.*"))
    distinct = cut(rows.groupBy("set").agg(F.min("fp").alias("fp")))
    n = distinct.count()
    pairs = cut(_met(distinct.select("set", F.col("set").alias("home"), "fp"), n, similarity, recall, _forests))
    ends = cut(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct())
    whole = docs.select(text.alias("text")).mapInArrow(_sets(shingle), "set long, bins binary, items array<int>")
    sets = cut(whole.join(ends, "set", "left_semi").groupBy("set").agg(*(F.any_value(c).alias(c) for c in ("bins", "items"))))

    way = lambda v: pairs.select(F.col(v).alias("v"), F.struct("d", F.xxhash64("a", "b").alias("tie"), "a", "b").alias("n"))
    nearest = way("a").union(way("b")).groupBy("v").agg(F.min("n").alias("n")).select("n.a", "n.b").distinct()
    home = components(_compared(nearest, sets, similarity))
    rest = _unjoined(pairs.join(nearest, ["a", "b"], "left_anti"), home)
    home = components(_compared(rest, sets, similarity).union(_stars(home)))
    of_set = home.select(F.col("node").alias("set"), F.col("component").alias("home"))
    known = distinct.join(sets.select("set", F.size("items").alias("size"), "bins"), "set").join(of_set, "set", "left")
    placed = known.select("set", F.coalesce("home", "set").alias("home"), "fp", "size", "bins")
    more = _met(placed, n, similarity, recall, _apart(similarity)).join(pairs, ["a", "b"], "left_anti").select("a", "b")
    joined = components(_compared(more, sets, similarity).union(_stars(home)))
    return rows.join(joined, rows["set"] == joined["node"], "left").select("doc_id", "row", F.coalesce("component", "set").alias("group"))


def _stars(home: DataFrame) -> DataFrame:
    """(node, component) as edges (a, b), which are in components already."""
    return home.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _unjoined(pairs: DataFrame, home: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are in different components of home (node, component)."""
    for v in ("a", "b"):
        pairs = pairs.join(home.select(F.col("node").alias(v), F.col("component").alias(f"home_{v}")), v, "left")
    return pairs.where(F.coalesce("home_a", "a") != F.coalesce("home_b", "b")).select("a", "b")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """docs without all but one row of each group of near copies: the one with the smallest
    doc_id (null last), and of several texts under that doc_id the one with the smallest hash.
    Rows without a doc_id group like any other; every group keeps a row."""
    least = with_group(docs, similarity, shingle, recall).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"))
    return packed.join(least.select("least.row"), "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
