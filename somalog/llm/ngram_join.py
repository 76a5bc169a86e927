"""Joining texts by the Jaccard similarity of their word n-grams, with adaptive multi-match prefixes.

Two texts link if their sets of shingles have a similarity of `percent` % or more. Put all shingles
in one order, the same for every text. A text with n shingles needs t = n * percent / 100 of them
in common with any partner, so of two that link the first n - t + l of either's shingles (its
l-prefix) have l in common. If one takes l and the other k, they have min(l, k) in common. A longer
prefix costs postings and asks more of a pair before it is compared: each text picks its own l.

* Texts with equal sets are one from the start.
* Screen: with shingles in the order of their hashes, all sets post a prefix of one length for
  their size. A set stays if enough of its posted shingles are posted by other sets, too; only
  such sets can have a partner. A task settles what repeats inside a chunk of sets, so a shingle
  that many sets share reaches its bucket once a chunk.
* First links: the sets that stay meet in the lists of their first FIRST shared shingles, largest
  first, and are compared with those before them there that stand for a component. That joins
  groups of near copies with a few comparisons a member instead of one a pair.
* Rest: only links between different components are missing then. The screen runs again with
  components in place of sets, and drops what has no partner in another one. For those that are
  left, shingles are ordered by the number of such sets that hold them, rarest first, and shingles
  of a single component, which can't help, before them all. With these numbers each set weighs its prefixes:
  the postings to read, and the candidates to verify, which are at most the postings by l. The
  lists of posted shingles give the pairs of different components and fitting sizes; pairs with
  min(l, k) posted shingles in common are verified exactly, the best of each two components first.
* Crowds: a set whose prefix would reach a list of over `crowd` sets takes l = 1, and brings its
  shingles along to such lists. There an index of the shingles counts what each set has in common
  with all others at once, so pairs are decided in place, and only links that join components
  leave the task. What a list holds of its largest component, which may be most of it, is dealt to tasks
  in blocks, once; only the others' blocks go to all of them.

The result is exact but for collisions of 64-bit shingle hashes; no list, partner or candidate has
a cap.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer
words than a shingle has its whole sequence as one; a null doc_id links as any other row, but
never names a component (null, if no member has a doc_id); repeated rows stay; different texts
under one doc_id are each judged by themselves; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somalog.llm.common import cut, remove, write
from somalog.llm.components import components
from somalog.llm.substring import rolling

SHINGLE, PERCENT = 4, 85
#: The screen's l is this part of a set.
SCREEN_PART = 10
FIRST, LIST_ROWS, STANDING = 2, 1024, 8
#: Lists of more sets than CROWD are decided in place, in blocks of so many shingles.
CROWD, BLOCK = 64, 1 << 20
#: What verifying a candidate costs, in postings read.
VERIFY = 32
#: So many texts' sets leave a task at once; so many posted shingles are settled together.
ROWS, CHUNK = 500, 1 << 20


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; of fewer words, their whole sequence."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(rolling(hashes, min(shingle, len(words))))


def least_common(n: int, percent: int) -> int:
    """How many shingles a set of n has in common with any partner."""
    return -(-n * percent // 100)


def screen_level(n: int, percent: int) -> int:
    """The l that a set of n is screened with; it doesn't fall where n grows."""
    return min(least_common(n, percent), -(-n // SCREEN_PART))


def _needed(n: Column, percent: int) -> Column:
    """How many screened shingles a set of n has in common with its smallest partner at least."""
    up = lambda x, by: F.floor((x + (by - 1)) / by)
    least = up(n * percent, 100)
    return F.least(up(least * percent, 100), up(least, SCREEN_PART))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _named(shingle: int, percent: int):
    """Rows (doc_id, text) to rows (doc_id, mark, set, n, prefix): marks name texts and sets name sets."""

    def run(batches):
        for batch in _slices(batches):
            texts = [t.as_py() or b"" for t in batch.column("text")]
            sets = [shingles(t, shingle) for t in texts]
            marks = pa.array([hashlib.md5(t).digest() for t in texts])
            names = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets])
            prefix = _lists([s[: len(s) - least_common(len(s), percent) + screen_level(len(s), percent)] for s in sets])
            n = pa.array(list(map(len, sets)), pa.int64())
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), marks, names, n, prefix], names=["doc_id", "mark", "set", "n", "prefix"])

    return run


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sid, prefix) to postings (token, sid, kind). Of tokens that several sets of a chunk
    hold, the first posting has kind 1, known to be shared, and others kind 2, to pass."""

    def settled(parts):
        sids, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(tokens, kind="stable")
        sids, tokens = sids[order], tokens[order]
        first = np.append(True, tokens[1:] != tokens[:-1])
        kind = np.where(first, np.append(~first[1:], False), 2).astype(np.int32)
        yield pa.record_batch([pa.array(x) for x in (tokens, sids, kind)], names=["token", "sid", "kind"])

    held, n = [], 0
    for batch in batches:
        prefix = batch.column("prefix")
        sizes = np.diff(prefix.offsets.to_numpy())
        held.append((np.repeat(batch.column("sid").to_numpy(zero_copy_only=False), sizes), prefix.flatten().to_numpy(zero_copy_only=False)))
        n += int(sizes.sum())
        if n >= CHUNK:
            yield from settled(held)
            held, n = [], 0
    if n:
        yield from settled(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by token to (sid, token) of those whose token is posted by another set too."""
    held, before = None, None
    for batch in chain(batches, (None,)):
        now = None if batch is None else [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "sid", "kind")]
        if held is not None:
            now = held if now is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if now is None or not len(now[0]):
            continue
        last = batch is None
        held = None if last else [x[-1:] for x in now]  # whose next token is not known yet
        token, sid, kind = now
        n = len(token) - (not last)
        same = np.append(token[1:] == token[:-1], False)
        hit = (kind > 0) | same
        hit[1:] |= same[:-1]
        hit[:1] |= token[0] == before
        hit = np.nonzero(hit[:n])[0]
        if n:
            before = token[n - 1]
        if len(hit):
            yield pa.record_batch([pa.array(sid[hit]), pa.array(token[hit])], names=["sid", "token"])


def _with_items(shingle: int):
    """Rows (sid, text) to rows (sid, items)."""

    def run(batches):
        for batch in _slices(batches):
            yield pa.record_batch([batch.column("sid"), _lists([shingles(t.as_py(), shingle) for t in batch.column("text")])], names=["sid", "items"])

    return run


@dataclass
class Sets:
    """What a table of texts comes to: `rows` (doc_id, mark, set, n) as they are, `sets` (sid, set, least),
    one for each set with shingles, and of those that may have partners `held` (sid, n, tokens: its
    shared ones of the screen, sorted) and `items` (sid, items)."""

    rows: DataFrame
    sets: DataFrame
    held: DataFrame
    items: DataFrame


def screened(docs: DataFrame, percent: int, shingle: int) -> Sets:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    named, path = write(text.mapInArrow(_named(shingle, percent), "doc_id long, mark binary, set binary, n long, prefix array<long>"))
    rows, _ = write(named.select("doc_id", "mark", "set", "n"))
    one = rows.where("n > 0").groupBy("set", "n").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("rep"))
    sets, _ = write(one.withColumn("sid", F.monotonically_increasing_id()))  # which number is whose doesn't matter
    of_rep = (named["set"] == sets["set"]) & (named["mark"] == sets["rep.mark"]) & named["doc_id"].eqNullSafe(sets["rep.doc_id"])
    posted = named.join(sets, of_rep).select("sid", "prefix").mapInArrow(_posted, "token long, sid long, kind int")
    met = posted.repartition(F.when(F.col("kind") == 2, F.col("sid")).otherwise(F.col("token"))).sortWithinPartitions("token")
    hits = met.mapInArrow(_shared, "sid long, token long").groupBy("sid").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    held = hits.join(sets.select("sid", "n", "rep"), "sid").where(F.size("tokens") >= _needed(F.col("n"), percent))
    held, _ = write(held.select("sid", "n", "tokens", "rep"))
    remove(docs.sparkSession, path)
    marked = text.withColumn("mark", F.md5("text"))
    reps = held.select("sid", F.lower(F.hex("rep.mark")).alias("mark"), F.col("rep.doc_id").alias("rep_id"))
    theirs = marked.join(reps, (marked["mark"] == reps["mark"]) & marked["doc_id"].eqNullSafe(reps["rep_id"])).select("sid", "text")
    items = theirs.mapInArrow(_with_items(shingle), "sid long, items array<long>").groupBy("sid").agg(F.first("items").alias("items"))
    return Sets(rows, sets.select("sid", "set", "least"), held.select("sid", "n", "tokens"), write(items)[0])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Stretches of sorted rows with equal keys; one that batches cut comes in parts."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _linked(percent: int):
    """Rows (token, part, sid, items) sorted by list, largest first, to links (a, b) inside lists."""

    def run(batches):
        at, standing, found = None, [], []
        for key, rows in _runs(batches, ["token", "part"]):
            if key != at:
                at, standing = key, []
            values, ends = rows.column("items").flatten().to_numpy().view(np.uint64), np.cumsum(np.append(0, np.diff(rows.column("items").offsets.to_numpy())))
            for k, sid in enumerate(rows.column("sid").to_pylist()):
                own = values[ends[k] : ends[k + 1]]
                home = next((i for i in range(len(standing) - 1, -1, -1) if similar(standing[i][1], own, percent)), None)
                if home is None:
                    standing = [*standing[-STANDING + 1 :], (sid, own.copy())]
                else:
                    found.append((standing[home][0], sid))
                    standing.append(standing.pop(home))  # the last one that fitted is tried first
            if len(found) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found = []
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def first_links(sets: Sets, percent: int) -> DataFrame:
    """Links (a, b) among sets that share one of their first shingles."""
    listed = sets.held.select("sid", "n", F.explode(F.slice("tokens", 1, FIRST)).alias("token"))
    sizes = listed.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    dealt = listed.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("sid"), F.ceil(F.col("rows") / LIST_ROWS)))
    order = ["token", "part"]
    met = dealt.select("token", "part", "sid", "n").join(sets.items, "sid").repartition(*order).sortWithinPartitions(*order, F.desc("n"), "sid")
    return met.select("token", "part", "sid", "items").mapInArrow(_linked(percent), "a long, b long")


_POSTING = "token long, df long, sid long, component long, n long, level long"


def _weighed(percent: int, verify: float, crowd: int):
    """Rows (sid, component, n, counts: (df, token) sorted) to postings of each set's prefix."""

    def run(batches):
        for batch in batches:
            out = []
            sids, homes, sizes = (batch.column(c).to_pylist() for c in ("sid", "component", "n"))
            flat, ends = batch.column("counts").flatten(), np.cumsum(np.append(0, np.diff(batch.column("counts").offsets.to_numpy())))
            df, token = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("df", "token"))
            for k, n in enumerate(sizes):
                own = df[ends[k] : ends[k + 1]]
                level, posted = prefix_level(own, n, percent, verify)
                if posted and own[posted - 1] > crowd:
                    level, posted = 1, posted - level + 1
                if posted:
                    at = slice(ends[k], ends[k] + posted)
                    out.append((token[at], df[at], *(np.full(posted, v, np.int64) for v in (sids[k], homes[k], n, level))))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "df", "sid", "component", "n", "level"])

    return run


def prefix_level(df: np.ndarray, n: int, percent: int, verify: float = VERIFY) -> tuple[int, int]:
    """The l of least estimated cost for a set of n, of whose shingles len(df) are held by other
    components too, by so many sets, rarest first; and how many of those its l-prefix has. The
    others come before them in the order. (0, 0) if it can't have a partner."""
    common = least_common(n, percent)
    more = len(df) - common  # an l-prefix has l + more of these shingles
    if more < 0:
        return 0, 0
    read = np.cumsum(df, dtype=np.float64)[more:]
    levels = np.arange(1, common + 1)
    best = int(np.argmin(read * (1 + verify / levels)))
    return best + 1, best + 1 + more


def _candidates(percent: int):
    """Rows (token, sid, component, n, level) sorted by token to pairs (a, b, need) of different
    components and fitting sizes."""

    def pairs(parts):
        sid, home, n, level = (np.concatenate(x) for x in zip(*parts, strict=True))
        i, j = np.nonzero(np.triu(home[:, None] != home[None], 1))
        fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        if len(i):
            a, b = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
            yield pa.record_batch([pa.array(x) for x in (a, b, np.minimum(level[i], level[j]))], names=["a", "b", "need"])

    def run(batches):
        at, held = None, []
        for key, rows in _runs(batches, ["token"]):
            if key != at:
                if held:
                    yield from pairs(held)
                at, held = key, []
            held.append([rows.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "component", "n", "level")])
        if held:
            yield from pairs(held)

    return run


def joining_links(sid: np.ndarray, home: np.ndarray, items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (sid, sid) that join different homes: a forest of all links between them. Shingles
    are indexed, so one pass over a set's lists counts what it has in common with every other."""
    n = np.array([len(x) for x in items])
    ends = np.cumsum(np.append(0, n))
    _, ids = np.unique(np.concatenate(items), return_inverse=True)
    rows = np.repeat(np.arange(len(n)), n)[np.argsort(ids, kind="stable")]
    sizes = np.bincount(ids)
    starts = np.cumsum(np.append(0, sizes))
    _, label, members = np.unique(home, return_inverse=True, return_counts=True)
    out, largest = [], members.argmax()
    for a in np.nonzero(label != largest)[0].tolist():  # pairs inside the largest are joined already
        own = ids[ends[a] : ends[a + 1]]
        many = sizes[own]
        places = np.repeat(starts[own] - np.cumsum(np.append(0, many[:-1])), many) + np.arange(many.sum())
        both = np.bincount(rows[places], minlength=len(n))
        near = np.nonzero(100 * both >= percent * (n[a] + n - both))[0]
        others, first = np.unique(label[near], return_index=True)
        for other, b in zip(others.tolist(), near[first].tolist(), strict=True):
            if other != label[a]:
                out.append((int(sid[a]), int(sid[b])))
        label[np.isin(label, others)] = label[a]
    return out


def _crowded(percent: int):
    """Rows (token, x, y, sid, component, items) sorted by (token, x, y), of two blocks of a list,
    to links (a, b)."""

    def links(parts):
        sid, home = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        found = joining_links(sid, home, [x for p in parts for x in p[2]], percent) if (home != home[0]).any() else []
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    def run(batches):
        at, held = None, []
        for key, rows in _runs(batches, ["token", "x", "y"]):
            if key != at:
                if held:
                    yield from links(held)
                at, held = key, []
            ends = np.cumsum(np.append(0, np.diff(rows.column("items").offsets.to_numpy())))
            items = np.split(rows.column("items").flatten().to_numpy().view(np.uint64).copy(), ends[1:-1])
            held.append((*(rows.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "component")), items))
        if held:
            yield from links(held)

    return run


def crowded_links(prefixes: DataFrame, items: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between components among the sets of long lists."""
    parts = prefixes.groupBy("token", "component").agg(F.sum("n").alias("shingles"))
    lists = parts.groupBy("token").agg(F.max(F.struct("shingles", "component")).alias("largest"), F.sum("shingles").alias("all"), F.count(F.lit(1)).alias("components"))
    up = lambda x: F.ceil(x / block)
    lists = lists.where("components > 1").select("token", F.col("largest.component").alias("largest"), up(F.col("all") - F.col("largest.shingles")).alias("others"), up(F.col("largest.shingles")).alias("blocks"))
    dealt = prefixes.join(lists, "token").withColumn("in_largest", F.col("component") == F.col("largest"))
    own = F.pmod(F.xxhash64("sid"), F.when(F.col("in_largest"), F.col("blocks")).otherwise(F.col("others"))) + F.when(F.col("in_largest"), F.col("others")).otherwise(F.lit(0))
    last = F.when(F.col("in_largest"), F.col("others")).otherwise(F.col("others") + F.col("blocks")) - 1
    placed = dealt.select("token", "sid", "component", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    placed = placed.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "sid", "component")
    order = ["token", "x", "y"]
    met = placed.join(items, "sid").repartition(*order).sortWithinPartitions(*order)
    return met.select(*order, "sid", "component", "items").mapInArrow(_crowded(percent), "a long, b long")


def _verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that have the similarity."""

    def run(batches):
        for batch in _slices(batches):
            x, y = batch.column("x"), batch.column("y")
            fine = [similar(*(c[k].values.to_numpy().view(np.uint64) for c in (x, y)), percent) for k in range(batch.num_rows)]
            yield batch.filter(pa.array(fine, pa.bool_())).select(["a", "b"])

    left, right = items.select(F.col("sid").alias("a"), F.col("items").alias("x")), items.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def with_component(rows: DataFrame, known: DataFrame, name: str = "sid", to: str = "component") -> DataFrame:
    """rows and the component of their set; known: (node, component) of those with links."""
    home = known.select(F.col("node").alias(name), F.col("component").alias(to))
    return rows.join(home, name, "left").withColumn(to, F.coalesce(to, name))


def prefixes(sets: Sets, known: DataFrame, percent: int, verify: float = VERIFY, crowd: int = CROWD) -> DataFrame:
    """The postings that each set with possible partners in other components picks."""
    placed = with_component(sets.held, known)
    posted = placed.select("sid", "component", "n", F.explode("tokens").alias("token"))
    crossing = lambda posted, *more: posted.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), *more).where("low != high").drop("low", "high")
    open_ = posted.join(crossing(posted), "token").groupBy("sid", "component", "n").agg(F.count(F.lit(1)).alias("shared"))
    open_ = cut(open_.where(F.col("shared") >= _needed(F.col("n"), percent)).drop("shared"))
    whole = open_.join(sets.items, "sid").select("sid", "component", "n", F.explode("items").alias("token"))
    counted = crossing(whole, F.count(F.lit(1)).alias("df"))
    counts = whole.join(counted, "token").groupBy("sid", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("counts"))
    return counts.mapInArrow(_weighed(percent, verify, crowd), _POSTING)


def candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, shared) of sets of different components that short lists leave open."""
    met = postings.select("token", "sid", "component", "n", "level").repartition("token").sortWithinPartitions("token")
    pairs = met.mapInArrow(_candidates(percent), "a long, b long, need long")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need")).where("shared >= need").drop("need")


def _stars(known: DataFrame) -> DataFrame:
    """Components as links, so that more can be added to them."""
    return known.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def completed(sets: Sets, known: DataFrame, percent: int, verify: float = VERIFY, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(node, component) of sets after all links between the components known."""
    posted, _ = write(prefixes(sets, known, percent, verify, crowd))
    pairs, _ = write(candidates(posted.where(F.col("df") <= crowd), percent))
    known = _joined(known, crowded_links(posted.where(F.col("df") > crowd), sets.items, percent, block))
    for best_only in (True, False):
        open_ = with_component(with_component(pairs, known, "a", "home_a"), known, "b", "home_b").where("home_a != home_b")
        if best_only:  # if it holds, what is left between the two needs no comparing
            two = [F.least("home_a", "home_b").alias("p"), F.greatest("home_a", "home_b").alias("q")]
            open_ = open_.groupBy(*two).agg(F.max(F.struct("shared", "a", "b")).alias("best")).select("best.a", "best.b")
        known = _joined(known, _verified(open_, sets.items, percent))
    return known


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    found, _ = write(links)
    return known if found.isEmpty() else components(found.union(_stars(known)))


def components_of(sets: Sets, percent: int, first: Callable[[Sets, int], DataFrame] = first_links, **parameters) -> DataFrame:
    """(node, component) of all sets that link to others. `first` finds links; what it misses is
    found after it."""
    return completed(sets, components(first(sets, percent)), percent, **parameters)


def linked(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, **parameters) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set, and the smallest doc_id
    that a chain of links reaches."""
    sets = screened(docs, percent, shingle)
    homes = with_component(sets.sets, components_of(sets, percent, **parameters))
    least = homes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = homes.join(least, "component").select("set", "component_id")
    joined = sets.rows.join(named, "set", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s
    FROM d),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM g),
r AS (SELECT k, n, any_value(s) AS s, min(doc_id) AS least FROM k WHERE n > 0 GROUP BY k, n),
t AS (SELECT k, n, unnest(s) AS x FROM r),
l AS (
    SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.x = b.x AND a.k < b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT k, k AS other FROM r UNION SELECT c.k, e.b FROM c JOIN e ON e.a = c.other),
m AS (SELECT c.k, min(r.least) AS component_id FROM c JOIN r ON r.k = c.other GROUP BY c.k)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM k LEFT JOIN m USING (k)
"""
