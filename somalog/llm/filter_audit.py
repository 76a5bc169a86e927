"""How filters interact: what each removes at each step of every order of them.

A document's failures are a mask, one bit a filter. Masks are counted by part with Spark, in a
table of at most 2 ** filters rows a part, and each part's table becomes a decision diagram:

* A level tests one filter; a node has a child for documents that pass it and one for those that
  fail. Terminals hold counts (documents, and those with a tag), a node's weight is the sum of its
  children's, equal nodes are one, and what no document reaches is the empty node.
* Orders follow each other by plain changes, so each differs from the one before by one swap of
  neighbours. Swapping two neighbouring levels rewrites the nodes of these two levels alone; the
  nodes above keep their names.
* Along an order's all-pass path, the weight of a pass edge is what a step keeps, that of the fail
  edge what it removes. All fail edges of a level together are what fails its filter, and a fail
  edge that leaves the all-pass path and then passes everything leads to those that fail nothing
  else. A filter's removals summed over all orders are its share as Shapley has it, times the
  number of orders.

A copy is a text that a smaller doc_id has, in any part, whether or not a filter removes it. Texts
meet by SHA-256; of each digest a task sends one row for every part and tag, so a text that many
documents share is counted where it lies.

Defined results: a null text is an empty one, a null lang the part of the empty string; a row
without doc_id has no labels and is never a copy, nor makes others copies; repeated rows of a
doc_id are documents each, and none of them is a copy of the others; repeated labels of a doc_id
count as one, which has a tag if any of them has; parts without a document have no rows, so an
empty table gives an empty result; labels of unknown documents and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import cycle

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from somalog.llm.common import WORD

#: Filters by letter: whether a text of these words fails.
Rule = Callable[[Column, Column], Column]
RULES: dict[str, Rule] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
COPY = "E"
TAGS = ("good", "toxic")
SALTS = 1 << 20

Counts = tuple[int, ...]
EMPTY = 0


def masks(docs: DataFrame, tags: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """(part, mask, n, and n_<tag> for each of tags' columns but doc_id): the documents by part and
    failures. Bit i of a mask is the i-th rule's, the bit after them that of copies. tags has one
    row a doc_id, of booleans."""
    names = [c for c in tags.columns if c != "doc_id"]
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    worded = read.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    failed = [rule(F.col("text"), F.col("words")).cast("int") * (1 << i) for i, rule in enumerate(rules.values())]
    own = worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(failed[1:], failed[0]).alias("mask"))
    own = own.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))

    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(0))  # nulls would all meet
    tagged = own.withColumn("salt", salt).join(tags.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    tagged = tagged.select("doc_id", "part", "digest", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in names))
    alike = tagged.groupBy("digest", "part", "mask", *names).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(W.partitionBy("digest"))  # a row for each part and tags
    originals = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = alike.withColumn("least", least).withColumn("originals", originals)
    both = F.array(
        F.struct("mask", F.col("originals").alias("n")),
        F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )
    rows = split.select("part", *names, F.inline(both)).where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}") for c in names))


def plain_changes(n: int) -> Iterator[int]:
    """The positions whose element is swapped with the next, so that all orders of n come by once."""
    if n < 2:
        return
    others = plain_changes(n - 1)
    down, up = range(n - 2, -1, -1), range(n - 1)
    for sweep in cycle((down, up)):
        yield from sweep
        if (other := next(others, None)) is None:
            return
        yield other + (sweep is down)


class Diagram:
    """Counts by failure mask, as a decision diagram with one level a filter."""

    def __init__(self, counts: Mapping[int, Counts], filters: int) -> None:
        self.order = list(range(filters))
        self.width = len(next(iter(counts.values())))
        self.weight: dict[int, Counts] = {EMPTY: (0,) * self.width}
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]  # children to node
        self.children: dict[int, tuple[int, int]] = {EMPTY: (EMPTY, EMPTY)}
        self.ends: dict[Counts, int] = {}
        self.root = self._built(counts, 0, 0)

    def _built(self, counts: Mapping[int, Counts], level: int, mask: int) -> int:
        if level == len(self.order):
            own = counts.get(mask, self.weight[EMPTY])
            if not any(own):
                return EMPTY
            if own not in self.ends:
                self.ends[own] = self._named(own)
            return self.ends[own]
        return self._node(level, self._built(counts, level + 1, mask), self._built(counts, level + 1, mask | 1 << self.order[level]))

    def _named(self, weight: Counts) -> int:
        name = max(self.weight) + 1
        self.weight[name] = weight
        return name

    def _node(self, level: int, passed: int, failed: int) -> int:
        if passed == failed == EMPTY:
            return EMPTY
        if (passed, failed) not in self.levels[level]:
            name = self._named(tuple(map(sum, zip(self.weight[passed], self.weight[failed], strict=True))))
            self.levels[level][passed, failed], self.children[name] = name, (passed, failed)
        return self.levels[level][passed, failed]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next; nodes of the upper one keep their names."""
        upper, lower = self.levels[level], self.levels[level + 1]
        self.order[level : level + 2] = self.order[level + 1], self.order[level]
        self.levels[level], self.levels[level + 1] = {}, {}
        for (passed, failed), name in upper.items():
            (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
            now = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.levels[level][now], self.children[name] = name, now
        for name in lower.values():
            del self.weight[name], self.children[name]

    def steps(self) -> list[tuple[int, Counts, Counts, int, int]]:
        """For each step its filter, the counts that are kept and removed, how many fail it after
        an earlier step removed them, and how many fail it alone."""
        found, on, ways = [], self.root, {self.root: 1}  # ways: paths to each node of a level
        for level, which in enumerate(self.order):
            failing, below = 0, {}
            for name, n in ways.items():
                for child in self.children[name]:
                    below[child] = below.get(child, 0) + n
                failing += n * self.weight[self.children[name][1]][0]
            passed, failed = self.children[on]
            alone = failed
            for _ in range(level + 1, len(self.order)):
                alone = self.children[alone][0]
            found.append((which, self.weight[passed], self.weight[failed], failing - self.weight[failed][0], self.weight[alone][0]))
            on, ways = passed, below
        return found


def _of_part(letters: Sequence[str], tags: Sequence[str]):
    """Rows of one part's masks to its rows of steps."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        columns = [part["n"].tolist(), *(part[f"n_{c}"].tolist() for c in tags)]
        diagram = Diagram(dict(zip(part["mask"].tolist(), zip(*columns, strict=True), strict=True)), len(letters))
        rows, shares = [], dict.fromkeys(letters, 0)
        for level in (None, *plain_changes(len(letters))):
            if level is not None:
                diagram.swap(level)
            order = "".join(letters[k] for k in diagram.order)
            for step, (which, kept, removed, redundant, alone) in enumerate(diagram.steps(), 1):
                shares[letters[which]] += removed[0]
                rows.append((part["part"].iloc[0], order, step, kept[0], removed[0], redundant, alone, *removed[1:]))
        lost = [f"{c}_lost" for c in tags]
        out = pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost])
        return out.assign(shapley=[shares[o[s - 1]] for o, s in zip(out["filter_order"], out["step"], strict=True)])

    return run


def steps(counted: DataFrame, letters: Sequence[str], tags: Sequence[str] = TAGS) -> DataFrame:
    """masks() to one row a part, order and step: what the step keeps, removes, finds removed and
    so on. letters name the bits; a part is one task's work, whose size is that of its masks."""
    lost = ", ".join(f"{c}_lost long" for c in tags)
    schema = f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, {lost}, shapley long"
    return counted.groupBy("part").applyInPandas(_of_part(letters, tags), schema)


def audit(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """The steps of all orders of the rules and of the filter for copies. labels: doc_id, quality
    and toxic, of which 1 makes a document good or toxic."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    tags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    return steps(masks(docs, tags, rules), [*rules, COPY])


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
l AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
    SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
