"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source documents are laid out in key order,
the key range being cut into equal pieces (buckets), so that a source holding any share of the
rows is spread over many tasks. Bucket totals give each bucket's offset (a prefix sum over a
table of a few rows a source), a window inside the bucket gives the rest, and so each document
knows how many of its source's words stand before it. The budget is then cut at exactly its
last word: whole epochs first, then the documents in key order, the last one in part.

Defined results: a null text has size 0; a null source is one source of its own, the last;
repeated rows are separate documents; which of several rows of one doc_id and size comes first
hangs on a hash of their text and other columns, so no order of the input matters; documents of a source without words take nothing; an
empty table gives an empty result; other columns pass through unless they are named like an
output column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somalog.llm.common import WORD, n_words

ROWS_PER_BUCKET = 20_000


def with_size(docs: DataFrame) -> DataFrame:
    """docs and its column size, the number of words."""
    return docs.withColumn("size", n_words(F.col("text")))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """(_sid, source, source_size) to those and target.

    Filling by weight with a cap of epochs times the size has one solution, min(cap, level x
    weight). With the sources in order of cap / weight, the level if all before are at their
    caps first rises and then falls along the order; its maximum is the level that holds.
    The windows run over one row a source.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(1))
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    weighed = (
        sizes.withColumn("_i", F.row_number().over(by_name) - 1)
        .withColumn("_w", F.element_at(cycle, (F.col("_i") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * F.lit(epochs).cast("long"))
    )
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_i").asc())
    before, onwards = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_rows).cast("double") * F.lit(float(share))
    return (
        weighed.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0)).cast("double")) / F.sum("_w").over(onwards).cast("double"))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.max("_level").over(all_rows) * F.col("_w").cast("double")))
        .select("_sid", "source_size", "target")
    )


def mix(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, rows_per_bucket: int = ROWS_PER_BUCKET, tie: Column | None = None) -> DataFrame:
    """sized (doc_id, source, size, and any other columns) and source_size, target, taken.

    Sources in order of code points, null last, take the weights in turn and share
    `share` times all sizes; no source gets over `epochs` times its own size. taken is the
    number of the document's words in the mix, repeats counted. Rows of equal doc_id and size are
    dealt and ordered by tie, a long (a hash of what else they hold, where that matters).
    """
    tie = F.lit(0).cast("long") if tie is None else tie
    sized = sized.drop("source_size", "target", "taken")
    buckets = max(1, -(-sized.count() // rows_per_bucket))
    key = lambda id_: F.md5(F.coalesce(id_.cast("string"), F.lit("null")).cast("binary"))
    no_key = key(F.lit(None))
    keyed = (
        sized.select(F.struct(*(F.col(f"`{c}`") for c in sized.columns)).alias("_row"), "doc_id", "source", "size", tie.alias("_tie"))
        .withColumn("_sid", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
        .withColumn("_key", key(F.col("doc_id")))
        .withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("int"))
        # rows without doc_id share a key: in its bucket they are dealt by size, and then by tie, which are next in order
        .withColumn("_part", F.when(F.col("doc_id").isNull(), F.col("size") + 1).when(F.col("_key") > no_key, F.lit((1 << 62))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_bucket", F.struct("_range", "_part", F.when(F.col("doc_id").isNull(), F.floor(F.col("_tie") / (1 << 59))).alias("_slice")))
        .drop("_range", "_part")
    )
    totals = keyed.groupBy("_sid", "source", "_bucket").agg(F.sum("size").alias("_words"))
    targets = source_targets(totals.groupBy("_sid", "source").agg(F.sum("_words").alias("source_size")), weights, share, epochs)
    earlier = Window.partitionBy("_sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_sid", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset")).join(targets, "_sid")
    inside = Window.partitionBy("_sid", "_bucket").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.col("_inside"), F.lit(0))
    budget, whole = F.floor("target").cast("long"), F.col("_whole")
    taken = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - before)))
    return (
        keyed.withColumn("_inside", F.sum("size").over(inside))
        .join(offsets, ["_sid", "_bucket"])
        .withColumn("_whole", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.col("source_size"))).cast("long"))
        .withColumn("taken", taken.cast("long"))
        .select("_row.*", "source_size", "target", "taken")
    )


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """docs as the mix takes them: a row for each whole repeat of a text, and one row a
    source at most whose text stops at the word where the budget ends."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*columns).alias("row"))
    mixed = mix(rows, tie=F.xxhash64(F.sha2("row.text", 256), F.to_json("row", {"ignoreNullFields": "false"})), **parameters)
    repeats = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    left = F.col("taken") - repeats * F.col("size")
    first_words = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), 1, left.cast("int")), " ")
    parts = F.concat(
        F.array_repeat(F.col("row.text"), repeats),
        F.when(left > 0, F.array(first_words)).otherwise(F.array().cast("array<string>")),
    )
    return mixed.select("row", F.explode(parts).alias("part")).select(*(F.col("part").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
