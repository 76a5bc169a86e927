"""Merging logs by identity, and finding what changed.

Incoming rows replace earlier rows with the same id, or of the same source type and file name if
both are body measurements. The rule "in order, each incoming row removes every earlier match"
has a closed form: a row stays if no incoming row after it matches it. So two maxima over equal
keys decide, one a key, and nothing is joined or folded row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somalog.functions.scalars import blank_to_null, canonical_json, filename_key


def _latest(rows: DataFrame, key: str, seq: str, incoming: Column) -> DataFrame:
    """The last incoming place of each key; aggregated before it is joined, so that a key of
    many rows does not pile up."""
    return rows.where(incoming & F.col(key).isNotNull()).groupBy(key).agg(F.max(seq).alias(f"_last{key}"))


def merged(rows: DataFrame, keys: Sequence[str], seq: str, incoming: str) -> DataFrame:
    """The rows that stay. keys: columns of which one equal non-null value makes rows match.
    Existing rows are not compared among themselves."""
    coming = F.col(incoming)
    stays = F.lit(True)
    for key in keys:
        rows = rows.join(_latest(rows, key, seq, coming), key, "left")
        stays = stays & (F.coalesce(F.col(f"_last{key}"), F.col(seq)) <= F.col(seq))
    return rows.where(stays).drop(*(f"_last{key}" for key in keys))


def upload_key(kind: Column, source_type: Column, filename: Column) -> Column:
    """What identifies an uploaded report besides its id; null for rows it does not apply to."""
    name = filename_key(filename)
    return F.when((kind == "body_composition") & blank_to_null(source_type).isNotNull() & name.isNotNull(), F.to_json(F.struct(source_type.alias("t"), name.alias("f"))))


def merge_logs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Logs (seq, id, kind, source struct<type, filename>, ...) of both tables after the merge.
    Rows without id or kind are dropped; incoming rows come after all existing ones."""
    both = existing.withColumn("_incoming", F.lit(False)).unionByName(incoming.withColumn("_incoming", F.lit(True)), allowMissingColumns=True)
    fine = both.where(blank_to_null(F.col("id")).isNotNull() & blank_to_null(F.col("kind")).isNotNull())
    keyed = fine.withColumn("_seq", F.struct("_incoming", "seq")).withColumn("_upload", upload_key(F.col("kind"), F.col("source.type"), F.col("source.filename")))
    return merged(keyed, ["id", "_upload"], "_seq", "_incoming").drop("_seq", "_upload", "_incoming")


def changed(stored: DataFrame, merged_rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, changed): rows whose canonical JSON is new or differs from the stored one."""
    before = stored.select(key, canonical_json(F.col(payload)).alias("_before"), F.lit(True).alias("_stored"))
    after = merged_rows.select(key, canonical_json(F.col(payload)).alias("_after"))
    return after.join(before, key, "left").select(key, (F.col("_stored").isNull() | ~F.col("_after").eqNullSafe(F.col("_before"))).alias("changed"))


def sorted_logs(logs: DataFrame, time: Column) -> DataFrame:
    """Oldest first: by event time text, then id, as bytes order them."""
    return logs.orderBy(time, "id")


def existing_upload(uploads: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """uploads and existing_id: the id of the first stored log (id, key, order) of the same upload
    key, if there is one. The stored side is reduced to one row a key before it is joined."""
    first = stored.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("id", order).alias("existing_id"))
    return uploads.join(first, key, "left")


def log_rank(logs: DataFrame, time: Column, name: str, chunk: int = 13) -> DataFrame:
    """logs and their place, from 1, in the order of sorted_logs. No window holds all logs: they
    are numbered inside time chunks (the first characters of the time text: hours), and only the
    chunks' row counts are summed over time. Null times come first."""
    cut = F.substring(time, 1, chunk)
    chunked = logs.withColumn("_at", time).withColumn("_chunk", F.coalesce(cut, F.lit("")))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")).select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy("_at", "id"))
    return chunked.withColumn("_inside", inside).join(offsets, "_chunk").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_at", "_chunk", "_inside", "_before")
