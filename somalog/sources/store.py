"""The log store: JSON records in month partitions, read in merge order and written by month.

A record is one line of JSON in `period=YYYY-MM`; its text is kept as it came, beside the few
fields that identity and order need. A write touches only the months of its rows, and none where
nothing changed.

Writes are optimistic. Each works from one version of the store (see commits), puts the months that
it changes into a folder of its own, and commits them as the next version. If another writer was
faster, what it wrote is looked at: a write to other months is committed on top of it, one to the
same months is merged again with what is there now, ATTEMPTS times in all. Failed writes leave a
folder that nothing refers to, which `vacuum` removes with those of old versions.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somalog.functions import scalars as fn
from somalog.operators import merge
from somalog.sources import commits
from somalog.sources.commits import Conflict, Manifest

FIELDS = "id string, kind string, measured_at_local string, start_at string, source struct<type: string, filename: string>"
STORED = "raw string, place long, period string"
UNKNOWN = "unknown"
#: Tries of a write, and the wait after each but the last, longer each time.
ATTEMPTS, WAIT_MS = 3, 350


def parsed(raw: DataFrame) -> DataFrame:
    """raw (raw, place, period, ...) with the fields that decide identity and order."""
    rows = raw.withColumn("_f", F.from_json("raw", FIELDS)).select(*raw.columns, "_f.*")
    bad = fn.blank_to_null(F.col("id")).isNull() | fn.blank_to_null(F.col("kind")).isNull()
    return rows.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("a record needs id and kind: "), F.substring("raw", 1, 80))).cast("string")).otherwise(F.col("id")))


def from_array_files(spark: SparkSession, path: str) -> DataFrame:
    """(raw, place, period) from files named by month that hold one JSON array each."""
    texts = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("text"), F.regexp_extract("path", r"(?i)(\d{4}-\d{2}|unknown)\.json\z", 1).alias("period"))
    fine = texts.where(F.col("period") != "").where(F.trim("text") != "")
    items = F.from_json("text", "array<string>")
    whole = F.when(items.isNull(), F.raise_error(F.lit("a month file must hold a JSON array")).cast("array<string>")).otherwise(items)
    return fine.select(F.posexplode(whole).alias("pos", "raw"), F.lower("period").alias("period")).select("raw", F.col("pos").cast("long").alias("place"), "period")


def _data(root: str) -> str:
    return f"{root}/data"


def _of(spark: SparkSession, root: str, manifest: Manifest) -> DataFrame:
    rows = spark.createDataFrame([], STORED)
    for base, schema in ((_data(root), f"{STORED}, write string"), (f"{root}/{commits.OLDER}", STORED)):
        if paths := [path for folder in manifest.months.values() if (path := f"{root}/{folder}").startswith(f"{base}/")]:
            found = spark.read.schema(schema).option("basePath", base).parquet(*paths).drop("write")
            rows = rows.union(found) if len(paths) < len(manifest.months) else found
    return rows


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(raw, place, period) of all months, of the newest version or an older one; no rows for a
    store that is not there yet."""
    manifest = commits.newest(spark, root) if version is None else commits.at(spark, root, version)
    if manifest is None:
        raise ValueError(f"the store has no version {version}")
    return _of(spark, root, manifest)


def file_rank(period: Column) -> Column:
    """Sorts months from the newest to the oldest, the unknown month last."""
    return F.when(period == UNKNOWN, F.lit("~")).otherwise(F.translate(period, "0123456789", "9876543210"))


def all_logs(spark: SparkSession, root: str) -> DataFrame:
    """All records after the merge in reading order: newest month first, older months as later
    arrivals, so an id in two months is the older month's, and twice in a month the later one."""
    rows = parsed(read(spark, root))
    ranked = rows.withColumn("_rank", file_rank(F.col("period"))).withColumn("_incoming", F.lit(True)).withColumn("_seq", F.struct("_rank", "place")).withColumn("_upload", merge.upload_key(F.col("kind"), F.col("source.type"), F.col("source.filename")))
    kept = merge.merged(ranked, ["id", "_upload"], "_seq", "_incoming").drop("_rank", "_incoming", "_seq", "_upload")
    return kept.withColumn("event_time", fn.event_time(F.col("measured_at_local"), F.col("start_at")))


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The records of the newest month alone, as a first view: one partition is read."""
    months = read(spark, root).select("period").distinct().orderBy(file_rank(F.col("period"))).limit(1)
    return parsed(read(spark, root).join(months, "period", "left_semi"))


def _written(rows: DataFrame, root: str) -> tuple[dict[str, str], str]:
    """rows (raw, place, period) in a folder of their own: each month's folder, and the write's
    name. Files follow ranges of month and order, so a large month has several tasks."""
    write = uuid.uuid4().hex
    path = f"{_data(root)}/write={write}"
    rows.repartitionByRange("period", "place").write.partitionBy("period").parquet(path)
    names = [name for name in commits.children(rows.sparkSession, path) if name.startswith("period=")]
    return {name.removeprefix("period="): f"data/write={write}/{name}" for name in names}, write


def _attempted(spark: SparkSession, root: str, change: Callable[[DataFrame], tuple[DataFrame, set[str], int]]) -> int:
    """Commit a change of the store: it takes the stored rows, and returns the rows of the months that it
    changes, those months (one without rows goes), and a number to return. A conflict with a writer
    of other months needs no new change."""
    for attempt in range(ATTEMPTS):
        base = commits.newest(spark, root)
        rows, touched, n = change(_of(spark, root, base))
        if not touched:
            return n
        folders, write = _written(rows, root)
        before = {m: base.months.get(m) for m in touched}
        while True:
            months = {m: f for m, f in base.months.items() if m not in touched} | folders
            try:
                commits.commit(spark, root, base, months, write)
                return n
            except Conflict:
                base = commits.newest(spark, root)
                if {m: base.months.get(m) for m in touched} == before:
                    continue
                failure: Exception = Conflict(f"other writers keep changing the same months of {root}")
            except Py4JJavaError as e:  # the file system failed; the version is not taken
                failure = e
            break
        commits.remove(spark, f"{_data(root)}/write={write}")
        if attempt + 1 == ATTEMPTS:
            raise failure
        time.sleep(WAIT_MS * (attempt + 1) / 1000)
    raise AssertionError


def save(spark: SparkSession, root: str, incoming: DataFrame) -> int:
    """Merge records (raw, place) among themselves and then into the months they belong to; how many
    are new or changed. Months are rewritten only if they hold such a record."""
    coming = parsed(incoming.select("raw", "place").withColumn("period", F.lit("")))
    named = coming.withColumn("_incoming", F.lit(True)).withColumn("_upload", merge.upload_key(F.col("kind"), F.col("source.type"), F.col("source.filename")))
    coming = merge.merged(named, ["id", "_upload"], "place", "_incoming").drop("_incoming", "_upload")
    coming = coming.withColumn("period", fn.period(fn.event_time(F.col("measured_at_local"), F.col("start_at"))))
    staged: list[str] = []

    def change(rows: DataFrame) -> tuple[DataFrame, set[str], int]:
        placed = _merged(parsed(rows).join(coming.select("period").distinct(), "period", "left_semi"), coming)
        staged.append(f"{root}/staged-{uuid.uuid4().hex}")
        placed.write.parquet(staged[-1])
        placed = spark.read.schema(placed.schema).parquet(staged[-1])
        n = {r.period: r.n for r in placed.where("_new").groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a month
        return placed.where(F.col("period").isin(list(n))).select("raw", "place", "period"), set(n), sum(n.values())

    try:
        return _attempted(spark, root, change)
    finally:
        for path in staged:
            commits.remove(spark, path)


def _merged(stored: DataFrame, coming: DataFrame) -> DataFrame:
    """(raw, place, period, _new): parsed records of months after a merge, in order."""
    both = stored.withColumn("_incoming", F.lit(False)).unionByName(coming.withColumn("_incoming", F.lit(True)))
    keyed = both.withColumn("_seq", F.struct("_incoming", "place")).withColumn("_id", F.to_json(F.struct("period", "id")))
    upload = merge.upload_key(F.col("kind"), F.col("source.type"), F.col("source.filename"))
    keyed = keyed.withColumn("_upload", F.when(upload.isNotNull(), F.concat("period", F.lit("/"), upload)))
    after = merge.merged(keyed, ["_id", "_upload"], "_seq", "_incoming")
    before = stored.groupBy("period", "id").agg(F.min_by("raw", "place").alias("_stored"))
    marked = after.join(before, ["period", "id"], "left").withColumn("_new", F.col("_incoming") & (F.col("_stored").isNull() | ~fn.canonical_json(F.col("raw")).eqNullSafe(fn.canonical_json(F.col("_stored")))))
    order = ["period", fn.event_time(F.col("measured_at_local"), F.col("start_at")), "id", "_seq"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("raw", F.monotonically_increasing_id().alias("place"), "period", "_new")  # rises with the ranges


def month_of_id(id_: Column) -> Column:
    """The one month that a delete looks in: the first year and month in the id; null if none."""
    return fn.blank_to_null(F.regexp_extract(id_, r"\d{4}-\d{2}", 0))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (id, period, ...) without those of ids (id) in the month that their id names, or in any
    month if it names none. The same id in another month stays."""
    named = ids.select(F.col("id").alias("_gone"), month_of_id(F.col("id")).alias("_month")).distinct()
    return rows.join(named, (rows["id"] == named["_gone"]) & (named["_month"].isNull() | (named["_month"] == rows["period"])), "left_anti")


def delete_ids(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """Remove the records that `without` removes; how many there were."""

    def change(stored: DataFrame) -> tuple[DataFrame, set[str], int]:
        rows = parsed(stored)
        left = without(rows, ids)
        count = lambda rows: {r.period: r.n for r in rows.groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731  a row a month
        was, now = count(rows), count(left)
        touched = {m for m, n in was.items() if now.get(m, 0) < n}
        return left.where(F.col("period").isin(list(touched))).select("raw", "place", "period"), touched, sum(was.values()) - sum(now.values())

    return _attempted(spark, root, change)


def delete(spark: SparkSession, root: str, id_: str) -> bool:
    """Remove a record from the month that its id names; whether it was there."""
    return delete_ids(spark, root, spark.createDataFrame([(id_,)], "id string")) > 0


def clear(spark: SparkSession, root: str) -> int:
    """Remove all records; how many there were."""
    return _attempted(spark, root, lambda rows: (rows.limit(0), {r.period for r in rows.select("period").distinct().collect()}, rows.count()))


def vacuum(spark: SparkSession, root: str, keep_ms: int = 7 * 24 * 3_600_000) -> int:
    """Remove folders of data that the newest version doesn't refer to and that nothing was added
    to for keep_ms, longer than any write or read takes; how many."""
    used = {folder.split("/")[1] for folder in commits.newest(spark, root).months.values()}
    old = time.time() * 1000 - keep_ms
    gone = [name for name, changed in commits.children(spark, _data(root)).items() if name not in used and changed <= old]
    for name in gone:
        commits.remove(spark, f"{_data(root)}/{name}")
    return len(gone)


def export_lines(spark: SparkSession, root: str, target: str) -> None:
    """All records as JSON lines, oldest first."""
    all_logs(spark, root).orderBy("event_time", "id").select("raw").write.mode("overwrite").text(target)
