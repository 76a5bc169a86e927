"""Health export XML, plain or in a ZIP, to workout logs.

Columns are read as text: inference would drop time offsets. Workouts and records are two reads
of one file by row tag; the filter on types runs right after each.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.functions import scalars as fn
from somalog.operators import asof, sessions

STRENGTH = "HKWorkoutActivityTypeTraditionalStrengthTraining"
HEART_RATE, ENERGY = "HKQuantityTypeIdentifierHeartRate", "HKQuantityTypeIdentifierActiveEnergyBurned"


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(f"_{name}", T.StringType()) for name in names]


RECORD = T.StructType(_texts("type", "sourceName", "unit", "startDate", "endDate", "value"))
WORKOUT = T.StructType(
    [
        *_texts("workoutActivityType", "duration", "durationUnit", "startDate", "endDate", "totalEnergyBurned", "totalEnergyBurnedUnit"),
        T.StructField("WorkoutStatistics", T.ArrayType(T.StructType(_texts("type", "average", "minimum", "maximum", "sum", "unit")))),
    ]
)


def read_tag(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    """Elements of one tag, at any depth. A file is one partition; it is dealt out after the read."""
    return spark.read.format("xml").option("rowTag", tag).option("valueTag", "_text").schema(schema).load(path)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(zip, name, size, method, rank): the export files of each ZIP, the one to read first."""
    schema = pa.schema([("zip", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("method", pa.int32())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for zip_, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(BytesIO(content.as_py())) as z:
                    rows += [(zip_, i.filename, i.file_size, i.compress_type) for i in z.infolist()]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else ((),) * 4, schema, strict=True)], schema=schema)

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(listed, "zip string, name string, size long, method int")
    best = F.struct(F.when(F.lower("name").endswith("apple_health_export/export.xml"), 0).otherwise(1).alias("a"), F.length("name").alias("b"), F.col("name").alias("c"))
    ranked = found.where(F.col("name").rlike(r"(?i)(^|/)export\.xml\z")).groupBy("zip").agg(F.min_by(F.struct("name", "size", "method"), best).alias("m"))
    return ranked.select("zip", "m.*")


def unzip(spark: SparkSession, path: str, target: str) -> str:
    """Write the chosen export of each ZIP as XML files into a folder, a chunk at a time; its path.
    A ZIP cannot be split, so one task reads one file; stored and deflated members are read."""
    from pyarrow import fs

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(target if "://" in target or target.startswith("file:") else f"file://{target}")
        files.create_dir(folder, recursive=True)
        for batch in rows:
            done = []
            for zip_, name, content in zip(batch.column("zip").to_pylist(), batch.column("name").to_pylist(), batch.column("content"), strict=True):
                out = f"{folder}/{hashlib.sha256(zip_.encode()).hexdigest()[:24]}.xml"
                with zipfile.ZipFile(BytesIO(content.as_py())) as z, z.open(name) as source, files.open_output_stream(out) as sink:
                    while chunk := source.read(1 << 20):
                        sink.write(chunk)
                done.append(out)
            yield pa.record_batch([pa.array(done, pa.string())], names=["file"])

    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("zip"), "content")
    if not whole.join(zip_members(spark, path), "zip").select("zip", "name", "content").mapInArrow(write, "file string").count():
        raise ValueError(f"no export.xml in {path}")
    return target


def workouts(elements: DataFrame, activity: str = STRENGTH) -> DataFrame:
    """Session rows of one activity: times as text and milliseconds, minutes, energy, and what
    the element's own statistics declare. The last statistic of a kind counts."""
    stats = F.coalesce("WorkoutStatistics", F.array().cast(WORKOUT["WorkoutStatistics"].dataType))
    last = lambda kind, test=None: F.try_element_at(F.filter(stats, lambda s: (s["_type"] == kind) & (test(s) if test else F.lit(True))), F.lit(-1))
    kcal = lambda unit: fn.unit_matches(unit, "kcal", "kcal")
    own = F.when(kcal(F.col("_totalEnergyBurnedUnit")), fn.number(F.col("_totalEnergyBurned")))
    child = last(ENERGY, lambda s: fn.number(s["_sum"]).isNotNull() & kcal(s["_unit"]))
    rate = last(HEART_RATE, lambda s: fn.unit_matches(s["_unit"], "count/min|bpm", "bpm"))
    fine = elements.where(F.col("_workoutActivityType") == activity)
    return fine.select(
        F.monotonically_increasing_id().alias("pos"),
        fn.export_time(F.col("_startDate")).alias("start_at"),
        fn.export_time(F.col("_endDate")).alias("end_at"),
        fn.epoch_ms(F.col("_startDate")).alias("start_ms"),
        fn.epoch_ms(F.col("_endDate")).alias("end_ms"),
        fn.minutes(fn.number(F.col("_duration")), F.col("_durationUnit")).alias("duration_minutes"),
        F.coalesce(fn.number(child["_sum"]), own).alias("declared_kcal"),
        F.when(rate.isNotNull(), F.struct(fn.number(rate["_average"]).alias("average_bpm"), fn.number(rate["_minimum"]).alias("min_bpm"), fn.number(rate["_maximum"]).alias("max_bpm"))).alias("declared_bpm"),
    ).where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())


def records(elements: DataFrame) -> DataFrame:
    """Sample rows of the two kinds that sessions take, with units they are understood in."""
    unit = F.col("_unit")
    fits = F.when(F.col("_type") == HEART_RATE, fn.unit_matches(unit, "count/min|bpm", "bpm")).when(F.col("_type") == ENERGY, fn.unit_matches(unit, "kcal", "kcal"))
    rows = elements.where(F.col("_type").isin(HEART_RATE, ENERGY)).where(fits)
    return rows.select(F.col("_type").alias("kind"), fn.export_time(F.col("_startDate")).alias("at"), fn.export_time(F.col("_endDate")).alias("end"), fn.epoch_ms(F.col("_startDate")).alias("at_ms"), fn.number(F.col("_value")).alias("value")).where(F.col("at_ms").isNotNull() & F.col("value").isNotNull())


def workout_logs(session_rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Finished workout records: sessions without samples stay; declared statistics come first."""
    matched = asof.attach(samples, session_rows.select("pos", "start_ms", "end_ms"), [], "at_ms", "start_ms", "end_ms", "pos")
    rate = sessions.distinct_samples(matched.where(F.col("kind") == HEART_RATE), "pos", "at", "end", "value")
    burned = matched.where(F.col("kind") == ENERGY).select("pos", "at", F.col("end").alias("end_at"), "value").distinct()
    stats, arrays = sessions.statistics(rate, "pos"), sessions.ordered(rate, "pos")
    joined = session_rows.join(stats.join(arrays, "pos"), "pos", "left").join(sessions.distinct_sum(burned, "pos"), "pos", "left")
    declared: Column = F.col("declared_bpm")
    none = F.array().cast("array<struct<at:string,bpm:double,end_at:string>>")
    heart = F.when(
        declared.isNotNull() | F.col("n").isNotNull(),
        F.struct(
            F.coalesce(declared["average_bpm"], "average").alias("average_bpm"),
            F.coalesce(declared["min_bpm"], "least").alias("min_bpm"),
            F.coalesce(declared["max_bpm"], "most").alias("max_bpm"),
            F.coalesce("samples", none).alias("samples"),
        ),
    )
    return joined.select(
        F.lit(1).alias("schema_version"),
        F.concat(F.lit("apple-health:strength:"), "start_at").alias("id"),
        F.lit("workout").alias("kind"),
        F.lit("traditional_strength_training").alias("workout_type"),
        "start_at",
        "end_at",
        "duration_minutes",
        sessions.declared_or(F.col("declared_kcal"), F.col("total")).alias("active_energy_kcal"),
        heart.alias("heart_rate_bpm"),
        F.struct(F.lit("apple_health").alias("type")).alias("source"),
    )


def import_xml(spark: SparkSession, path: str) -> DataFrame:
    """The workout logs of export XML."""
    found = workouts(read_tag(spark, path, "Workout", WORKOUT))
    samples = records(read_tag(spark, path, "Record", RECORD)).repartition("at_ms")
    return workout_logs(found, samples)


def import_zip(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """The workout logs of an export ZIP; its XML is unpacked into the folder scratch."""
    return import_xml(spark, unzip(spark, path, scratch))
