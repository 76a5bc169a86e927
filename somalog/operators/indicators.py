"""Indicators of a measurement: readings that a person reviewed are kept when it is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somalog.functions import scalars as fn

NAMES = ("fat_percent", "bmi", "muscle_mass", "bmr")
MANUAL, GRAPH = "manual_review", "indicator_graph"
INDICATOR = "struct<level:string,section_percent:int,reading:string,position:double,confidence:double,source:string,locator:string>"


def was_reviewed(name: Column, indicator: Column) -> Column:
    """True for a stored indicator that a person set: it says so, or its reading is not the one
    that its position on the graph gives."""
    given = fn.parsed_reading(indicator["reading"], "round")
    drawn = fn.position_reading(name, indicator["position"])["reading"]
    moved = (indicator["source"] == GRAPH) & indicator["position"].isNotNull() & (drawn != fn.reading(given["level"], given["percent"]))
    return F.coalesce(given.isNotNull() & ((indicator["source"] == MANUAL) | moved), F.lit(False))


def carried_over(logs: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """logs (key, indicators map<string, indicator>, ...) with the stored indicators of the same
    key, if any of them was reviewed: then all that can be read replace the new ones, without
    position, confidence and locator."""
    old = stored.select(key, F.col("indicators").cast(f"map<string,{INDICATOR}>").alias("_old"))
    readable = F.map_filter("_old", lambda k, v: k.isin(*NAMES) & fn.parsed_reading(v["reading"], "round").isNotNull())
    reviewed = F.exists(F.map_entries(readable), lambda e: was_reviewed(e["key"], e["value"]))

    def kept(name: Column, v: Column) -> Column:
        given = fn.parsed_reading(v["reading"], "round")
        parts = (given["level"].alias("level"), given["percent"].alias("section_percent"), fn.reading(given["level"], given["percent"]).alias("reading"))
        return F.struct(*parts, F.lit(None).cast("double").alias("position"), F.lit(None).cast("double").alias("confidence"), F.lit(MANUAL).alias("source"), F.lit(None).cast("string").alias("locator"))

    new = F.coalesce(F.col("indicators").cast(f"map<string,{INDICATOR}>"), F.create_map().cast(f"map<string,{INDICATOR}>"))
    carried = F.transform_values(readable, kept)
    both = F.map_concat(F.map_filter(new, lambda k, v: ~F.array_contains(F.map_keys(carried), k)), carried)
    columns = [c for c in logs.columns if c != "indicators"]
    return logs.join(old, key, "left").select(*columns, F.when(F.coalesce(reviewed, F.lit(False)), both).otherwise(F.col("indicators").cast(f"map<string,{INDICATOR}>")).alias("indicators"))


def normalized(of: Column, original: Column) -> Column:
    """A map of indicators whose readings are written in steps of five; one whose reading is not
    the original's is marked as reviewed and loses position, confidence and locator. Null
    original: nothing is marked. Readings that are none, and other names, stay as they are."""

    def one(name: Column, v: Column) -> Column:
        given = fn.parsed_reading(v["reading"], "round")
        text = fn.reading(given["level"], given["percent"])
        moved = original.isNotNull() & ~text.eqNullSafe(F.try_element_at(original, name)["reading"])
        kept = lambda field, kind: F.when(~moved, v[field]).cast(kind).alias(field)
        parts = (given["level"].alias("level"), given["percent"].cast("int").alias("section_percent"), text.alias("reading"), kept("position", "double"), kept("confidence", "double"))
        new = F.struct(*parts, F.when(moved, F.lit(MANUAL)).otherwise(v["source"]).alias("source"), kept("locator", "string"))
        return F.when(name.isin(*NAMES) & given.isNotNull(), new).otherwise(v)

    return F.transform_values(of.cast(f"map<string,{INDICATOR}>"), one)


def attached(logs: DataFrame, detected: str, fat: Column, fat_min: Column, fat_max: Column) -> DataFrame:
    """logs (indicators, warnings array<string>, review_fields array<string>, ...) with detected
    indicators put over theirs, every reading up for review, and a warning where the fat value is
    in its range but its indicator is not at level 0, or the other way round."""
    empty = F.create_map().cast(f"map<string,{INDICATOR}>")
    seen = F.coalesce(F.col(detected).cast(f"map<string,{INDICATOR}>"), empty)
    own = F.map_filter(F.coalesce(F.col("indicators").cast(f"map<string,{INDICATOR}>"), empty), lambda k, v: ~F.map_contains_key(seen, k))
    level = F.try_element_at(seen, F.lit("fat_percent"))["level"]
    disagree = F.coalesce(fat.between(fat_min, fat_max) != (level == "0"), F.lit(False))
    none = F.array().cast("array<string>")
    warning = F.when(disagree, F.array(F.lit("Fat % and the printed FAT % indicator disagree; review the value."))).otherwise(none)
    review = F.array(*(F.lit(f"indicators.{name}.reading") for name in NAMES))
    columns = [c for c in logs.columns if c not in ("indicators", "warnings", "review_fields", detected)]
    return logs.select(
        *columns,
        F.map_concat(own, seen).alias("indicators"),
        F.array_distinct(F.concat(F.coalesce("warnings", none), warning)).alias("warnings"),
        F.array_distinct(F.concat(F.coalesce("review_fields", F.array(F.lit("measured_at_local"))), review)).alias("review_fields"),
    )
