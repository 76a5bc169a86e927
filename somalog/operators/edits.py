"""Records read and edited by path, as columns: nested fields are structs.

A path names nested fields with dots between them; a dot between two digits belongs to a name
(`bioelectrical.6.25_khz.r_ohm`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.functions.scalars import blank_to_null, coerced, number
from somalog.operators import indicators

BODY = "body_composition"
#: What ids of measurements begin with (fixed values).
ID_PREFIX = {"accuniq_report": "accuniq"}
OTHER_PREFIX = "tanita"


def path_parts(path: str) -> list[str]:
    return re.split(r"(?<!\d)\.|\.(?!\d)", path)


def get_path(record: Column, path: str) -> Column:
    """The value at a path of structs or maps; null where a parent is."""
    for part in path_parts(path):
        record = record.getField(part)
    return record


def set_paths(record: Column, of: T.DataType, edits: dict[str, tuple[Column, Column]]) -> Column:
    """record, of type `of`, with new values: edits are path to (value, whether it is set here).
    Parents that are missing are made, and those that are no structs are replaced; a parent that
    is null stays null in rows that set nothing in it. All paths go in one pass over the fields."""
    tree: dict = {}
    for path, edit in edits.items():
        *parents, leaf = path_parts(path)
        at = tree
        for part in parents:
            at = at.setdefault(part, {})
        at[leaf] = edit

    def built(old: Column | None, have: T.DataType | None, new) -> tuple[Column, Column]:
        if not isinstance(new, dict):
            value, here = new
            same = have is not None and not isinstance(have, T.StructType)
            return F.when(here, value.cast(have) if same else value).otherwise(old if same else F.lit(None)), here
        known = {f.name: f.dataType for f in have.fields} if isinstance(have, T.StructType) else {}
        parts, here = [], F.lit(False)
        for name in [*known, *(n for n in new if n not in known)]:
            child = old.getField(name) if name in known else None
            if name in new:
                child, touched = built(child, known.get(name), new[name])
                here = here | touched
            parts.append(child.alias(name))
        stays = old.isNotNull() if known else F.lit(False)
        return F.when(here | stays, F.struct(*parts)), here

    return built(record, of, tree)[0]


def body_id(source_type: Column, measured_at: Column) -> Column:
    """The id of a body measurement, from its time; null without one."""
    prefixes = F.create_map(*(F.lit(x) for pair in ID_PREFIX.items() for x in pair))
    prefix = F.coalesce(F.try_element_at(prefixes, source_type), F.lit(OTHER_PREFIX))
    return F.concat(prefix, F.lit(":"), blank_to_null(measured_at))


def edited(logs: DataFrame, edits: DataFrame, fields: dict[str, str], form: bool = False) -> DataFrame:
    """logs (id, kind, source struct<type>, measured_at_local, ...) after edits (id, path, value,
    place): texts by path, of which the one of largest place counts; and replaced_id, the stored
    id to delete where the id changed, and error, why a row must not be saved.

    fields: path to kind (text, number, boolean, json); paths that are no fields are ignored.
    form: as the form of a new measurement has it, where blank is null and a time is required.
    A reading that changed is marked as reviewed (see indicators.normalized). Logs without edits
    pass; edits of unknown ids do nothing. An edit's number that is none is an error of the row.
    """
    last = edits.where(F.col("path").isin(*fields)).groupBy("id", "path").agg(F.max_by("value", "place").alias("value"))
    given = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_edits"))
    value = lambda path: F.try_element_at("_edits", F.lit(path))
    here = lambda path: F.coalesce(F.map_contains_key("_edits", F.lit(path)), F.lit(False))
    wrong = lambda path: here(path) & (F.trim(value(path)) != "") & number(value(path)).isNull()

    def new(path: str, kind: str) -> tuple[Column, Column]:
        text = F.when(F.trim(value(path)) != "", F.trim(value(path))) if form else value(path)
        set_here = here(path) & ~wrong(path) if kind == "number" else here(path)
        return number(text) if kind == "number" else F.when(text.isNotNull(), coerced(text, kind)), set_here

    record = F.struct(*(F.col(f"`{c}`") for c in logs.columns))
    after = logs.join(given, "id", "left").select(
        record.alias("_old"),
        set_paths(record, logs.schema, {p: new(p, k) for p, k in fields.items()}).alias("_new"),
        F.coalesce(*(F.when(wrong(p), F.concat(F.lit("Invalid number: "), value(p))) for p, k in fields.items() if k == "number"), F.lit(None).cast("string")).alias("_error"),
        F.col("_edits").isNotNull().alias("_edited"),
    )
    found = after.select("_new.*", "_old", "_error", "_edited")
    if "indicators" in logs.columns:
        found = found.withColumn("indicators", F.when(F.col("_edited"), indicators.normalized(F.col("indicators"), F.col("_old.indicators"))).otherwise(F.col("indicators")))
    body = F.coalesce(F.col("kind") == BODY, F.lit(False)) & F.col("_edited")
    named = F.when(body, body_id(F.col("source.type"), F.col("measured_at_local")))
    untimed = F.when(body & F.lit(form) & named.isNull(), F.lit("Measured at is required before saving."))
    found = found.withColumn("id", F.coalesce(named, "id")).withColumn("error", F.coalesce("_error", untimed))
    changed = F.when(F.col("id") != F.col("_old.id"), F.col("_old.id"))
    return found.withColumn("replaced_id", changed).drop("_old", "_error", "_edited")
