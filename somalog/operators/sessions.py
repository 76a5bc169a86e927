"""Statistics of sessions from the samples attached to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somalog.functions.scalars import round1


def distinct_samples(matched: DataFrame, session: str, at: str, end_at: str | None, value: str) -> DataFrame:
    """One row for each different sample of a session; an end equal to the start is none."""
    end = F.when(F.col(end_at) != F.col(at), F.col(end_at)) if end_at else F.lit(None).cast("string")
    return matched.select(session, F.col(at).alias("at"), end.alias("end_at"), F.col(value).alias("value")).where(F.col("value").isNotNull()).dropDuplicates([session, "at", "end_at", "value"])


def statistics(samples: DataFrame, session: str) -> DataFrame:
    """(session, n, average, least, most) of distinct samples, to one decimal. Values are summed as
    decimals of six places, so the order in which they arrive does not matter."""
    average = F.sum(F.col("value").cast("decimal(20,6)")).cast("double") / F.count("value")
    return samples.groupBy(session).agg(F.count("value").alias("n"), round1(average).alias("average"), round1(F.min("value")).alias("least"), round1(F.max("value")).alias("most"))


def ordered(samples: DataFrame, session: str) -> DataFrame:
    """(session, samples): an array of (at, bpm, end_at) in order of time, end and value."""
    item = F.struct("at", F.coalesce("end_at", F.lit("")).alias("e"), "value")
    whole = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["at"].alias("at"), x["value"].alias("bpm"), F.when(x["e"] != "", x["e"]).alias("end_at")))
    return samples.groupBy(session).agg(whole.alias("samples"))


def distinct_sum(samples: DataFrame, session: str) -> DataFrame:
    """(session, total): the sum of distinct samples, to one decimal."""
    return samples.groupBy(session).agg(round1(F.sum(F.col("value").cast("decimal(20,6)")).cast("double")).alias("total"))


def declared_or(declared: Column, computed: Column) -> Column:
    """A declared statistic as it is, else the computed one."""
    return F.coalesce(declared, computed)


def review_summary(logs: DataFrame, start: str, average: str, n_samples: str) -> DataFrame:
    """One row: how many logs, their first and last start, how many have an average and samples,
    and how many samples there are."""
    return logs.agg(
        F.count(F.lit(1)).alias("n_logs"),
        F.min(start).alias("first_start"),
        F.max(start).alias("last_start"),
        F.count(average).alias("n_with_average"),
        F.count_if(F.col(n_samples) > 0).alias("n_with_samples"),
        F.coalesce(F.sum(n_samples), F.lit(0)).cast("long").alias("n_samples"),
    )


def completeness(columns: Sequence[Column]) -> Column:
    """The share of values that are there."""
    total = columns[0].isNotNull().cast("int")
    for c in columns[1:]:
        total = total + c.isNotNull().cast("int")
    return total / F.lit(float(len(columns)))
