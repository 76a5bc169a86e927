"""Agreement of several readings of one report, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 0.11
WARNING_WEIGHT = 0.015


def ranked(candidates: DataFrame, key: str, completeness: str, n_warnings: str, place: str) -> DataFrame:
    """candidates and candidate_rank, from 1: the most complete with the fewest warnings first."""
    merit = F.col(completeness) - WARNING_WEIGHT * F.col(n_warnings)
    return candidates.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(key).orderBy(merit.desc(), F.col(place).asc())))


def text_vote(votes: DataFrame, key: list[str], value: str, rank: str, observed: Column) -> DataFrame:
    """(key, value, n_observed, n, conflicted): the text most often observed, case and blanks around
    it aside; then the
    one most often given, then the one of best rank. Written as its best rank has it."""
    spoken = votes.where(F.col(value).isNotNull()).withColumn("_same", F.lower(F.trim(value)))
    groups = spoken.groupBy(*key, "_same").agg(
        F.count_if(observed).alias("n_observed"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(rank, value)).alias("_first"),
    )
    by_merit = F.max(F.struct("n_observed", "n", (-F.col(f"_first.{rank}")).alias("r"), F.col(f"_first.{value}").alias("value"))).alias("_b")
    best = groups.groupBy(*key).agg(by_merit, (F.count_if(F.col("n_observed") > 0) > 1).alias("conflicted"))
    return best.select(*key, F.col("_b.value").alias("value"), F.col("_b.n_observed").alias("n_observed"), F.col("_b.n").alias("n"), "conflicted")


def number_vote(votes: DataFrame, key: list[str], value: str, rank: str, observed: str, tolerance: float = TOLERANCE) -> DataFrame:
    """The same for numbers, which agree with a group if they are within tolerance of its first.

    Which group a number joins depends on the order, but equal numbers always join the same one. So
    they are counted first, and what is folded in order of rank is a field's different numbers.
    """
    spoken = votes.where(F.col(value).isNotNull())
    alike = spoken.groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.min(rank).alias("_r"), F.count_if(F.coalesce(observed, F.lit(False))).alias("_o"), F.count(F.lit(1)).alias("_n"))

    def joined(groups: Column, x: Column) -> Column:
        home = F.array_position(F.transform(groups, lambda g: F.abs(g["v"] - x["v"]) <= tolerance), True)
        grown = F.transform(groups, lambda g, i: F.struct(g["v"].alias("v"), *((g[c] + F.when(i == home - 1, x[c]).otherwise(0)).alias(c) for c in "on")))
        return F.when(home > 0, grown).otherwise(F.array_append(groups, F.struct(*(x[c].alias(c) for c in "von"))))

    none = F.array().cast("array<struct<v: double, o: bigint, n: bigint>>")
    folded = alike.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*(F.col(f"_{c}").alias(c) for c in "rvon")))).alias("_a")).select(*key, F.aggregate("_a", none, joined).alias("_g"))
    best = F.array_max(F.transform("_g", lambda g, i: F.struct(g["o"].alias("o"), g["n"].alias("n"), (-i).alias("i"), g["v"].alias("v"))))
    return folded.withColumn("_b", best).select(*key, F.col("_b.v").alias("value"), F.col("_b.o").alias("n_observed"), F.col("_b.n").alias("n"), (F.size(F.filter("_g", lambda g: g["o"] > 0)) > 1).alias("conflicted"))


def best_parse(parses: DataFrame, key: str, completeness: str, place: str) -> DataFrame:
    """The most complete of each key's parses, the first of equals; one aggregate, no window."""
    whole = F.struct(*(F.col(f"`{c}`") for c in parses.columns))
    merit = F.struct(F.coalesce(completeness, F.lit(0.0)).alias("c"), (-F.col(place)).alias("p"))
    return parses.groupBy(key).agg(F.max_by(whole, merit).alias("_best")).select("_best.*")


def path_union(parses: DataFrame, key: str, paths: str, rank: str) -> DataFrame:
    """(key, paths): the paths that any parse of a key lists, in order of rank (without one last) and
    then of their places in the lists; a key has as many parses as a report has readings, a few."""
    item = F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p, i: F.struct(F.col(rank).isNull().alias("last"), F.col(rank).alias("r"), i.alias("i"), p.alias("p")))
    listed = F.array_sort(F.filter(F.flatten(F.collect_list(item)), lambda x: x["p"].isNotNull()))
    return parses.groupBy(key).agg(listed.alias("_l")).select(key, F.array_distinct("_l.p").alias(paths))


#: How complete a parse has to be for its route to end the cascade, by kind of report (fixed values).
EMBEDDED_ENOUGH = {"tanita": 0.9, "accuniq": 0.75}
CLOUD_ENOUGH = {"tanita": 0.75, "accuniq": 0.65}
LEAST_EMBEDDED = 40


def cascade(parses: DataFrame, key: str) -> DataFrame:
    """parses (key, route, source, completeness, n_chars, place, ...) to the parse of each key that
    counts; a key without a usable parse has none.

    The routes are tried in order: embedded text, if it is longer than LEAST_EMBEDDED and complete
    enough; cloud recognition, if complete enough; local recognition, unless the cloud's parse is of
    the same source and more complete; else what the cloud gave.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in parses.columns))
    merit = F.struct(F.coalesce("completeness", F.lit(0.0)).alias("c"), (-F.col("place")).alias("p"))
    best = parses.groupBy(key).agg(*(F.max_by(F.when(F.col("route") == r, whole), F.when(F.col("route") == r, merit)).alias(r) for r in ("embedded", "cloud", "local")))

    def enough(route: str, least: dict[str, float]) -> Column:
        table = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
        return F.coalesce(F.col(f"{route}.completeness") >= F.try_element_at(table, F.col(f"{route}.source")), F.lit(False))

    at_hand = F.coalesce(F.col("embedded.n_chars") > LEAST_EMBEDDED, F.lit(False)) & enough("embedded", EMBEDDED_ENOUGH)
    better = F.coalesce((F.col("cloud.source") == F.col("local.source")) & (F.col("cloud.completeness") > F.coalesce("local.completeness", F.lit(0.0))), F.lit(False))
    chosen = F.when(at_hand, F.col("embedded")).when(enough("cloud", CLOUD_ENOUGH) | better, F.col("cloud")).otherwise(F.coalesce("local", "cloud"))
    return best.select(chosen.alias("_chosen")).where("_chosen IS NOT NULL").select("_chosen.*")
