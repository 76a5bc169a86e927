"""As-of containment join: each sample goes to the session that started last, if it still runs.

Only the last start matters, not how long sessions run, so samples and sessions are sorted by
time together, inside chunks of time of an entity, and every sample takes the last session before it
there. Where a chunk has none before the sample, it is the last session of an earlier chunk, which a
table with a row a chunk carries over. So a session is one row, whatever its length; a sample is
shuffled once; and no task holds all of an entity, be it one that has most rows, or the only one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def with_next_start(sessions: DataFrame, by: Sequence[str], start: str, order: str, chunk_ms: int = 24 * HOUR) -> DataFrame:
    """sessions and next_start, the start of the session after it (null for the last).

    Sessions are ordered inside chunks of time, and a table with a row a chunk carries the first
    start of the chunk after it, so that no window holds all sessions of an entity.
    """
    keys = [*by, "_chunk"]
    chunked = sessions.withColumn("_chunk", F.floor(F.col(start) / chunk_ms))
    firsts = chunked.groupBy(*keys).agg(F.min(start).alias("_first"))
    later = Window.partitionBy(*by).orderBy("_chunk") if by else Window.orderBy("_chunk")
    firsts = firsts.withColumn("_later", F.lead("_first").over(later)).drop("_first")
    inside = Window.partitionBy(*keys).orderBy(start, order)
    return chunked.join(firsts, keys).withColumn("next_start", F.coalesce(F.lead(start).over(inside), F.col("_later"))).drop("_chunk", "_later")


def attach(samples: DataFrame, sessions: DataFrame, by: Sequence[str], at: str, start: str, end: str, order: str, tolerance_ms: int = 1000, chunk_ms: int = HOUR) -> DataFrame:
    """Inner join of samples to the last session with start <= at, if at <= end + tolerance.

    Times are milliseconds. Ties of starts go to the greatest `order`. A session that started
    earlier and runs longer is not considered. Names must not clash but for `by`.
    """
    known = lambda rows, *names: rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, *names)))
    packed = lambda rows: F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in by))
    begun = known(sessions, start, end).select(*by, F.col(start).alias("_t"), F.col(order).alias("_o"), packed(sessions).alias("_session"))
    taken = known(samples, at).select(*by, F.col(at).alias("_t"), packed(samples).alias("_sample"))
    both = taken.unionByName(begun, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col("_t") / chunk_ms))
    keys = [*by, "_chunk"]

    lasts = both.groupBy(*keys).agg(F.max_by("_session", F.when(F.col("_session").isNotNull(), F.struct("_t", "_o"))).alias("_last"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    carried = lasts.select(*keys, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))

    sofar = Window.partitionBy(*keys).orderBy("_t", F.col("_session").isNull(), "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_session", ignorenulls=True).over(sofar)).where("_sample IS NOT NULL")
    found = seen.join(carried, keys).select(*by, "_sample", F.coalesce("_seen", "_carried").alias("_session"))
    return found.where(F.col(f"_sample.{at}") <= F.col(f"_session.{end}") + tolerance_ms).select(*by, "_sample.*", "_session.*")
