"""Computations over rasters and page layouts: histograms, runs, clusters, words to lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, by: Sequence[str], bin_: Column) -> DataFrame:
    """(by, bin, n)"""
    return rows.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentile(bins: DataFrame, by: Sequence[str], fraction: float) -> DataFrame:
    """(by, percentile): the first bin at which the running count reaches the fraction."""
    upto, all_ = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    reached = bins.withColumn("_seen", F.sum("n").over(upto)).withColumn("_total", F.sum("n").over(all_)).where(F.col("_seen") >= F.col("_total") * fraction)
    return reached.groupBy(*by).agg(F.min("bin").alias("percentile"))


def median(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.median(value).alias("median"))


def dominant_cluster(rows: DataFrame, by: Sequence[str], value: str, order: str, tolerance: float) -> DataFrame:
    """(by, position, cluster_size, sample_size): the median of the first value's neighbourhood
    that is largest; only with 3 members and a quarter of the values at least.

    Neighbours are counted with a range frame, not with a self join.
    """
    keys, reach = ", ".join(f"`{k}`" for k in by), f"{float(tolerance)!r}D"
    near = F.expr(f"count(1) OVER (PARTITION BY {keys} ORDER BY CAST(`{value}` AS DOUBLE) RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)")
    counted = rows.withColumn("_size", near).withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    best = counted.groupBy(*by).agg(F.max(F.struct(F.col("_size"), (-F.col(order)).alias("o"), F.col(value).alias("centre"))).alias("b"), F.max("_total").alias("sample_size"))
    best = best.where((F.col("b._size") >= 3) & (F.col("b._size") >= 0.25 * F.col("sample_size")))
    members = rows.hint("merge").join(best, list(by)).where(F.col(value).between(F.col("b.centre") - float(tolerance), F.col("b.centre") + float(tolerance)))
    return members.groupBy(*by).agg(F.median(value).alias("position"), F.count(F.lit(1)).alias("cluster_size"), F.max("sample_size").alias("sample_size"))


def smoothed_fraction(rows: DataFrame, by: Sequence[str], x: str, flag: Column, reach: int = 4) -> DataFrame:
    """rows and fraction: the share of flags among the rows within reach, clipped at the ends."""
    frame = Window.partitionBy(*by).orderBy(x).rowsBetween(-reach, reach)
    return rows.withColumn("fraction", F.avg(flag.cast("double")).over(frame))


def runs(points: DataFrame, by: Sequence[str], x: str, max_gap: int = 0, least: int = 1) -> DataFrame:
    """(by, run_start, run_end, n): maximal runs of places with at most max_gap missing between
    neighbours, of a length (end - start + 1) of `least` at least."""
    order = Window.partitionBy(*by).orderBy(x)
    new = (F.col(x) - F.lag(x).over(order) > max_gap + 1).cast("int")
    marked = points.dropDuplicates([*by, x]).withColumn("_run", F.sum(F.coalesce(new, F.lit(1))).over(order))
    found = marked.groupBy(*by, "_run").agg(F.min(x).alias("run_start"), F.max(x).alias("run_end"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("run_end") - F.col("run_start") + 1 >= least).drop("_run")


WORDS = "page string, row int, place int, text string"


def _plain_rows(top: np.ndarray, bottom: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word of a page, in order of the first words, and the centres of the rows."""
    height = np.maximum(bottom - top, 1.0)
    typical, row_of = float(np.median(height)), np.zeros(len(top), int)
    band = np.zeros((0, 4))  # of each row: top, bottom, sum of centres, words
    for k in range(len(top)):
        gap = np.abs(centre[k] - band[:, 2] / band[:, 3])
        low = np.minimum(height[k], np.maximum(band[:, 1] - band[:, 0], 1.0))
        share = np.maximum(np.minimum(bottom[k], band[:, 1]) - np.maximum(top[k], band[:, 0]), 0) / low
        fits = (gap <= np.maximum(max(4.0, 0.85 * typical), 0.7 * low)) | (share >= 0.35)
        if fits.any():
            row_of[k] = at = int(np.argmin(np.where(fits, gap - share * typical * 0.4, np.inf)))
            band[at] = min(band[at, 0], top[k]), max(band[at, 1], bottom[k]), band[at, 2] + centre[k], band[at, 3] + 1
        else:
            row_of[k] = len(band)
            band = np.vstack([band, [top[k], bottom[k], centre[k], 1]])
    return row_of, band[:, 2] / band[:, 3]


def rows_of(top: np.ndarray, bottom: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, but a word is held only against rows that it or a later word may still fit: words
    come in order of their centres, so a row that lies above all that follow is over."""
    if not (np.isfinite(top).all() and np.isfinite(bottom).all()):
        return _plain_rows(top, bottom, centre)
    height = np.maximum(bottom - top, 1.0)
    typical = float(np.median(height))
    near = max(4.0, 0.85 * typical)
    highest, tallest = np.minimum.accumulate(top[::-1])[::-1], np.maximum.accumulate(height[::-1])[::-1]
    far = np.maximum(near, 0.7 * tallest)
    row_of, rows, still = [], [], []  # of each row: top, bottom, sum of centres, words, place
    for t, b, c, h, first, reach in zip(*(x.tolist() for x in (top, bottom, centre, height, highest, far)), strict=True):
        best, home, over = 0.0, None, False
        for row in still:
            r_top, r_bottom, total, n, _ = row
            tall = r_bottom - r_top
            tall = tall if tall > 1.0 else 1.0
            low = h if h < tall else tall
            gap = abs(c - total / n)
            share = (b if b < r_bottom else r_bottom) - (t if t > r_top else r_top)
            share = share / low if share > 0 else 0.0
            if gap <= near or gap <= 0.7 * low or share >= 0.35:
                merit = gap - share * typical * 0.4
                if home is None or merit < best:
                    best, home = merit, row
            elif r_bottom <= first and c - total / n > reach:
                row[4], over = -1 - row[4], True
        if over:
            still = [row for row in still if row[4] >= 0]
        if home is None:
            home = [t, b, c, 1, len(rows)]
            rows.append(home)
            still.append(home)
        else:
            home[0], home[1], home[2], home[3] = min(home[0], t), max(home[1], b), home[2] + c, home[3] + 1
        row_of.append(home[4])
    return np.array(row_of, int), np.array([row[2] / row[3] for row in rows])


WORDS = "page string, row int, place int, text string"


def _set_in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words of whole pages, page by page; of a batch's last page the rest may follow."""

    def pages(table: pa.Table, starts: np.ndarray) -> list[pa.RecordBatch]:
        left, top, bottom = (table[c].to_numpy() for c in ("left", "top", "bottom"))
        order, rows, places = [], [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            row_of, centre = rows_of(top[a:b], bottom[a:b], (top[a:b] + bottom[a:b]) / 2)
            row = np.argsort(np.argsort(centre, kind="stable"), kind="stable")[row_of]
            by = np.lexsort((left[a:b], row))
            row = row[by]
            new = np.concatenate(([0], np.nonzero(np.diff(row))[0] + 1))
            order.append(by + a)
            rows.append(row)
            places.append(np.arange(b - a) - np.repeat(new, np.diff(np.append(new, b - a))))
        found = table.select(["page", "text"]).take(pa.array(np.concatenate(order))).combine_chunks()
        cells = [found["page"].cast(pa.string()), pa.array(np.concatenate(rows), pa.int32()), pa.array(np.concatenate(places), pa.int32()), found["text"].cast(pa.string())]
        return pa.Table.from_arrays(cells, names=["page", "row", "place", "text"]).combine_chunks().to_batches()

    rest: list[pa.RecordBatch] = []
    for batch in _and_end(batches):
        if batch is not None:
            rest.append(batch)
            ends = batch.column("page")
            if ends[0] == ends[-1] and rest[0].column("page")[0] == ends[0]:
                continue  # all of one page so far
        if not rest:
            continue
        table = pa.Table.from_batches(rest)
        codes = table["page"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.nonzero(np.diff(codes))[0] + 1, [len(codes)]))
        if batch is not None:
            starts = starts[:-1]
        if len(starts) > 1:
            yield from pages(table.slice(0, starts[-1]), starts)
        rest = table.slice(starts[-1]).to_batches()


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (batch for batch in batches if batch.num_rows)
    yield None


def words_to_rows(words: DataFrame) -> DataFrame:
    """(page, row, place, text) from words (page, text, left, right, top, bottom).

    Words come in order of their centre, then left; each joins the row whose running centre is
    near or whose band it overlaps, and else starts one. The fold depends on order: Spark sorts the
    words by page, and a task holds one page and a batch; a page holds a bounded number of words.
    """
    none = F.lit(float("nan"))
    boxes = words.select(F.col("page").cast("string").alias("page"), "text", *(F.coalesce(F.col(c).cast("double"), none).alias(c) for c in ("left", "top", "bottom")))
    return boxes.repartition("page").sortWithinPartitions("page", (F.col("top") + F.col("bottom")) / 2, "left").mapInArrow(_set_in_rows, WORDS)
