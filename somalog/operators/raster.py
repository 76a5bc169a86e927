"""Indicator bars of printed receipts, read from images.

An image is a table with a row a line of pixels: (image, y, line), line being one byte of
brightness a pixel, from the left. So a task sees lines, never an image; what needs several lines of
an image is aggregated from what each gives (a histogram, a dark share, a position, a count by
column). Tests of single lines run on arrays of pixels in the tasks.

Below a header line of dark pixels, bars stand at fixed distances. A bar is dark from its left end
up to its value. `indicators` finds bars by the header and by label anchors and reads them by the
position in the line; `refined` finds both ends and the ticks of a bar and reads it between these.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.functions import scalars as fn
from somalog.operators import layout

#: Order of the bars below the header, and how far apart they are (fixed values; None has no reading).
BARS = ("fat_percent", "bmi", None, "muscle_mass", "bmr")
FIRST_BAR, NEXT_BAR = 0.062, 0.225
#: Brightness at these shares of an image's pixels becomes 0 and 255 (fixed values).
DARKEST, BRIGHTEST, LEAST_RANGE = 0.01, 0.985, 10
#: What counts as dark in a header, a bar, a bar of `refined` and its ticks (fixed values).
HEADER_DARK, BAR_DARK, REFINED_DARK, TICK_DARK = 115, 145, 150, 145
HEADER_SHARE, HEADER_LEAST = 0.64, 6
LEAST_WIDTH, LEAST_HEIGHT, WIDTH = 250, 700, 720
#: Labels in the order they are printed in below the heading, and those that have a bar (fixed values).
LABELS = (("fat_percent", r"(?i)(?:^|\s)FAT\s*%"), ("bmi", r"(?i)(?:^|\s)BMI(?:\s|$)"), ("visceral_fat", r"(?i)VISCERAL\s+FAT\s+RATING"), ("muscle_mass", r"(?i)MUSCLE\s+MASS"), ("bmr", r"(?i)(?:^|\s)BMR(?:\s|$)"), ("physique", r"(?i)PHYSIQUE\s+RATING"))
HEADING = r"(?i)\bINDICATOR\b"


def _pixels(line: bytes) -> np.ndarray:
    return np.frombuffer(line, np.uint8)


@F.pandas_udf(T.BinaryType())
def brightness(lines: pd.Series) -> pd.Series:
    """Lines of red, green and blue bytes to lines of brightness."""
    weights = np.array([0.299, 0.587, 0.114])
    return lines.map(lambda x: None if x is None else np.floor(_pixels(x).reshape(-1, 3) @ weights + 0.5).astype(np.uint8).tobytes())


def _with(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side: sizes of exploded or decoded lines are estimated far too
    small, and images would go to the driver."""
    return rows.hint("merge").join(other, on, how)


def cropped(lines: DataFrame, sizes: DataFrame, top: float, bottom: float) -> DataFrame:
    """The lines between two shares of an image's height, numbered anew. sizes: (image, width, height)."""
    first, last = F.floor(F.col("height") * top), F.ceil(F.col("height") * bottom)
    return _with(lines, sizes, "image").where((F.col("y") >= F.greatest(F.lit(0), first)) & (F.col("y") < F.least("height", last))).select("image", (F.col("y") - F.greatest(F.lit(0), first)).alias("y"), "line")


def sizes(lines: DataFrame) -> DataFrame:
    """(image, width, height)"""
    return lines.groupBy("image").agg(F.max(F.length("line")).cast("long").alias("width"), (F.max("y") + 1).cast("long").alias("height"))


def resized(lines: DataFrame, of: DataFrame, width: int = WIDTH) -> DataFrame:
    """Images of more pixels than width across, brought down to it: each pixel is the one at its
    centre. of: (image, width, height)."""

    @F.pandas_udf(T.BinaryType())
    def picked(line: pd.Series, wide: pd.Series) -> pd.Series:
        return pd.Series([_pixels(x)[(np.arange(width) * 2 + 1) * w // (2 * width)].tobytes() if w > width else x for x, w in zip(line, wide, strict=True)])

    rows = _with(lines, of, "image")
    now = F.when(F.col("width") > width, F.floor(F.col("height") * width / F.col("width") + 0.5)).otherwise(F.col("height"))
    # the lines y' whose centre (2 y' + 1) height / (2 now) lies in line y
    first, last = (F.ceil(((F.col("y") + k) * 2 * F.col("_now") / F.col("height") - 1) / 2) for k in (0, 1))
    kept = rows.withColumn("_now", now).withColumn("_at", F.when(last > first, F.sequence(first, last - 1)))
    return kept.where("_at IS NOT NULL").select("image", F.explode("_at").alias("y"), picked("line", "width").alias("line"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image, part in pd.DataFrame({"image": batch.column("image").to_pylist(), "line": batch.column("line").to_pylist()}).groupby("image"):
            n = np.bincount(_pixels(b"".join(part["line"])), minlength=256)
            bins = np.nonzero(n)[0]
            yield pa.record_batch([pa.array([image] * len(bins), batch.schema.field("image").type), pa.array(bins.astype(np.int32)), pa.array(n[bins])], names=["image", "bin", "n"])


def ranges(lines: DataFrame) -> DataFrame:
    """(image, low, high): the brightness that becomes 0, and the one that becomes 255."""
    counts = lines.select("image", "line").mapInArrow(_counted, f"image {lines.schema['image'].dataType.simpleString()}, bin int, n long")
    bins = counts.groupBy("image", "bin").agg(F.sum("n").alias("n"))
    low, high = (layout.histogram_percentile(bins, ["image"], f).withColumnRenamed("percentile", name) for f, name in ((DARKEST, "low"), (BRIGHTEST, "high")))
    return _with(low, high, "image").select("image", "low", F.greatest("high", F.col("low") + LEAST_RANGE).alias("high"))


def _stretched(line: bytes, low: int, high: int) -> np.ndarray:
    return np.clip((_pixels(line).astype(float) - low) * 255 / (high - low), 0, 255)


@F.pandas_udf(T.BinaryType())
def stretched(lines: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Lines with the contrast stretched between low and high."""
    return pd.Series([np.floor(_stretched(*x) + 0.5).astype(np.uint8).tobytes() for x in zip(lines, low, high, strict=True)])


@F.pandas_udf(T.DoubleType())
def _dark_share(lines: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """The share of header-dark pixels of a line, but for its margins."""

    def share(line: bytes, low: int, high: int) -> float:
        n = len(line)
        inside = _stretched(line, low, high)[int(np.floor(n * 0.03)) : int(np.ceil(n * 0.97))]
        return float((inside < HEADER_DARK).sum() / max(1, len(inside)))

    return pd.Series([share(*x) for x in zip(lines, low, high, strict=True)], dtype=float)


def with_model(lines: DataFrame) -> DataFrame:
    """lines of images that are large enough, with width, height, low, high of their image."""
    of = sizes(lines).where((F.col("width") >= LEAST_WIDTH) & (F.col("height") >= LEAST_HEIGHT))
    return _with(lines, _with(of, ranges(lines), "image"), "image")


def header_bands(lines: DataFrame) -> DataFrame:
    """(image, run_start, run_end, n) of with_model's lines: runs of dark lines in the part of an
    image where its header is."""
    y, height = F.col("y"), F.col("height")
    shares = lines.where((y >= F.floor(height * 0.48)) & (y < F.ceil(height * 0.72))).withColumn("share", _dark_share("line", "low", "high"))
    found = layout.runs(shares.where(F.col("share") > HEADER_SHARE).select("image", "y", "width"), ["image", "width"], "y")
    least = F.greatest(F.lit(HEADER_LEAST), F.floor(F.col("width") * 0.008 + 0.5))
    return found.where(F.col("run_end") - F.col("run_start") + 1 >= least).drop("width")


def bar_end(dark: np.ndarray, width: int, reach: int = 4, share: float = 0.52, gap: int = 12) -> float | None:
    """Where a bar that starts at the left ends, as a share of the line; None without one. A pixel
    is of a bar if over `share` of its neighbourhood is dark; runs of five pixels or more that
    follow within `gap` go on with it."""
    n = len(dark)
    upto = np.concatenate(([0], np.cumsum(dark)))
    left, right = np.maximum(0, np.arange(n) - reach), np.minimum(n - 1, np.arange(n) + reach)
    active = (upto[right + 1] - upto[left]) / (right - left + 1) > share
    edge = np.diff(np.concatenate(([0], active.astype(np.int8), [0])))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1
    long = ends - starts >= 4
    starts, ends = starts[long], ends[long]
    if not len(starts) or starts[0] >= width * 0.12:
        return None
    end = ends[0]
    for a, b in zip(starts[1:].tolist(), ends[1:].tolist(), strict=True):
        if 0 < a - end <= gap:
            end = b
    return float(end / n) if 0.05 < end / n < 0.98 else None


@F.pandas_udf(T.DoubleType())
def _bar_ends(lines: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    def end(line: bytes, low: int, high: int) -> float | None:
        n = len(line)
        return bar_end(_stretched(line, low, high)[int(np.floor(n * 0.025)) : int(np.ceil(n * 0.965))] < BAR_DARK, n)

    return pd.Series([end(*x) for x in zip(lines, low, high, strict=True)], dtype=float)


def scanned(lines: DataFrame, places: DataFrame, tolerance: float = 0.014) -> DataFrame:
    """places (image, name, locator, top, bottom) to (image, name, locator, position, cluster_size,
    sample_size): where most lines between top and bottom say that the bar ends."""
    inside = (F.col("y") >= F.greatest(F.lit(0), F.floor("top"))) & (F.col("y") < F.least("height", F.ceil("bottom")))
    ends = _with(lines, places, "image").where(inside).withColumn("end", _bar_ends("line", "low", "high")).where("end IS NOT NULL")
    return layout.dominant_cluster(ends.select("image", "name", "locator", "y", "end"), ["image", "name", "locator"], "end", "y", tolerance)


def _nominal(name: Column) -> Column:
    """How far below the header a bar is, in widths."""
    return F.coalesce(*(F.when(name == bar, F.lit(FIRST_BAR + NEXT_BAR * k)) for k, bar in enumerate(BARS) if bar))


def layout_places(headers: DataFrame, above: float = 0.018, below: float = 0.055) -> DataFrame:
    """Where bars are by the lowest header of each image; headers: (image, bottom, width)."""
    names = F.array(*(F.lit(bar) for bar in BARS if bar))
    rows = headers.select("image", "bottom", "width", F.explode(names).alias("name")).withColumn("_at", F.col("bottom") + _nominal(F.col("name")) * F.col("width"))
    return rows.select("image", "name", F.lit("layout").alias("locator"), (F.col("_at") - above * F.col("width")).alias("top"), (F.col("_at") + below * F.col("width")).alias("bottom"))


def anchors(text_lines: DataFrame) -> DataFrame:
    """(image, name, bottom, next_top) of lines of text (image, place, text, top, bottom): labels as
    they follow each other below the heading. Each label is the first line that fits after the label
    before it; one that is missing is passed over. A page has a bounded number of lines; patterns are
    tried on single lines, and only lines that fit one are gathered."""
    fits = F.array_compact(F.array(*(F.when(F.col("text").rlike(pattern), F.lit(k)) for k, pattern in enumerate((HEADING, *(p for _, p in LABELS))))))
    marked = text_lines.withColumn("_fits", fits).where(F.size("_fits") > 0)
    page = marked.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("place", "text", "top", "bottom", "_fits"))).alias("lines"))
    names = F.array(F.lit("heading"), *(F.lit(name) for name, _ in LABELS))

    def next_place(at: Column, k: Column) -> Column:
        """at with the place of the first line that fits k after those found; null without one."""
        after = F.coalesce(F.array_max(at) + 1, F.lit(0))
        return F.array_append(at, F.array_min(F.transform("lines", lambda x, i: F.when((i >= after) & F.array_contains(x["_fits"], k), i))))

    def placed(at: Column) -> Column:
        below = lambda p: F.get("lines", F.array_min(F.filter(at, lambda q: q > p)))["top"]
        cell = lambda p, i: F.struct(F.get(names, i).alias("name"), F.get("lines", p)["bottom"].alias("bottom"), below(p).alias("next_top"))
        return F.array_compact(F.transform(at, lambda p, i: F.when(F.get(at, F.lit(0)).isNotNull() & p.isNotNull() & F.get(names, i).isin([bar for bar in BARS if bar]), cell(p, i))))

    # one fold, not a column a label: columns that refer to each other in lambdas are worked out anew for each line
    found = F.aggregate(F.array(*map(F.lit, range(len(LABELS) + 1))), F.array().cast("array<int>"), next_place, placed)
    return page.select("image", F.inline(found))


def anchored_places(found: DataFrame, of: DataFrame) -> DataFrame:
    """Where bars are by the labels above them; of: (image, width)."""
    reach = F.col("bottom") + 0.07 * F.col("width")
    half = F.when(F.col("next_top") > F.col("bottom"), F.col("bottom") + (F.col("next_top") - F.col("bottom")) * 0.38)
    return _with(found, of, "image").select("image", "name", F.lit("vision_label").alias("locator"), (F.col("bottom") + 0.002 * F.col("width")).alias("top"), F.least(reach, half).alias("bottom"))


def indicators(lines: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(image, name, level, section_percent, reading, position, confidence, locator) of the bars of
    images. labels: (image, name, bottom, next_top) of anchors, in pixels. Of two ways to find a bar
    a label counts before the layout if three lines agree; else the one whose lines agree more."""
    model = with_model(lines)
    headers = header_bands(model).groupBy("image").agg(F.max("run_end").alias("bottom"))
    of = sizes(lines).select("image", "width")
    places = layout_places(_with(headers, of, "image"))
    if labels is not None:
        places = places.unionByName(anchored_places(labels, of))
    found = scanned(model, places).withColumn("share", F.col("cluster_size") / F.col("sample_size"))
    labelled = (F.col("locator") == "vision_label") & (F.col("cluster_size") >= 3)
    whole = F.struct("position", "cluster_size", "share", "locator")
    best = found.groupBy("image", "name").agg(F.max_by(whole, F.struct(labelled, "share", F.col("locator") == "vision_label")).alias("b")).select("image", "name", "b.*")
    confidence = F.least(F.lit(0.99), 0.45 + 0.42 * F.col("share") + 0.02 * F.least("cluster_size", F.lit(6)))
    band = best.withColumn("band", fn.band_reading(F.col("name"), F.col("position")))
    return band.select("image", "name", "band.*", (F.floor(F.col("position") * 1000 + 0.5) / 1000.0).alias("position"), (F.floor(confidence * 100 + 0.5) / 100.0).alias("confidence"), "locator")


def dark_runs(dark: np.ndarray, gap: int = 3, least: int = 4) -> np.ndarray:
    """Runs (start, end) of dark pixels with at most `gap` others between neighbours."""
    at = np.nonzero(dark)[0]
    if not len(at):
        return np.zeros((0, 2), int)
    new = np.nonzero(np.diff(at) > gap + 1)[0]
    found = np.stack([at[np.append(0, new + 1)], at[np.append(new, len(at) - 1)]], axis=1)
    return found[found[:, 1] - found[:, 0] + 1 >= least]


def bar_ends(dark: np.ndarray) -> tuple[int, int, int] | None:
    """(left, end, right): the longest run that starts at the left, and the end of the one at the
    right that ends last; None unless they are apart."""
    width, found = len(dark), dark_runs(dark)
    left = found[(found[:, 0] < width * 0.16) & (found[:, 1] - found[:, 0] > width * 0.12)]
    right = found[found[:, 0] > width * 0.75]
    if not len(left) or not len(right):
        return None
    fill, edge = left[np.argmax(left[:, 1] - left[:, 0])], right[np.argmax(right[:, 1])]
    return (int(fill[0]), int(fill[1]), int(edge[1])) if fill[1] < edge[0] - 8 else None


def clusters(values: Sequence[float], tolerance: float = 10) -> list[int]:
    """The group of each value: a value joins the first group whose median is near, as it is by
    then, and else starts one."""
    found, of = [], []  # groups sorted by value
    for v in values:
        home = next((k for k, c in enumerate(found) if abs(v - (c[(len(c) - 1) // 2] + c[len(c) // 2]) / 2) <= tolerance), len(found))
        if home == len(found):
            found.append([])
        insort(found[home], v)
        of.append(home)
    return of


def greedy_clusters(rows: DataFrame, by: Sequence[str], order: str, value: str, tolerance: float = 10) -> DataFrame:
    """rows and cluster, from 0 in order of the first members. The fold depends on the order, so a
    group is one array; groups are lines of one bar, or as few."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: clusters(x.tolist(), tolerance))

    rest = [c for c in rows.columns if c not in (*by, order)]
    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("_rows"))
    folded = groups.withColumn("_of", fold(F.transform("_rows", lambda x: x[value].cast("double"))))
    cells = lambda x, i: F.struct(*(x[c].alias(c) for c in (order, *rest)), F.get("_of", i).alias("cluster"))
    return folded.select(*by, F.inline(F.transform("_rows", cells))).select(*rows.columns, "cluster")


_ENDS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("left", "end", "right")])


def _per_line(of: Callable[[np.ndarray], tuple | None], below: float):
    @F.pandas_udf(_ENDS)
    def run(lines: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        found = [of(_stretched(*x) < below) for x in zip(lines, low, high, strict=True)]
        return pd.DataFrame([x or (None, None, None) for x in found], columns=_ENDS.names).astype("Int32")

    return run


def bar_geometry(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(image, name, left, end, right, last_y, n): ends of each bar by most of its lines, from
    with_model's lines and headers (image, bottom, width)."""
    places = layout_places(headers, 0.03, 0.06).withColumnsRenamed({"top": "_top", "bottom": "_bottom"})
    inside = (F.col("y") >= F.greatest(F.lit(0), F.floor("_top"))) & (F.col("y") < F.least("height", F.ceil("_bottom")))
    ends = _with(lines, places, "image").where(inside).select("image", "name", "y", _per_line(bar_ends, REFINED_DARK)("line", "low", "high").alias("e")).select("image", "name", "y", "e.*").where("left IS NOT NULL")
    grouped = greedy_clusters(ends, ["image", "name"], "y", "end").groupBy("image", "name", "cluster").agg(
        *(F.floor(F.median(c) + 0.5).cast("int").alias(c) for c in ("left", "end", "right")), F.median(F.col("end") - F.col("left")).alias("_long"), F.max("y").alias("last_y"), F.count(F.lit(1)).alias("n"),
    )
    whole = F.struct("left", "end", "right", "last_y", "n")
    best = grouped.groupBy("image", "name").agg(F.max_by(whole, F.struct(F.col("_long") * F.col("n"), -F.col("cluster"))).alias("b")).select("image", "name", "b.*")
    return best.where((F.col("right") > F.col("left")) & (F.col("end") > F.col("left")) & (F.col("end") < F.col("right")))


def _sections(name: Column) -> Column:
    return F.when(name.isin("fat_percent", "bmi"), 4).otherwise(3)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _dark_places(lines: pd.Series, low: pd.Series, high: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([(np.nonzero(_stretched(x, a, b)[f : t + 1] < TICK_DARK)[0] + f).tolist() for x, a, b, f, t in zip(lines, low, high, first, last, strict=True)])


def ticks(lines: DataFrame, bars: DataFrame) -> DataFrame:
    """(image, name, section, x): for each bound between a bar's sections the column near it that is
    darkest in the lines below the bar, the first of equals; bars: bar_geometry's."""
    span = F.col("right") - F.col("left")
    asked = bars.select("*", F.explode(F.sequence(F.lit(1), _sections(F.col("name")) - 1)).alias("section")).withColumn("_at", F.col("left") + span * F.col("section") / _sections(F.col("name")))
    asked = asked.withColumn("first", F.greatest(F.col("left") + 5, F.floor(F.col("_at") - span * 0.055)).cast("int")).withColumn("last", F.least(F.col("right") - 5, F.ceil(F.col("_at") + span * 0.055)).cast("int"))
    inside = (F.col("y") >= F.least(F.col("height") - 1, F.col("last_y") + 3)) & (F.col("y") < F.least(F.col("height"), F.col("last_y") + F.floor(0.08 * F.col("width") + 0.5)))
    below = _with(lines, asked, "image").where(inside)
    dark = below.select("image", "name", "section", F.explode(_dark_places("line", "low", "high", "first", "last")).alias("x")).groupBy("image", "name", "section", "x").agg(F.count(F.lit(1)).alias("n"))
    best = dark.groupBy("image", "name", "section").agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("_x"))
    return _with(asked, best, ["image", "name", "section"], "left").select("image", "name", "section", F.coalesce("_x", F.when(F.col("first") <= F.col("last"), F.col("first")), F.floor(F.col("_at") + 0.5)).cast("int").alias("x"))


def refined(lines: DataFrame) -> DataFrame:
    """(image, name, level, section_percent, reading, position, confidence) of bars read between their ends
    and by the ticks between their sections; images without a header have none."""
    model = with_model(lines)
    headers = header_bands(model).groupBy("image").agg(F.max("run_end").alias("bottom"))
    headers = _with(headers, sizes(lines).select("image", "width"), "image")
    bars = bar_geometry(model, headers)
    bounds = ticks(model, bars).groupBy("image", "name").agg(F.array_sort(F.collect_list(F.struct("section", "x"))).alias("t"))  # three at most
    share = lambda x: (x - F.col("left")) / (F.col("right") - F.col("left"))
    rows = _with(bars, bounds, ["image", "name"]).withColumn("at", share(F.col("end"))).withColumn("ticks", F.transform("t.x", share))
    confidence = F.least(F.lit(0.95), 0.62 + F.least(F.lit(0.25), F.col("n") * 0.018))
    band = rows.withColumn("band", fn.position_reading(F.col("name"), F.col("at"), F.col("ticks")))
    return band.select("image", "name", "band.*", (F.floor(F.col("at") * 1000 + 0.5) / 1000.0).alias("position"), (F.floor(confidence * 100 + 0.5) / 100.0).alias("confidence"))
