import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from somalog.operators import raster

WIDTH, HEIGHT, HEADER = 300, 720, range(350, 358)


def picture(rng, fills, light=230, dark=20, noise=0.0, tick=0):
    """A header, and for each bar name and end its bar, the mark at its right end, and its ticks."""
    page = np.full((HEIGHT, WIDTH), light, np.uint8)
    page[HEADER] = dark
    for k, name in enumerate(raster.BARS):
        if name in fills:
            at = int(HEADER[-1] + (raster.FIRST_BAR + raster.NEXT_BAR * k) * WIDTH)
            page[at : at + 10, 8 : fills[name] + 1] = dark
            page[at : at + 10, 282:290] = dark
            sections = 4 if name in ("fat_percent", "bmi") else 3
            for s in range(1, sections):
                x = 8 + round(281 * s / sections) + tick
                page[at + 14 : at + 22, x] = dark
    spots = rng.random(page.shape) < noise
    page[spots] = rng.integers(0, 255, int(spots.sum()))
    return page


def lines(spark, pages):
    rows = [(k, y, bytearray(line.tobytes())) for k, page in pages.items() for y, line in enumerate(page)]
    return spark.createDataFrame(rows, "image int, y int, line binary").repartition(3)


def stretch(page):
    """Plainly: what with_model's low and high do."""
    n = np.bincount(page.ravel(), minlength=256)
    low, high = (int(np.nonzero(np.cumsum(n) >= page.size * f)[0][0]) for f in (0.01, 0.985))
    high = max(high, low + 10)
    return np.clip((page.astype(float) - low) * 255 / (high - low), 0, 255)


def plain_end(row, width):
    """A bar's end, pixel by pixel."""
    n = len(row)
    active = []
    for x in range(n):
        near = row[max(0, x - 4) : min(n, x + 5)]
        active.append(sum(near) / len(near) > 0.52)
    runs, x = [], 0
    while x < n:
        if active[x]:
            end = x
            while end + 1 < n and active[end + 1]:
                end += 1
            if end - x >= 4:
                runs.append((x, end))
            x = end
        x += 1
    if not runs or runs[0][0] >= width * 0.12:
        return None
    end = runs[0][1]
    for a, b in runs:
        if end < a <= end + 12:
            end = b
    return end / n if 0.05 < end / n < 0.98 else None


def test_bar_ends_against_a_plain_scan():
    rng = random.Random(4)
    for _ in range(300):
        row, dark = [], rng.random() < 0.8
        while len(row) < 290:
            row += [dark] * rng.choice((1, 2, 3, 5, 9, 14, 40, 90))
            dark = not dark
        row = np.array(row[:290])
        assert raster.bar_end(row, WIDTH) == plain_end(row.tolist(), WIDTH)


def test_dark_runs_against_a_plain_scan():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        dark = rng.random(200) < share
        want, run = [], None
        for x in np.nonzero(dark)[0].tolist():
            if run is not None and x - run[1] <= 4:
                run[1] = x
            else:
                run = [x, x]
                want.append(run)
        assert raster.dark_runs(dark).tolist() == [r for r in want if r[1] - r[0] + 1 >= 4]


def test_header_bands_and_contrast(spark):
    rng = np.random.default_rng(1)
    pages = {1: picture(rng, {"bmi": 100}, noise=0.02), 2: picture(rng, {}, light=120, dark=90), 3: np.full((HEIGHT, WIDTH), 7, np.uint8), 4: picture(rng, {})[:500]}
    pages[2][400:404] = 90  # too thin
    pages[2][430:440] = 90
    model = raster.with_model(lines(spark, pages))
    got = {r.image: [] for r in model.select("image").distinct().collect()}
    assert set(got) == {1, 2, 3}
    for r in raster.header_bands(model).collect():
        got[r.image].append((r.run_start, r.run_end))
    for k in got:
        shares = (stretch(pages[k])[:, 9:291] < 115).mean(axis=1) > 0.64
        runs, y = [], int(HEIGHT * 0.48)
        while y < np.ceil(HEIGHT * 0.72):
            end = y
            while end < np.ceil(HEIGHT * 0.72) and shares[end]:
                end += 1
            if end - y >= 6:
                runs.append((y, end - 1))
            y = end + 1
        assert sorted(got[k]) == runs
    assert got[2] == [(350, 357), (430, 439)] or sorted(got[2]) == [(350, 357), (430, 439)]
    whole = model.select("image", "y", raster.stretched("line", "low", "high").alias("line")).where("image = 1").orderBy("y").collect()
    assert (np.array([list(r.line) for r in whole]) == np.floor(stretch(pages[1]) + 0.5)).all()


def test_indicators_by_layout_and_by_label(spark):
    rng = np.random.default_rng(2)
    fills = {1: {"fat_percent": 77, "bmi": 148, "muscle_mass": 201, "bmr": 40}, 2: {"fat_percent": 160, "bmr": 120}}
    pages = {k: picture(rng, f, noise=0.01) for k, f in fills.items()}
    table = lines(spark, pages)
    got = {(r.image, r.name): r for r in raster.indicators(table).collect()}
    assert set(got) == {(k, name) for k, f in fills.items() for name in f}
    for (k, name), r in got.items():
        assert abs(r.position - (fills[k][name] - 7) / 283) <= 0.012 and r.locator == "layout" and 0.6 < r.confidence <= 0.99
    assert got[(1, "bmi")].level == "0" and got[(2, "fat_percent")].level == "+" and got[(1, "muscle_mass")].level == "+"
    moved = np.roll(pages[1], 30, axis=0)
    moved[HEADER] = moved[HEADER.start + 30 : HEADER.stop + 30]
    moved[HEADER.stop : HEADER.stop + 30] = 230  # the header is not where the bars follow from
    at = HEADER[-1] + 30 + raster.FIRST_BAR * WIDTH
    labels = spark.createDataFrame([(1, "fat_percent", at - 12.0, at + 60.0), (1, "bmr", 10.0, None)], "image int, name string, bottom double, next_top double")
    found = {r.name: r for r in raster.indicators(lines(spark, {1: moved}), labels).collect()}
    assert found["fat_percent"].locator == "vision_label" and abs(found["fat_percent"].position - 70 / 283) <= 0.012
    assert raster.indicators(table.limit(0)).count() == 0


def test_refined_bars(spark):
    rng = np.random.default_rng(3)
    pages = {1: picture(rng, {"fat_percent": 77, "bmr": 120}, noise=0.01, tick=4), 2: picture(rng, {"bmi": 170}), 3: np.full((HEIGHT, WIDTH), 200, np.uint8)}
    got = {(r.image, r.name): r for r in raster.refined(lines(spark, pages)).collect()}
    assert set(got) == {(1, "fat_percent"), (1, "bmr"), (2, "bmi")}
    assert abs(got[(1, "fat_percent")].position - 69 / 281) < 0.01 and got[(1, "fat_percent")].reading == "-: 95%"
    bound, end = (8 + round(281 / 3) + 4 - 8) / 281, 112 / 281
    assert got[(1, "bmr")].level == "0" and abs(got[(1, "bmr")].section_percent - 100 * (end - bound) / ((8 + round(562 / 3) + 4 - 8) / 281 - bound)) <= 5
    assert got[(2, "bmi")].level == "+" and got[(2, "bmi")].confidence > 0.7


def test_greedy_clusters_follow_the_order(spark):
    rng = random.Random(7)
    rows = [(g, k, float(rng.choice((0, 4, 9, 12, 21, 30)) + rng.random())) for g in range(20) for k in range(rng.randrange(1, 30))]
    got = raster.greedy_clusters(spark.createDataFrame(rows, "g int, k int, v double").repartition(4), ["g"], "k", "v")
    want = set()
    for g in range(20):
        groups = []
        for _, k, v in (r for r in rows if r[0] == g):
            for n, members in enumerate(groups):
                if abs(v - float(np.median(members))) <= 10:
                    members.append(v)
                    break
            else:
                n = len(groups)
                groups.append([v])
            want.add((g, k, v, n))
    assert {tuple(r) for r in got.collect()} == want


def test_anchors_follow_each_other(spark):
    texts = {
        1: ["BMI 22", "Indicator", "FAT % 20", "x", "BMI", "FAT %", "MUSCLE MASS", "BMR", "BMR"],
        2: ["INDICATOR", "BMI", "FAT %", "BMR"],  # FAT % comes after BMI here, so the BMR after it counts
        3: ["FAT %", "BMI"],
        4: ["the indicator", "VISCERAL FAT RATING", "FAT % BMI"],
    }
    rows = [(k, i, t, 10.0 * i, 10.0 * i + 8) for k, page in texts.items() for i, t in enumerate(page)]
    got = {(r.image, r.name): (r.bottom, r.next_top) for r in raster.anchors(spark.createDataFrame(rows, "image int, place int, text string, top double, bottom double")).collect()}
    assert got == {(1, "fat_percent"): (28.0, 40.0), (1, "bmi"): (48.0, 60.0), (1, "muscle_mass"): (68.0, 70.0), (1, "bmr"): (78.0, None), (2, "fat_percent"): (28.0, 30.0), (2, "bmr"): (38.0, None), (4, "fat_percent"): (28.0, None)}


@pytest.mark.parametrize("width, height, to", [(1000, 90, 720), (300, 40, 720), (1441, 33, 720), (730, 500, 365)])
def test_resized_and_cropped(spark, width, height, to):
    page = np.random.default_rng(9).integers(0, 255, (height, width)).astype(np.uint8)
    table = lines(spark, {1: page})
    got = np.array([list(r.line) for r in raster.resized(table, raster.sizes(table), to).orderBy("y").collect()])
    if width <= to:
        assert (got == page).all()
    else:
        now = int(height * to / width + 0.5)
        assert (got == page[(np.arange(now) * 2 + 1) * height // (2 * now)][:, (np.arange(to) * 2 + 1) * width // (2 * to)]).all()
    part = raster.cropped(table, raster.sizes(table), 0.25, 0.8).orderBy("y").collect()
    assert [r.y for r in part] == list(range(len(part))) and (np.array([list(r.line) for r in part]) == page[int(height * 0.25) : int(np.ceil(height * 0.8))]).all()


def test_brightness(spark):
    rgb = np.random.default_rng(8).integers(0, 255, (5, 30)).astype(np.uint8)
    rows = spark.createDataFrame([(y, bytearray(x.tobytes())) for y, x in enumerate(rgb)], "y int, line binary")
    got = [list(r[0]) for r in rows.orderBy("y").select(raster.brightness(F.col("line"))).collect()]
    assert got == [[int(0.299 * r + 0.587 * g + 0.114 * b + 0.5) for r, g, b in zip(x[::3].tolist(), x[1::3].tolist(), x[2::3].tolist(), strict=True)] for x in rgb]


def test_anchors_of_a_long_page(spark):
    """Work is a page's lines times the labels, not to the power of the labels."""
    texts = ["FAT %", "INDICATOR", *(["BMR", "FAT %", "other", "BMI 22"] * 60), "MUSCLE MASS", "BMR"]
    rows = [(k, n, t, n * 10.0, n * 10.0 + 8) for k in range(2) for n, t in enumerate(texts)]
    rows += [(2, n, t, n * 10.0, n * 10.0 + 8) for n, t in enumerate(("FAT %", "BMI"))]
    table = spark.createDataFrame(rows, "image int, place int, text string, top double, bottom double")
    got = sorted(map(tuple, raster.anchors(table).collect()))
    end = len(texts) - 2
    want = [("bmi", 58.0, end * 10.0), ("bmr", end * 10.0 + 18, None), ("fat_percent", 38.0, 50.0), ("muscle_mass", end * 10.0 + 8, end * 10.0 + 10)]
    assert got == [(k, *x) for k in range(2) for x in want]


def test_images_are_never_broadcast(spark):
    pages = lines(spark, {1: picture(np.random.default_rng(0), {"bmi": 120, "bmr": 90})})
    for found in (raster.refined(pages), raster.indicators(pages)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
