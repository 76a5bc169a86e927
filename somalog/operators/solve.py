"""Small combinatorial searches: body composition from loose numbers, and ranges to values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The parts that a solution names, in the order in which places break ties.
PARTS = ("weight", "ffm", "fat", "muscle", "minerals", "water", "protein")
#: How many loose numbers a report's text is solved with, least and most (the rule of the reports' reader;
#: composition has no such bounds).
COUNTS = (7, 20)
#: Items of up to so many numbers are solved together, others one by one (see widest): for speed only.
TOGETHER = 28


#: Triples of values looked at, and choices of seven compared, at once.
MOST_TRIPLES, MOST_CHOICES = 1 << 17, 1 << 20


def _joined(keys: np.ndarray, of: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with keys[i] == of[j], in order of i and in parts of about most; of is sorted."""
    first = np.searchsorted(of, keys, "left")
    n = np.searchsorted(of, keys, "right") - first
    ends = np.cumsum(n)
    start = 0
    while start < len(keys):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        i = np.repeat(np.arange(start, end), n[start:end])
        yield i, np.arange(len(i)) - np.repeat(ends[start:end] - n[start:end] - done, n[start:end]) + first[i]
        start = end


def _choose(v: np.ndarray, highest: np.ndarray, firsts: np.ndarray, middle: np.ndarray, last: np.ndarray, best: np.ndarray, choice: np.ndarray) -> None:
    """Put the best score and places of each item's joined triples into best and choice, if they are
    better than what is there. A triple is its item, its places and these as bits."""
    n = v.shape[1]
    for i, j in _joined(firsts[0] * n + firsts[2], middle[0] * n + middle[1], MOST_CHOICES // 8):
        apart = (firsts[4, i] & middle[4, j]) == 1 << firsts[2, i]  # nothing but ffm
        first, second = firsts[:, i[apart]], middle[:, j[apart]]
        five = first[4] | second[4]
        for i, j in _joined(second[0] * n + second[2], last[0] * n + last[1], MOST_CHOICES):
            apart = (five[i] & last[4, j]) == 1 << second[2, i]  # nothing but muscle
            i, j = i[apart], j[apart]
            of = first[0, i]
            seven = np.array([first[1, i], first[2, i], first[3, i], second[2, i], second[3, i], last[2, j], last[3, j]])
            w, f, a, m, k, t, p = v[of, seven]
            score = np.abs(w - f - a) + np.abs(f - m - k) + np.abs(m - t - p) + np.where(w == highest[of], 0.0, 2.0) + np.where(k < p, 0.0, 1.0)
            least = best.copy()
            np.minimum.at(least, of, score)
            near = score == least[of]
            of, seven, score = of[near], seven[:, near], score[near]
            order = np.lexsort((*seven[::-1], of))
            found, start = np.unique(of[order], return_index=True)
            for x, y in zip(found, order[start], strict=True):  # of equal scores, the smallest places
                if (score[y], *seven[:, y]) < (best[x], *choice[x]):
                    best[x], choice[x] = score[y], seven[:, y]


def solutions(v: np.ndarray) -> np.ndarray:
    """The best (weight, ffm, fat, muscle, minerals, water, protein, score) of each of many items of
    equally many numbers (items, numbers); NaN without any.

    Three kinds of triples are found by themselves and then joined on the part they share."""
    items, n = v.shape
    out = np.full((items, len(PARTS) + 1), np.nan)
    step = max(1, MOST_TRIPLES // n**3)
    if items > step:
        return np.concatenate([solutions(v[k : k + step]) for k in range(0, items, step)])
    at, differ = np.arange(n), ~np.eye(n, dtype=bool)
    different = differ[:, :, None] & differ[:, None, :] & differ[None, :, :]
    off = np.abs(v[:, :, None, None] - v[:, None, :, None] - v[:, None, None, :])
    larger = v[:, :, None] > v[:, None, :]
    of, *places = np.nonzero((off <= 1.2) & different & larger[..., None])
    off = off[of, *places]
    bits = (1 << at[places[0]]) | (1 << at[places[1]]) | (1 << at[places[2]])
    whole, middle = (np.array([of, *places, bits])[:, test] for test in (slice(None), off <= 1.0))
    last = np.array([of, *places, bits])[:, larger[of, places[1], places[2]]]
    best, choice = np.full(items, np.inf), np.zeros((items, len(PARTS)), np.int64)
    highest = v.max(axis=1)
    of, w = whole[:2]
    for some in (v[of, w] == highest[of], slice(None)):
        # a solution whose weight isn't the highest number scores 2 at least
        firsts = whole[:, some]
        firsts = firsts[:, best[firsts[0]] >= 2]
        _choose(v, highest, firsts, middle, last, best, choice)
    there = np.isfinite(best)
    out[there, :-1] = v[np.flatnonzero(there)[:, None], choice[there]]
    out[there, -1] = best[there]
    return out


#: How far a triple's whole may be from the sum of its parts: of weight, ffm and muscle.
OFF = (1.2, 1.0, 1.2)
#: More than sums of numbers below 300 are rounded by.
ROUNDED = 1e-12
#: A solution has a value three times at most: as one of the falling weight, ffm, muscle, water and
#: protein, as fat and as minerals. So no more than its first three places are ever chosen.
TWINS = 3


class _Wide:
    """One item's numbers as different values u, rising, with their first places. Searches go by
    values and in parts."""

    def __init__(self, v: np.ndarray):
        order = np.argsort(v, kind="stable")
        self.u, start, n = np.unique(v[order], return_index=True, return_counts=True)
        self.none = len(v)
        nth = np.arange(TWINS + 1)
        self.places = np.where(nth < np.minimum(n, TWINS)[:, None], order[np.minimum(start[:, None] + nth, len(v) - 1)], self.none)

    def free(self, x: np.ndarray, *used: np.ndarray | int) -> np.ndarray:
        """The first place of each value that the used values leave, or none."""
        return self.places[x, np.minimum(sum((x == y).astype(int) for y in used), TWINS)]

    def sums(self, x: np.ndarray, y: np.ndarray, off: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(x, y, z, |x - y - z|) for which that is off at most, in parts."""
        u = self.u
        rest = u[x] - u[y]
        first = np.searchsorted(u, rest - off - ROUNDED)
        n = np.searchsorted(u, rest + off + ROUNDED, "right") - first
        ends = np.cumsum(n)
        start = 0
        while start < len(x):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + MOST_CHOICES, "right")))
            i = np.repeat(np.arange(start, end), n[start:end])
            z = np.arange(len(i)) - np.repeat(ends[start:end] - n[start:end] - done, n[start:end]) + first[i]
            apart = np.abs(rest[i] - u[z])
            fits = apart <= off
            yield x[i[fits]], y[i[fits]], z[fits], apart[fits]
            start = end

    def listed(self, x: np.ndarray, y: np.ndarray, off: float) -> list[np.ndarray]:
        return [np.concatenate(part) for part in zip(*self.sums(x, y, off), strict=True)] if len(x) else [np.zeros(0, int)] * 3 + [np.zeros(0)]

    def weights(self, penalty: int) -> np.ndarray:
        """For each ffm how near weight and fat come at best, if the weight is the highest number
        (no penalty) or another."""
        top = len(self.u) - 1
        best = np.full(top + 1, np.inf)
        step = max(1, MOST_CHOICES // (top + 1))
        for start in range(0, top, step) if penalty else (0,):
            w, f = (np.arange(start, min(start + step, top)) if penalty else np.array([top]))[:, None], np.arange(top + 1)[None, :]
            rest = self.u[w] - self.u[f]
            at = np.searchsorted(self.u, rest)
            for shift in range(-3, 3):  # of three neighbours on a side, weight and ffm may take two
                a = np.clip(at + shift, 0, top)
                there = (f < w) & (self.free(a, w, f) < self.none)
                off = np.abs(rest - self.u[a])
                best = np.minimum(best, np.where(there & (off <= OFF[0]), off, np.inf).min(axis=0))
        return best

    def middles(self, f: np.ndarray, off: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(f, m, k, e2): ffm, of those given, muscle and minerals that fit, and how far off they are."""
        step = max(1, MOST_CHOICES // (8 * len(f)))
        for start in range(0, f.max(), step):
            m, x = (z.ravel() for z in np.meshgrid(np.arange(start, min(start + step, f.max())), f, indexing="ij"))
            higher = x > m
            for x, m, k, e2 in self.sums(x[higher], m[higher], min(OFF[1], off)):
                fits = self.free(k, x, m) < self.none
                yield x[fits], m[fits], k[fits], e2[fits]

    def lowest(self, m: np.ndarray, k: np.ndarray, off: float) -> tuple[np.ndarray, np.ndarray]:
        """How far off water and protein are at best, for each muscle and minerals: with a protein above
        the minerals, and with any."""
        found = np.full((2, len(m)), np.inf)
        size = len(self.u)
        kinds, of = np.unique(m, return_inverse=True)
        order = np.argsort(of, kind="stable")
        step = max(1, MOST_CHOICES // (8 * size))
        for start in range(0, len(kinds), step):
            some = kinds[start : start + step]
            i, t = (z.ravel() for z in np.meshgrid(np.arange(len(some)), np.arange(some[-1]), indexing="ij"))
            lower = t < some[i]
            near = np.full((len(some), size + 1), np.inf)
            for x, y, z, e3 in self.sums(some[i[lower]], t[lower], min(OFF[2], off)):
                low = z < y
                np.minimum.at(near, (np.searchsorted(some, x[low]), z[low]), e3[low])
            near = np.minimum.accumulate(near[:, ::-1], axis=1)[:, ::-1]
            here = order[slice(*np.searchsorted(of[order], (start, start + step)))]
            found[:, here] = near[of[here] - start, k[here] + 1], near[of[here] - start, 0]
        return found[0], found[1]

    def best_of(self, f: int, m: int, k: int, e2: float, penalty: int, best: float, off: float) -> float:
        """The best score with these three and others that are off at most, if it is below best; else best."""
        top = len(self.u) - 1
        w = np.arange(f + 1, top) if penalty else np.array([top])
        w, _, a, e1 = self.listed(w, np.full(len(w), f), min(OFF[0], off))
        fits = (self.free(a, w, f, m, k) < self.none) & (self.free(np.full(len(w), k), w, f, m) < self.none)
        a, e1 = a[fits], e1[fits]
        _, t, p, e3 = self.listed(np.full(m, m), np.arange(m), min(OFF[2], off))
        fits = (p < t) & (self.free(np.full(len(t), k), t, p, f, m) < self.none)
        t, p, e3 = t[fits], p[fits], e3[fits]
        extra = np.where(k < p, 0.0, 1.0)
        for i in np.argsort(e1, kind="stable"):
            score = e1[i] + e2 + e3 + penalty + extra
            if not len(score) or score.min() >= best:
                break
            apart = self.free(np.full(len(t), a[i]), t, p, k) < self.none
            best = min(best, score[apart].min(initial=np.inf))
        return best

    def better(self, e1: np.ndarray, penalty: int, best: float, off: float) -> float:
        """The best score of those with this penalty whose triples are off at most, if it is below best; else best."""
        f = np.flatnonzero(e1 <= off)
        for f, m, k, e2 in self.middles(f, off) if len(f) else ():
            x = e1[f] + e2
            open_ = x + penalty < best
            f, m, k, e2, x = (y[open_] for y in (f, m, k, e2, x))
            least = _least(x, *self.lowest(m, k, off), penalty)
            for i in np.argsort(least, kind="stable"):
                if least[i] >= best:
                    break
                best = self.best_of(f[i], m[i], k[i], e2[i], penalty, best, off)
            if best <= penalty:
                break
        return best

    def first_of(self, best: float, fats: dict[int, np.ndarray]) -> tuple[int, ...]:
        """The values of the solution with this score whose places are smallest."""
        top = len(self.u) - 1
        for w in np.argsort(self.places[:, 0]):
            penalty = 0 if w == top else 2
            if penalty not in fats:
                continue
            off = best - penalty + ROUNDED
            lower = np.flatnonzero((np.arange(top + 1) < w) & (fats[penalty] + penalty <= best))
            for f in lower[np.argsort(self.places[lower, 0])]:
                _, _, a, e1 = self.listed(np.array([w]), np.array([f]), min(OFF[0], off))
                place = self.free(a, w, f)
                order = np.argsort(place)
                order = order[place[order] < self.none]
                middles = [*self.middles(np.array([f]), off)] if len(order) and f else []
                if not middles:
                    continue
                _, m, k, e2 = (np.concatenate(part) for part in zip(*middles, strict=True))
                for i in order:
                    x = e1[i] + e2
                    places = np.array([self.free(m, w, f, a[i]), self.free(k, w, f, a[i], m)])
                    fits = np.flatnonzero((x + penalty <= best) & (places < self.none).all(axis=0))
                    fits = fits[np.lexsort(places[::-1, fits])]
                    start, end = 0, 8
                    while start < len(fits):  # the first ones mostly do
                        some = fits[start:end]
                        start, end = end, end * 4
                        for j in some[_least(x[some], *self.lowest(m[some], k[some], off), penalty) <= best]:
                            five = (w, f, a[i], m[j], k[j])
                            _, t, p, e3 = self.listed(np.full(m[j], m[j]), np.arange(m[j]), min(OFF[2], off))
                            last = np.array([self.free(t, *five), self.free(p, *five)])
                            there = np.flatnonzero((p < t) & (x[j] + e3 + penalty + np.where(k[j] < p, 0.0, 1.0) <= best) & (last < self.none).all(axis=0))
                            if len(there):
                                y = there[np.lexsort(last[::-1, there])[0]]
                                return (*five, t[y], p[y])
        raise AssertionError("a score without its solution")


def _least(x: np.ndarray, above: np.ndarray, any_: np.ndarray, penalty: int) -> np.ndarray:
    """The least score with x for the first two triples: added up in the order of a score, so that it is
    never above one by rounding."""
    return np.minimum(x + above + penalty, x + any_ + penalty + 1)


def widest(v: np.ndarray) -> np.ndarray:
    """What solutions gives for one item, of however many numbers.

    For each ffm, muscle and minerals the other four are bounded as if all could have the same place;
    what may beat the best score is then searched with different places. Triples that are off by
    little come first, and others only as long as they may be better: the more numbers, the closer
    the best."""
    item = _Wide(v)
    best, fats = np.inf, {}
    for penalty in (0, 2):
        if penalty > best:
            break
        fats[penalty] = item.weights(penalty)
        off = (item.u[-1] - item.u[0]) / len(item.u) ** 2 + ROUNDED
        while True:
            best = item.better(fats[penalty], penalty, best, off)
            if best <= penalty + off / 2 or off >= max(OFF):
                break
            off *= 4
    if not np.isfinite(best):
        return np.full(len(PARTS) + 1, np.nan)
    return np.append(item.u[list(item.first_of(best, fats))], best)


def solved(v: np.ndarray) -> tuple[float, ...] | None:
    """The best solution of one item's numbers, if there is one."""
    (best,) = solutions(np.asarray(v, float)[None, :])
    return None if np.isnan(best[-1]) else (*map(float, best),)


_SOLUTION = T.StructType([T.StructField(name, T.DoubleType()) for name in (*PARTS, "score")])


@F.pandas_udf(_SOLUTION)
def _solutions(values: pd.Series) -> pd.DataFrame:
    out = np.full((len(values), len(PARTS) + 1), np.nan)
    sizes = np.array([0 if v is None else len(v) for v in values], int)
    for size in np.unique(sizes[(sizes > 0) & (sizes <= TOGETHER)]):
        alike = np.flatnonzero(sizes == size)
        out[alike] = solutions(np.stack(values.iloc[alike].to_list()).astype(float))
    for k in np.flatnonzero(sizes > TOGETHER):
        out[k] = widest(np.asarray(values.iloc[k], float))
    return pd.DataFrame(out, columns=[*PARTS, "score"]).astype("Float64")


#: The same, not solved a second time for a filter on the score.
_solutions_once = F.pandas_udf(_solutions.func, _SOLUTION).asNondeterministic()


def plausible(values: Column) -> Column:
    """Those of an array of numbers that a solution may hold."""
    return F.filter(values, lambda v: (v > 0) & (v < 300))


def solution(fine: Column) -> Column:
    """The best (weight, ffm, fat, muscle, minerals, water, protein, score) of a row's 7 to 20 plausible
    numbers; its fields are null without one."""
    none = F.array().cast("array<double>")  # null lists are slow to write for Python
    return _solutions(F.when(F.size(fine).between(*COUNTS), fine).otherwise(none))


def composition(values: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """(key, weight, ffm, fat, muscle, minerals, water, protein, score) from the numbers of a key, 7 at
    least, however many.

    Weight = ffm + fat, ffm = muscle + minerals and muscle = water + protein must hold nearly;
    the best score wins, then the smallest places. Of equal numbers of a key only the first TWINS can
    be in its solution, so an array grows with a key's different numbers.
    """
    fine = values.where((F.col(value) > 0) & (F.col(value) < 300) & F.col(key).isNotNull()).select(key, place, F.col(value).cast("double").alias("_v"))
    first = fine.repartition(key).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_v").orderBy(place))).where(F.col("_n") <= TWINS)
    arrays = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, "_v"))), lambda x: x["_v"]).alias("_v"))
    return arrays.where(F.size("_v") >= len(PARTS)).select(key, _solutions_once("_v").alias("_s")).where("_s.score IS NOT NULL").select(key, "_s.*")


def range_cost(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    outside = np.maximum(0, np.maximum(low - value, value - high))
    return outside * 5 + np.abs(value - (low + high) / 2) / np.maximum(0.1, high - low)


def best_assignment(cost: np.ndarray) -> list[int] | None:
    """For each row the column of the cheapest one-to-one choice (of equal ones, the smallest
    columns first). Columns are dealt out one by one, and the cheapest choice for each set of
    rows that have one is kept: 2 ** rows sets, however many columns there are."""
    rows, columns = cost.shape
    if columns < rows or rows > 8:
        return None
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, (columns,) * rows)}
    for c in range(columns):
        for served, (total, path) in sorted(best.items(), reverse=True):  # larger sets first: a column serves one row
            for r in range(rows):
                if not served >> r & 1:
                    option = (total + float(cost[r, c]), (*path[:r], c, *path[r + 1 :]))
                    if served | 1 << r not in best or option < best[served | 1 << r]:
                        best[served | 1 << r] = option
    return list(best[(1 << rows) - 1][1])


def best_assignments(costs: np.ndarray) -> np.ndarray:
    """best_assignment of many tables of finite costs at once, all of one shape (items, rows, columns)
    with at most as many rows as columns: (items, rows). A choice is compared as one number, whose
    digits are its columns."""
    items, rows, columns = costs.shape
    weight = (columns + 1) ** np.arange(rows - 1, -1, -1, dtype=np.int64)
    total = np.full((1 << rows, items), np.inf)
    path = np.full((1 << rows, items), int(columns * weight.sum()), np.int64)
    total[0] = 0
    sets = np.arange(1 << rows)
    without = [sets[sets >> r & 1 == 0] for r in range(rows)]
    for c in range(columns):
        next_total, next_path = total.copy(), path.copy()  # a column serves one row
        for r in range(rows):
            a, b = without[r], without[r] | 1 << r
            option, way = total[a] + costs[:, r, c], path[a] - (columns - c) * weight[r]
            better = (option < next_total[b]) | ((option == next_total[b]) & (way < next_path[b]))
            next_total[b] = np.where(better, option, next_total[b])
            next_path[b] = np.where(better, way, next_path[b])
        total, path = next_total, next_path
    return path[-1][:, None] // weight % (columns + 1)


#: Tables of costs that are solved at once.
AT_ONCE = 2048


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def assigned_ranges(values: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
    """For arrays of values and of range ends: each value's range (from 0); null if there are
    too few ranges or over 8 values."""
    out: list = [None] * len(values)
    alike: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for k, (v, low, high) in enumerate(zip(values, lows, highs, strict=True)):
        if v is None or low is None or high is None:
            continue
        rows, columns = len(v), len(low)
        if not rows:
            out[k] = []
        elif rows <= columns and rows <= 8:
            alike.setdefault((rows, columns), []).append((k, np.array([*v, *low, *high], float)))
    for (rows, columns), found in alike.items():
        for start in range(0, len(found), AT_ONCE):
            places, flat = zip(*found[start : start + AT_ONCE], strict=True)
            x = np.stack(flat)
            v, low, high = x[:, :rows, None], x[:, None, rows : rows + columns], x[:, None, rows + columns :]
            costs = range_cost(v, low, high)
            plain = ~np.isfinite(costs).all(axis=(1, 2)) | ((columns + 1) ** rows > 2**62)
            for k, cost in zip(np.array(places)[plain], costs[plain], strict=True):
                out[k] = best_assignment(cost)
            if not plain.all():
                for k, choice in zip(np.array(places)[~plain], best_assignments(costs[~plain]).tolist(), strict=True):
                    out[k] = choice
    return pd.Series(out, dtype=object)
