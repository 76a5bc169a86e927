"""Several readings of one receipt merged into one record whose fields say where they come from.

* Every field is voted on (see consensus): readings that saw a value count before those that
  derived it, and fields whose observed values disagree are conflicted.
* The two resistances, and the two reactances, are taken as a pair from one reading, the one whose
  difference is nearest to what such devices print, since halves of two readings don't fit.
* Rules then run on the winners: what contradicts others is corrected, what is missing and
  follows from others is filled, and what still doesn't fit is warned of. Warnings of single
  readings are not carried over.
* A field is derived if no reading saw it, or a rule set it. Fields are up for review if any
  reading lists them.

Readings are dealt out by receipt and sorted by merit once, and the votes on all fields of many
receipts are taken together. A receipt with any number of readings goes on as what differs in
them, so no step gathers readings as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.functions import scalars as fn
from somalog.operators import consensus
from somalog.operators.reports import RECEIPT_CORE

RESULTS = ("weight_kg", "fat_percent", "fat_mass_kg", "ffm_kg", "muscle_mass_kg", "tbw_kg", "tbw_percent", "bone_mass_kg", "bmr_kj", "bmr_kcal", "metabolic_age", "visceral_fat_rating", "bmi", "ideal_body_weight_kg", "degree_of_obesity_percent")
#: Differences of the pairs at the two frequencies (fixed values).
RESISTANCE_STEP, REACTANCE_STEP = 65, 22
LOW, HIGH = "6.25_khz", "50_khz"
#: Parsed columns by the path that a record has them at.
TEXTS = {"measured_at_local": "measured_at_local", "date": "date", "time": "time", "input.body_type": "body_type", "input.gender": "gender", "qualitative.physique_rating": "physique_rating"}
NUMBERS = {
    **{f"input.{c}": c for c in ("age", "height_cm", "clothes_weight_kg")},
    **{f"metrics.{c}": c for c in RESULTS},
    **{f"reference_ranges.{path}.{end}": f"{c}.{end}" for path, c in (("fat_percent", "fat_percent_range"), ("fat_mass_kg", "fat_mass_range")) for end in ("min", "max")},
}
IMPEDANCE = {f"bioelectrical.{f}.{c}": (f, c) for f in (LOW, HIGH) for c in ("r_ohm", "x_ohm")}
PATHS = (*TEXTS, *NUMBERS, *IMPEDANCE)
#: Texts are compared as whole numbers that stand for them.
TEXT_TOLERANCE = 0.5
#: Rows of a receipt beyond which they go on as what differs.
OPEN_ROWS = 2048
#: Conflicts of other fields are not worth a look.
MEANINGFUL = ("metrics.", "input.", "bioelectrical.")


def _ohm(frequency: str, what: str) -> Column:
    return F.try_element_at("bioelectrical", F.lit(frequency))[what]


def readings(parses: DataFrame, key: str, place: str) -> DataFrame:
    """parses, one row a reading, as key, time, numbers and texts in the order of PATHS, same (what
    texts are compared by; blank ones have none), seen (by path; not derived), the fitting pairs r
    and x, and listed paths. A reading without a time of day has no vote on the time of measurement."""
    derived = F.coalesce("derived_fields", F.array().cast("array<string>"))
    said = [F.when(F.col("time").isNotNull(), F.col(c)) if path == "measured_at_local" else F.col(c) for path, c in TEXTS.items()]
    numbers = [*(F.col(c) for c in NUMBERS.values()), *(_ohm(*of) for of in IMPEDANCE.values())]
    (low, high), (less, more) = ([_ohm(f, what) for f in (LOW, HIGH)] for what in ("r_ohm", "x_ohm"))
    return parses.select(
        key,
        F.col("measured_at_local").alias("time"),
        F.array(*(c.cast("double") for c in numbers)).alias("numbers"),
        F.array(*said).alias("texts"),
        F.array(*(fn.blank_to_null(F.lower(F.trim(c))) for c in said)).alias("same"),
        F.array(*(F.coalesce(~F.array_contains(derived, path), F.lit(False)) for path in PATHS)).alias("seen"),
        _pair(low, high, F.abs(low - high - RESISTANCE_STEP), low > high, place).alias("r"),
        _pair(less, more, F.abs(F.abs(more) - F.abs(less) - REACTANCE_STEP), F.lit(True), place).alias("x"),
        F.coalesce("review_fields", F.array().cast("array<string>")).alias("listed"),
        (F.col("completeness") - consensus.WARNING_WEIGHT * F.size("warnings")).alias("_merit"),
        F.col(place).alias("_place"),
    )


def _pair(low: Column, high: Column, off: Column, fits: Column, place: str) -> Column:
    """Two values that fit; of a key's pairs the one that is off the least counts, the first of equals."""
    return F.when(fits & low.isNotNull() & high.isNotNull(), F.struct(off.alias("off"), F.col(place).alias("place"), low.alias("low"), high.alias("high")))


class _Rules:
    """Rules over merged columns, each seeing what the ones before it made."""

    def __init__(self, rows: DataFrame) -> None:
        none = F.array().cast("array<string>")
        self.rows = rows.withColumn("corrected_fields", none).withColumn("warnings", none)

    def set(self, name: str, value: Column, test: Column, warn: Column | None = None) -> None:
        """Set a value where a test holds and the value can be told."""
        new = F.when(F.coalesce(test, F.lit(False)), value)
        rows = self.rows.withColumn("_new", new)
        if warn is not None:
            rows = self._warned(rows, warn & F.col("_new").isNotNull(), F.concat(F.lit(f"{name} was read as "), fn.number_text(F.col(name)), F.lit(", which contradicts other values; it is set to "), fn.number_text(F.col("_new")), F.lit(".")))
        rows = rows.withColumn("corrected_fields", F.when(F.col("_new").isNotNull(), F.array_append("corrected_fields", F.lit(f"metrics.{name}"))).otherwise(F.col("corrected_fields")))
        self.rows = rows.withColumn(name, F.coalesce("_new", name)).drop("_new")

    def fill(self, name: str, value: Column) -> None:
        self.set(name, value, F.col(name).isNull())

    @staticmethod
    def _warned(rows: DataFrame, test: Column, text: Column) -> DataFrame:
        return rows.withColumn("warnings", F.when(F.coalesce(test, F.lit(False)), F.array_append("warnings", text)).otherwise(F.col("warnings")))

    def warn(self, test: Column, text: str) -> None:
        self.rows = self._warned(self.rows, test, F.lit(text))


def checked(rows: DataFrame) -> DataFrame:
    """Merged metrics and height_cm after the rules, with corrected_fields and warnings."""
    rules, (weight, ffm, fat) = _Rules(rows), map(F.col, ("weight_kg", "ffm_kg", "fat_mass_kg"))
    muscle, expected = F.col("muscle_mass_kg"), fn.round1(F.col("ffm_kg") - F.col("bone_mass_kg"))
    off = F.abs(muscle - expected)
    rules.set("muscle_mass_kg", expected, muscle.isNull() | (off > 0.05), off > 0.5)
    rules.fill("fat_mass_kg", fn.round1(weight - ffm))
    rules.fill("fat_percent", fn.round1(fat / weight * 100))
    rules.fill("tbw_kg", fn.round1(weight * F.col("tbw_percent") / 100))
    rules.fill("tbw_percent", fn.round1(F.col("tbw_kg") / weight * 100))
    rules.fill("bmr_kj", fn.half_up(F.col("bmr_kcal") * 4.184))
    rules.fill("bmr_kcal", fn.half_up(F.col("bmr_kj") / 4.184))
    metres = F.col("height_cm") / 100
    index = weight / (metres * metres)
    rules.fill("bmi", fn.round1(index))
    rules.warn(F.abs(weight - fat - ffm) > 0.35, "Weight, fat mass and FFM do not reconcile; review them.")
    rules.warn(F.abs(weight * F.col("fat_percent") / 100 - fat) > 0.45, "Fat %, weight and fat mass do not reconcile; review them.")
    rules.warn(F.abs(index - F.col("bmi")) > 0.35, "BMI does not match weight and height; review it.")
    return rules.rows


class _Votes:
    """Votes on many fields at once, a column each: groups of values within tolerance of their first,
    in order (the first axis), with the rows of their firsts and how often they were seen and said."""

    def __init__(self, values: np.ndarray, tolerance: np.ndarray, seen: np.ndarray, said: np.ndarray) -> None:
        most, fields = values.shape
        self.first, lead = np.full((most, fields), -1), np.full((most, fields), np.nan)
        self.seen, self.said = np.zeros((2, most, fields), np.int64)
        self.n, of = np.zeros(fields, np.int64), np.arange(fields)
        for r in range(most):
            groups, there = int(self.n.max(initial=0)), said[r] > 0
            home = self.n.copy()
            if groups:
                near = np.abs(lead[:groups] - values[r]) <= tolerance
                home = np.where(near.any(axis=0), near.argmax(axis=0), home)
            new = there & (home == self.n)
            lead[home[new], of[new]], self.first[home[new], of[new]] = values[r, new], r
            self.seen[home[there], of[there]] += seen[r, there]
            self.said[home[there], of[there]] += said[r, there]
            self.n += new
        self.groups = int(self.n.max(initial=0))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each field's row of the value seen most, then said most, then first (-1: none), how often it
        was seen, and whether values that were seen disagree."""
        row, seen, said = self.first[0].copy(), self.seen[0].copy(), self.said[0].copy()
        for g in range(1, self.groups):
            better = (self.seen[g] > seen) | ((self.seen[g] == seen) & (self.said[g] > said))
            for out, of in ((row, self.first), (seen, self.seen), (said, self.said)):
                out[better] = of[g, better]
        return row, seen, (self.seen > 0).sum(axis=0) > 1


def _taken(values: pa.Array, rows: np.ndarray) -> pa.Array:
    """Values at some rows; null where the row is -1."""
    return values.take(pa.array(rows, mask=rows < 0))


def _listed(values: pa.Array, wide: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, wide), pa.int32()), values)


class _Readings:
    """Rows of readings() in order of key and merit. A row may stand for several readings of a key: said
    and seen hold how often each of its fields was, and count for how many it stands."""

    def __init__(self, rows: pa.Table, said: np.ndarray | None = None, seen: np.ndarray | None = None, count: np.ndarray | None = None) -> None:
        self.rows = rows.combine_chunks()
        flat = {c: self.column(c).flatten() for c in ("numbers", "texts", "same", "seen")}
        self.numbers, self.texts, self.same = flat["numbers"], flat["texts"], flat["same"]
        codes = self.same.dictionary_encode().indices
        shaped = lambda values, wide: values.to_numpy(zero_copy_only=False).reshape(-1, wide)
        exact = np.nan_to_num(shaped(self.numbers.fill_null(0.0), len(PATHS) - len(TEXTS)), nan=1e300, posinf=1e302, neginf=-1e302)  # equal to themselves
        self.values = np.hstack([shaped(codes.fill_null(0), len(TEXTS)).astype(float), exact])
        there = np.hstack([shaped(self.same.is_valid(), len(TEXTS)), shaped(self.numbers.is_valid(), len(PATHS) - len(TEXTS))])
        self.said = there.astype(np.int64) if said is None else said
        self.seen = (there & shaped(flat["seen"], len(PATHS))).astype(np.int64) if seen is None else seen
        self.count = np.ones(len(rows), np.int64) if count is None else count
        keys = self.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        self.starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)

    def column(self, c: str | int) -> pa.Array:
        found = self.rows.column(c)
        return found.chunk(0) if found.num_chunks else pa.array([], found.type)

    def part(self, start: int, end: int) -> _Readings:
        return _Readings(self.rows.slice(start, end - start), *(x[start:end] for x in (self.said, self.seen, self.count)))

    def then(self, more: _Readings) -> _Readings:
        return _Readings(pa.concat_tables([self.rows, more.rows]), *(np.concatenate(x) for x in ((self.said, more.said), (self.seen, more.seen), (self.count, more.count))))

    def votes(self, rows: np.ndarray) -> _Votes:
        """Votes of keys with equally many rows: rows (keys, rows a key)."""
        wide = lambda x: x[rows.T].reshape(rows.shape[1], -1)
        return _Votes(wide(self.values), np.tile([TEXT_TOLERANCE] * len(TEXTS) + [consensus.TOLERANCE] * (len(PATHS) - len(TEXTS)), len(rows)), wide(self.seen), wide(self.said))

    def pair(self, what: str) -> np.ndarray:
        """Each key's row of the best pair, or -1."""
        pairs, best = self.column(what), np.full(len(self.starts), -1)
        at = np.flatnonzero(pairs.is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            off, place, low, high = (pc.struct_field(pairs, c).take(pa.array(at)) for c in ("off", "place", "low", "high"))
            place = pc.rank(place, "ascending", null_placement="at_start", tiebreaker="dense")
            of = np.searchsorted(self.starts, at, "right") - 1
            order = np.lexsort((high.to_numpy(), low.to_numpy(), place.to_numpy(), off.to_numpy(), of))
            keys, first = np.unique(of[order], return_index=True)
            best[keys] = at[order[first]]
        return best

    def listed(self) -> pa.Array:
        """Each key's different paths."""
        lists = self.column("listed")
        found = pc.list_flatten(lists).dictionary_encode()
        of = np.searchsorted(self.starts, pc.list_parent_indices(lists).to_numpy(), "right") - 1
        there = found.is_valid().to_numpy(zero_copy_only=False)
        n = max(1, len(found.dictionary))
        alike = np.unique(of[there] * n + found.indices.fill_null(0).to_numpy()[there])
        ends = np.cumsum(np.bincount(alike // n, minlength=len(self.starts)))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found.dictionary.take(pa.array(alike % n)))

    def cells(self, rows: np.ndarray) -> dict[str, pa.Array]:
        """Numbers and texts whose fields are taken from the given rows (n, PATHS)."""
        n = len(TEXTS)
        at = lambda part, wide: np.where(part < 0, -1, part * wide + np.arange(wide)).ravel()
        texts, numbers = at(rows[:, :n], n), at(rows[:, n:], len(PATHS) - n)
        return {"numbers": _listed(_taken(self.numbers, numbers), len(PATHS) - n), "texts": _listed(_taken(self.texts, texts), n), "same": _listed(_taken(self.same, texts), n)}

    def shortened(self) -> _Readings:
        """The rows of one key as a row for each group of its values, which vote on as they would."""
        votes = self.votes(np.arange(len(self.rows))[None, :])
        n = max(1, votes.groups)
        first = np.where(np.arange(n) < 1, 0, -1)
        only = lambda values: _taken(values, first)  # noqa: E731  in the first row
        cells = self.cells(votes.first[:n]) | {"seen": _listed(pa.array(np.ones(n * len(PATHS), bool)), len(PATHS)), "listed": only(self.listed())}
        cells |= {what: _taken(self.column(what), np.where(first < 0, -1, self.pair(what)[0])) for what in "rx"} | {"time": only(self.column("time"))}
        names = self.rows.column_names
        table = pa.table([_taken(self.column(0), np.zeros(n, np.int64)), *(cells[c].cast(self.rows.schema.field(c).type) for c in names[1:])], names)
        table = table.set_column(names.index("listed"), "listed", pc.fill_null(table["listed"], pa.scalar([], table.schema.field("listed").type)))
        return _Readings(table.cast(self.rows.schema), votes.said[:n], votes.seen[:n], np.where(first < 0, 0, self.count.sum()))

    def merged(self) -> pa.RecordBatch:
        """A row a key."""
        sizes = np.diff(np.append(self.starts, len(self.rows)))
        row, seen, conflicts = (np.zeros((len(sizes), len(PATHS)), t) for t in (np.int64, np.int64, bool))
        for size in np.unique(sizes):
            keys = np.flatnonzero(sizes == size)
            rows = self.starts[keys][:, None] + np.arange(size)
            best, often, torn = (x.reshape(len(keys), -1) for x in self.votes(rows).best())
            row[keys] = np.where(best < 0, -1, rows[:, 0][:, None] + best)
            seen[keys], conflicts[keys] = often, torn
        bits = lambda test: pa.array((test * (1 << np.arange(len(PATHS)))).sum(axis=1))
        cells = self.cells(row)
        out = {
            self.rows.column_names[0]: _taken(self.column(0), self.starts),
            "candidate_count": pa.array(np.add.reduceat(self.count, self.starts)),
            "best_time": _taken(self.column("time"), self.starts),
            "numbers": cells["numbers"],
            "texts": cells["texts"],
            "unseen": bits((row >= 0) & (seen == 0)),
            "conflicts": bits(conflicts),
            "r": _taken(self.column("r"), self.pair("r")),
            "x": _taken(self.column("x"), self.pair("x")),
            "listed": self.listed(),
        }
        return pa.RecordBatch.from_arrays([*out.values()], [*out])


def _merged_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted readings to rows of keys. The last key of a batch is open until another comes;
    an open key of many rows goes on as one row for each group of its values."""
    last = None
    for batch in batches:
        rows = _Readings(pa.Table.from_batches([batch]))
        rows = rows if last is None else last.then(rows)
        if not len(rows.starts):
            continue
        cut = int(rows.starts[-1])
        last = rows.part(cut, len(rows.rows))
        if cut:
            yield rows.part(0, cut).merged()
        if len(last.rows) > OPEN_ROWS:
            last = last.shortened()
    if last is not None:
        yield last.merged()


def merged(parses: DataFrame, key: str, place: str) -> DataFrame:
    """parses, the columns of reports.receipts with key and place (the order of a key's readings),
    to one row a key: the same columns without doc, fields_found, corrected_fields, conflicted_fields and
    candidate_count. Lists of paths are in the order of PATHS."""
    said = readings(parses, key, place).repartition(key).sortWithinPartitions(key, F.col("_merit").desc(), F.col("_place").asc()).drop("_merit", "_place")
    kinds = "candidate_count long, best_time string, numbers array<double>, texts array<string>, unseen long, conflicts long"
    schema = T.StructType([said.schema[key], *T._parse_datatype_string(kinds), said.schema["r"], said.schema["x"], said.schema["listed"]])
    rows = said.mapInArrow(_merged_batches, schema)
    text = {path: F.col("texts")[i] for i, path in enumerate(TEXTS)}
    number = {path: F.col("numbers")[i] for i, path in enumerate((*NUMBERS, *IMPEDANCE))}
    ohm = lambda f, c: F.coalesce(F.col(f"{c[0]}.{'low' if f == LOW else 'high'}"), number[f"bioelectrical.{f}.{c}"]).alias(c)
    wide = rows.select(
        key,
        F.coalesce(text["measured_at_local"], "best_time").alias("measured_at_local"),
        *(text[path].alias(c) for path, c in TEXTS.items() if path != "measured_at_local"),
        *(number[path].alias(c) for path, c in NUMBERS.items() if "." not in c),
        *(F.struct(*(number[f"reference_ranges.{path}.{end}"].alias(end) for end in ("min", "max"))).alias(c) for path, c in (("fat_percent", "fat_percent_range"), ("fat_mass_kg", "fat_mass_range"))),
        F.create_map(*(x for f in (LOW, HIGH) for x in (F.lit(f), F.struct(*(ohm(f, c) for c in ("r_ohm", "x_ohm")))))).alias("bioelectrical"),
        "candidate_count", "unseen", "conflicts", "listed",
    )
    done = checked(wide)
    inorder = lambda test: F.filter(F.array(*map(F.lit, PATHS)), test)
    bit = lambda c, i: F.getbit(c, i) == 1
    derived = inorder(lambda p, i: bit("unseen", i) | F.array_contains("corrected_fields", p))
    review = F.array_union(F.array(F.lit("measured_at_local")), F.array_union(inorder(lambda p: F.array_contains("listed", p)), F.sort_array("listed")))
    count = lambda names: sum((F.col(c).isNotNull().cast("int") for c in names[1:]), F.col(names[0]).isNotNull().cast("int"))
    found = done.withColumns({
        "derived_fields": derived,
        "conflicted_fields": inorder(lambda p, i: bit("conflicts", i) & p.rlike("^(" + "|".join(x.replace(".", r"\.") for x in MEANINGFUL) + ")")),
        "completeness": count(RECEIPT_CORE) / F.lit(float(len(RECEIPT_CORE))),
        "fields_found": count(RESULTS),
    })
    unlisted = F.filter("derived_fields", lambda p: ~F.array_contains("listed", p))
    return found.withColumn("review_fields", F.array_except(review, unlisted)).drop("unseen", "conflicts", "listed")
