"""Body measurement reports: extracted text to typed records.

Everything is column expressions over one row a document: texts are cut into sections and lines,
numbers are read behind their labels, and rules then repair and check them in order, each seeing
what the ones before it made. Two kinds of report are known: receipts of labelled lines, and
printed reports with a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somalog.functions import scalars as fn
from somalog.operators import solve

#: Label readings that are put right before parsing, in order (fixed values).
LABEL_REPAIRS = (
    (r"\bRE\s*SUL\s*T\b", "RESULT"),
    (r"\bBODY\s*[1I|]\s*YPE\b", "BODY TYPE"),
    (r"\bSTANDA[KX]D\b", "STANDARD"),
    (r"\bMAL\s+E\b", "MALE"),
    (r"\bMAL\b", "MALE"),
    (r"\bFEMAL\s+E\b", "FEMALE"),
    (r"\bWET\s*GHT\b", "WEIGHT"),
    (r"\bWE\s*TIGHT\b", "WEIGHT"),
    (r"\bHETGHT\b", "HEIGHT"),
    (r"\bHETGHI\b", "HEIGHT"),
    (r"\bH[ET]?\s*T?GHI\b", "HEIGHT"),
    (r"\bGENOE?R?\b", "GENDER"),
    (r"\b(?:AGT|ACE|AGF)\b", "AGE"),
    (r"\bCLOTH(?:LS|L5|FS|ES)\s+WET?GHT\b", "CLOTHES WEIGHT"),
    (r"\bFAI\b", "FAT"),
    (r"\bFAT\s+[17]\s*%", "FAT %"),
    (r"\b(?:T|1|\[)?BW\s+[17]\s*%", "TBW %"),
    (r"\b(?:1BW|\[BW|TRW|PGW)\b", "TBW"),
    (r"\bLBW\b", "TBW"),
    (r"\bFEM\b", "FFM"),
    (r"\bFT\s*M\b", "FFM"),
    (r"(?m)^\s*[I|]M(?=\s+[0-9BOSG])", "FFM"),
    (r"\bMUGCLE\b", "MUSCLE"),
    (r"\bMUSOLE\b", "MUSCLE"),
    (r"PHYS\s*TQUE", "PHYSIQUE"),
    (r"PHYSITQUE", "PHYSIQUE"),
    (r"\bOBE\s+SE\b", "OBESE"),
    (r"\bBI0ELECTRICAL\b", "BIOELECTRICAL"),
    (r"\bBTOELECTRICAL\b", "BIOELECTRICAL"),
    (r"\bK?B\s*[LT]?OELEC\s*TRI\s*CA[IL]\b", "BIOELECTRICAL"),
    (r"\bK?B[T]?OELECTRICAL\b", "BIOELECTRICAL"),
    (r"\bK?B\s*T?OELECTRICAL\b", "BIOELECTRICAL"),
    (r"\bBIOELECTRICAL\s+OATA\b", "BIOELECTRICAL DATA"),
    (r"(VISCERAL\s+FAT\s+RATING\s*)[&B](?=\W|$)", "$18"),
    (r"\bBM\s*[I1|]\b", "BMI"),
    (r"\bDES\s*TRABLE\b", "DESIRABLE"),
    (r"\bPNPUT\b", "INPUT"),
)
#: Rewrites that turn readings of printed numbers into numbers, in order (fixed values).
NUMBER_REPAIRS = (
    (r"[.,]{2,}", "."),
    (r"\b[OQ]\s*([.,])\s*(\d)", "0$1$2"),
    (r"([.,])\s*[IL|](?=\s*(?:K?G|%|\z))", "$11"),
    (r"A\s*G(?=[.,]\s*\d)", "49"),
    (r"(\d)\s*([.,])\s+(\d)", "$1$2$3"),
    (r"(\d)\.\s*/\s*(\d)", "$1.$2"),
    (r"(\d)\s*[/_]\s*(\d)", "$1.$2"),
    (r"(\d{1,3})-(\d)(?!\d)", "$1.$2"),
    (r"(\d{2,3})\s+(\d)(?=\s*(?:KG|KCAL|KJ|OHM|\z))", "$1.$2"),
)
#: Letters inside numbers, and the digits they are read for; B stands for three (fixed values).
DIGIT_LETTERS, B_DIGITS = (("OQ", "0"), ("IL|", "1"), ("Z", "2"), ("S", "5"), ("G", "6")), ("6", "8", "5")
#: What a line holds if any of NUMBER_REPAIRS, DIGIT_LETTERS or the readings of B, S and H changes it.
REPAIRABLE = r"[\d.,][BOQIL|ZSG]|[BOQIL|ZSGH]\d|[.,]\s*[BIL|]|[.,]{2}|[OQ]\s*[.,]|A\s*G[.,]|[.,]\s+\d|[/_]|\d-\d|\d\s+\d"
#: Receipt fields: section, label, excluded labels, least, most, lines looked ahead (fixed values).
RECEIPT_FIELDS = {
    "age": ("input", "AGE", (), 10, 100, 0),
    "height_cm": ("input", "HEIGHT", (), 100, 230, 0),
    "clothes_weight_kg": ("input", "CLOTHESWEIGHT", (), 0, 10, 2),
    "weight_kg": ("result", "WEIGHT", ("CLOTHES", "IDEAL"), 30, 300, 0),
    "fat_percent": ("result", "FAT%", (), 2, 70, 0),
    "fat_mass_kg": ("result", "FATMASS", (), 1, 150, 0),
    "ffm_kg": ("result", "FFM", (), 20, 250, 0),
    "muscle_mass_kg": ("result", "MUSCLEMASS", (), 10, 200, 0),
    "tbw_kg": ("result", "TBW", ("%",), 10, 150, 0),
    "tbw_percent": ("result", "TBW%", (), 20, 80, 0),
    "bone_mass_kg": ("result", "BONEMASS", (), 1, 10, 0),
    "bmr_kj": ("result", "BMR", (), 4000, 10000, 3),
    "metabolic_age": ("result", "METABOLICAGE", (), 10, 100, 0),
    "visceral_fat_rating": ("result", "VISCERALFATRATING", (), 1, 60, 0),
    "bmi": ("result", "BMI", (), 10, 70, 0),
    "ideal_body_weight_kg": ("result", "IDEALBODYWEIGHT", (), 30, 250, 1),
    "degree_of_obesity_percent": ("result", "DEGREEOFOBESITY", (), -80, 300, 1),
}
RECEIPT_CORE = ("weight_kg", "fat_percent", "ffm_kg", "muscle_mass_kg", "tbw_kg", "tbw_percent", "bone_mass_kg", "bmr_kcal", "visceral_fat_rating", "bmi")
REPORT_CORE = ("weight_kg", "fat_mass_kg", "ffm_kg", "muscle_mass_kg", "body_water_l", "bmr_kcal")
PHYSIQUES = ("OBESE", "STANDARD", "ATHLETIC", "THIN", "MUSCULAR", "UNDEREXERCISED")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _rewritten(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, kept in rules:
        text = F.regexp_replace(text, pattern, kept)
    return text


def labelled(text: Column) -> Column:
    """A receipt's text in capitals, with plain spaces, dashes and labels."""
    text = F.translate(F.coalesce(text, F.lit("")), "\r“”–— ", '\n""-- ')
    return _rewritten(F.upper(text), LABEL_REPAIRS)


def compact(line: Column) -> Column:
    """What labels are compared by."""
    return F.regexp_replace(line, "[^A-Z0-9%+.-]", "")


def tokens(line: Column) -> Column:
    """The numbers that a line may hold, likelier readings first. Most lines hold nothing to repair,
    and all their readings are alike."""
    plain = F.regexp_replace(line, r"(^|\s)[BSH](?=\d{2,3}[.,])", "$1")
    readings = []
    for b in B_DIGITS:
        text = F.regexp_replace(plain, r"([.,])\s*B(?=\s*(?:K?G|K|%|\z))", f"$1{b}")
        for letters, digit in (("B", b), *DIGIT_LETTERS):
            text = F.regexp_replace(text, rf"(?<=[0-9.,])[{letters}](?=[0-9.,A-Z]|\z)|[{letters}](?=[0-9])", digit)
        readings.append(F.regexp_replace(text, r"H(?=\d)", "5"))
    numbers = lambda text: F.regexp_extract_all(text, F.lit(r"[-+]?\d+(?:[.,]\d+)?"), F.lit(0))
    repaired = F.flatten(F.array(*(numbers(_rewritten(text, NUMBER_REPAIRS)) for text in (*readings, plain, line))))
    found = F.when(line.rlike(REPAIRABLE), repaired).otherwise(numbers(line))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")))


def section(text: Column, starts: str, ends: str) -> Column:
    """From the first start to the first end after it; the whole text without a start."""
    cut = F.regexp_extract(text, rf"(?s)(?:{starts}).*?(?=(?:{ends})|\z)", 0)
    return F.when(cut == "", text).otherwise(cut)


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def read_lines(rows: Column) -> Column:
    """For each line its label form, and it and up to three lines after it as one text; numbers are
    read of those only that a field asks for."""
    return F.transform(
        rows,
        lambda x, i: F.struct(compact(x).alias("label"), *((F.array_join(F.slice(rows, i + 1, n + 1), " ") if n else x).alias(f"ahead{n}") for n in range(4))),
    )


def value_behind(read: Column, label: str, exclude: Sequence[str], least: float, most: float, ahead: int) -> Column:
    """The first plausible number of the first line with the label that has one."""
    return F.try_element_at(values_behind(read, label, exclude, least, most, ahead), F.lit(1))


def values_behind(read: Column, label: str, exclude: Sequence[str], least: float, most: float, ahead: int) -> Column:
    def fits(x: Column) -> Column:
        test = x["label"].contains(label)
        for other in exclude:
            test = test & ~x["label"].contains(other)
        return test

    return F.flatten(F.transform(F.filter(read, fits), lambda x: F.filter(tokens(x[f"ahead{ahead}"]), lambda v: v.between(least, most))))


class _Rules:
    """Rules over a table of metrics, applied in order; they note what they derive and warn of."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows.withColumn("derived_fields", F.array().cast("array<string>")).withColumn("warnings", F.array().cast("array<string>"))

    def _note(self, column: str, test: Column, text: Column) -> None:
        self.rows = self.rows.withColumn(column, F.when(test, F.array_append(column, text)).otherwise(F.col(column)))

    def derive(self, name: str, value: Column, reason: str) -> None:
        """Fill a missing value."""
        self.rows = self.rows.withColumn("_new", F.when(F.col(name).isNull(), value))
        new = F.col("_new").isNotNull()
        self._note("derived_fields", new, F.lit(f"metrics.{name}"))
        self._note("warnings", new, F.concat(F.lit(f"{name} was not readable and was derived as "), fn.number_text(F.col("_new")), F.lit(f" {reason}.")))
        self.rows = self.rows.withColumn(name, F.coalesce(name, "_new")).drop("_new")

    def correct(self, name: str, value: Column, test: Column) -> None:
        """Replace a value that contradicts others."""
        test = F.coalesce(test, F.lit(False))
        self.rows = self.rows.withColumn("_new", F.when(test, value))
        new = F.col("_new").isNotNull()
        self._note("warnings", new, F.concat(F.lit(f"{name} "), fn.number_text(F.col(name)), F.lit(" contradicts other values; normalized to "), fn.number_text(F.col("_new")), F.lit(".")))
        self.rows = self.rows.withColumn(name, F.coalesce("_new", name)).drop("_new")

    def warn(self, test: Column, text: str) -> None:
        self._note("warnings", F.coalesce(test, F.lit(False)), F.lit(text))


def _some(name: str) -> Column:
    """A value that is there and not 0."""
    return F.when(F.col(name) != 0, F.col(name))


def receipts(docs: DataFrame) -> DataFrame:
    """(doc, text, source_name) to one row a receipt: time, input, metrics after repairs,
    completeness, warnings, derived fields and fields to review."""
    text = docs.select("doc", "source_name", labelled(F.col("text")).alias("t"))
    result = r"RESULT|\n\s*WEIGHT\b"
    cut = text.select(
        "*",
        lines(section(F.col("t"), "INPUT", result)).alias("input"),
        lines(section(F.col("t"), result, r"DESIRABLE|INDICATOR|PHYSIQUE\s+RATING|BIOELECTRICAL")).alias("result"),
        lines(section(F.col("t"), "DESIRABLE", r"INDICATOR|PHYSIQUE\s+RATING|BIOELECTRICAL")).alias("range"),
        F.when(F.col("t").contains("BIOELECTRICAL"), lines(section(F.col("t"), "BIOELECTRICAL", r"\z"))).alias("block"),
    )
    read = cut.select("*", *(read_lines(F.col(c)).alias(f"{c}_read") for c in ("input", "result", "range", "block")))
    rows = read.select("doc", "source_name", "t", "input", "result_read", "range_read", "block_read", *(value_behind(F.col(f"{part}_read"), label, exclude, low, high, ahead).alias(name) for name, (part, label, exclude, low, high, ahead) in RECEIPT_FIELDS.items()))

    kcal = values_behind(F.col("result_read"), "BMR", (), 1000, 3000, 3)
    nearest = F.array_min(F.transform(kcal, lambda x, i: F.struct(F.abs(x - F.col("bmr_kj") / 4.184).alias("off"), i.alias("i"), x.alias("v"))))["v"]
    rows = rows.withColumn("bmr_kcal", F.when(F.col("bmr_kj").isNotNull(), nearest).otherwise(F.try_element_at(kcal, F.lit(1))))

    rules = _Rules(rows)
    weight, fat, ffm = _some("weight_kg"), _some("fat_mass_kg"), _some("ffm_kg")
    rules.derive("ffm_kg", fn.round1(weight - fat), "from weight - fat mass")
    rules.derive("fat_mass_kg", fn.round1(weight - ffm), "from weight - FFM")
    percent = fn.round1(fat / weight * 100)
    rules.derive("fat_percent", percent, "from weight and fat mass")
    off = F.abs(F.col("fat_percent") - percent)
    tens = F.array_min(F.array(*(F.struct(F.abs(F.col("fat_percent") + k - percent).alias("off"), F.lit(k).alias("k")) for k in range(0, 60, 10))))
    rules.correct("fat_percent", F.when(off <= 1.0, percent).otherwise(F.col("fat_percent") + tens["k"]), ((off > 0.35) & (off <= 1.0)) | ((off > 3) & (tens["off"] <= 0.7) & (tens["k"] > 0)))
    muscle = fn.round1(ffm - _some("bone_mass_kg"))
    rules.derive("muscle_mass_kg", muscle, "from FFM - bone mass")
    off = F.abs(F.col("muscle_mass_kg") - muscle)
    rules.correct("muscle_mass_kg", muscle, (off > 0.35) & (off < 15))
    water = fn.round1(weight * _some("tbw_percent") / 100)
    rules.derive("tbw_kg", water, "from weight and TBW %")
    off = F.abs(F.col("tbw_kg") - water)
    rules.correct("tbw_kg", water, (off > 0.6) & (off < 10))
    rules.derive("tbw_percent", fn.round1(_some("tbw_kg") / weight * 100), "from TBW kg and weight")
    energy = fn.half_up(_some("bmr_kj") / 4.184)
    off = F.abs(_some("bmr_kcal") - energy)
    rules.correct("bmr_kcal", energy, (off > 40) & (off < 500))
    rules.derive("bmr_kcal", energy, "from the printed kJ value")
    rules.derive("bmr_kj", fn.half_up(_some("bmr_kcal") * 4.184), "from the printed kcal value")
    index = weight / (_some("height_cm") / 100) ** 2
    rules.derive("bmi", fn.round1(index), "from weight and height")
    ideal = _some("ideal_body_weight_kg")
    rules.derive("degree_of_obesity_percent", fn.round1((weight - ideal) / ideal * 100), "from weight and ideal weight")
    rules.warn(F.abs(index - _some("bmi")) > 0.35, "BMI does not match weight and height; review it.")
    rules.warn(F.abs(weight - fat - ffm) > 0.35, "Weight, fat mass and FFM do not reconcile; review them.")
    rules.warn(F.abs(weight * _some("fat_percent") / 100 - fat) > 0.45, "Fat %, weight and fat mass do not reconcile; review them.")

    def limits(label: str, low: float, high: float) -> Column:
        pair = values_behind(F.col("range_read"), label, (), low, high, 2)
        a, b = F.try_element_at(pair, F.lit(1)), F.try_element_at(pair, F.lit(2))
        return F.when(b > a, F.struct(a.alias("min"), b.alias("max")))

    inputs = F.array_join("input", "\n")
    one_of = lambda words, where: F.coalesce(*(F.when(where.rlike(rf"\b{w}\b"), w) for w in words))
    physique = fn.blank_to_null(F.regexp_extract(F.regexp_extract("t", r"(?s)PHYSIQUE\s+RATING.*?(?=BIOELECTRICAL|\z)", 0), rf"\b({'|'.join(PHYSIQUES)})\b", 1))
    time = receipt_time(F.col("t"), F.col("source_name"))
    core = rules.rows.withColumn("_core", sum((F.col(c).isNotNull().cast("int") for c in RECEIPT_CORE[1:]), F.col(RECEIPT_CORE[0]).isNotNull().cast("int")))
    return core.select(
        "doc",
        time.alias("measured_at_local"),
        one_of(("STANDARD", "ATHLETIC"), inputs).alias("body_type"),
        one_of(("MALE", "FEMALE"), inputs).alias("gender"),
        *RECEIPT_FIELDS,
        "bmr_kcal",
        limits("FAT%", 2, 70).alias("fat_percent_range"),
        limits("FATMASS", 1, 150).alias("fat_mass_range"),
        physique.alias("physique_rating"),
        impedance(F.col("block_read")).alias("bioelectrical"),
        (F.col("_core") / F.lit(float(len(RECEIPT_CORE)))).alias("completeness"),
        "warnings",
        "derived_fields",
        receipt_date(F.col("t"), F.col("source_name")).alias("date"),
        receipt_clock(F.col("t")).alias("time"),
        receipt_review_fields(F.col("input"), F.col("result_read.label"), F.col("range_read.label"), physique).alias("review_fields"),
    )


#: Where a receipt shows that it has a field: section, path, label, labels that rule a line out (fixed values).
RECEIPT_SIGNS = (
    ("input", "input.body_type", "BODYTYPE", ()),
    ("input", "input.gender", "GENDER", ()),
    ("input", "input.age", "AGE", ()),
    ("input", "input.height_cm", "HEIGHT", ()),
    ("input", "input.clothes_weight_kg", "CLOTHESWEIGHT", ()),
    ("result", "metrics.weight_kg", "WEIGHT", ("IDEAL", "CLOTHES")),
    ("result", "metrics.fat_percent", "FAT%", ("FATMASS",)),
    ("result", "metrics.fat_mass_kg", "FATMASS", ()),
    ("result", "metrics.ffm_kg", "FFM", ()),
    ("result", "metrics.muscle_mass_kg", "MUSCLEMASS", ()),
    ("result", "metrics.tbw_kg", "TBW", ("TBW%",)),
    ("result", "metrics.tbw_percent", "TBW%", ()),
    ("result", "metrics.bone_mass_kg", "BONEMASS", ()),
    ("result", "metrics.bmr_kj", "BMR", ()),
    ("result", "metrics.bmr_kcal", "BMR", ()),
    ("result", "metrics.metabolic_age", "METABOLICAGE", ()),
    ("result", "metrics.visceral_fat_rating", "VISCERALFATRATING", ()),
    ("result", "metrics.bmi", "BMI", ()),
    ("result", "metrics.ideal_body_weight_kg", "IDEALBODYWEIGHT", ()),
    ("result", "metrics.degree_of_obesity_percent", "DEGREEOFOBESITY", ()),
    ("range", "reference_ranges.fat_percent.min", "FAT%", ()),
    ("range", "reference_ranges.fat_percent.max", "FAT%", ()),
    ("range", "reference_ranges.fat_mass_kg.min", "FATMASS", ()),
    ("range", "reference_ranges.fat_mass_kg.max", "FATMASS", ()),
)
#: Fields that every receipt has (fixed values).
ALWAYS_REVIEWED = tuple(f"bioelectrical.{f}.{c}" for f in ("6.25_khz", "50_khz") for c in ("r_ohm", "x_ohm"))


def receipt_review_fields(input_lines: Column, result: Column, limits: Column, physique: Column) -> Column:
    """Paths of the fields that a receipt prints, in order, from its sections' lines; result and
    limits have their label forms."""
    parts = {"input": F.transform(input_lines, compact), "result": result, "range": limits}

    def shows(section: str, label: str, exclude: Sequence[str]) -> Column:
        def test(x: Column) -> Column:
            fits = x.contains(label)
            for other in exclude:
                fits = fits & ~x.contains(other)
            return fits

        return F.coalesce(F.exists(parts[section], test), F.lit(False))

    shown = [F.when(shows(section, label, exclude), F.lit(path)) for section, path, label, exclude in RECEIPT_SIGNS]
    rated = F.when(physique.isNotNull(), F.lit("qualitative.physique_rating"))
    return F.array_compact(F.array(F.lit("measured_at_local"), *shown, rated, *map(F.lit, ALWAYS_REVIEWED)))


def _resistances(values: Column) -> Column:
    """The two of some numbers that a resistance falls by nearly 65 between; else the first two."""
    fine = F.array_distinct(F.filter(values, lambda v: v.between(250, 1000)))
    pairs = F.flatten(F.transform(fine, lambda a, i: F.transform(fine, lambda b, j: F.struct(F.abs(a - b - 65).alias("off"), i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b")))))
    near = F.array_min(F.filter(pairs, lambda p: (p["a"] - p["b"]).between(15, 220) & (p["a"] / p["b"] <= 1.5)))
    return F.when(near.isNotNull(), F.array(near["a"], near["b"])).when(F.size(fine) >= 2, F.slice(fine, 1, 2))


def _reactances(values: Column, most: int) -> Column:
    fine = F.filter(values, lambda v: F.abs(v).between(3, most))
    return F.when(F.size(fine) >= 2, F.transform(F.slice(fine, 1, 2), lambda v: -F.abs(v)))


def impedance(read: Column) -> Column:
    """Map of frequency to (r_ohm, x_ohm) from the lines of the impedance block: labelled rows
    first, then the first row of two resistances, and the reactances in the three lines after it."""
    valued = F.transform(read, lambda x: F.struct(x["label"].alias("label"), tokens(x["ahead0"]).alias("v")))
    placed = F.transform(valued, lambda x, i: F.struct(i.alias("i"), x["label"].alias("label"), x["v"].alias("v"), _resistances(x["v"]).alias("r")))
    labelled_r = F.filter(placed, lambda p: p["label"].rlike("^(?:R|K)") & (F.size(p["v"]) >= 2) & p["r"].isNotNull())
    any_r = F.filter(placed, lambda p: p["r"].isNotNull())
    r = F.coalesce(F.try_element_at(labelled_r, F.lit(1)), F.try_element_at(any_r, F.lit(1)))
    labelled_x = F.transform(F.filter(placed, lambda p: p["label"].startswith("X")), lambda p: _reactances(p["v"], 300))
    after = F.transform(F.filter(placed, lambda p: (p["i"] > r["i"]) & (p["i"] <= r["i"] + 3)), lambda p: _reactances(p["v"], 200))
    x = F.coalesce(*(F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(1)) for found in (labelled_x, after)))
    at = lambda n: F.struct(F.try_element_at(r["r"], F.lit(n)).alias("r_ohm"), F.try_element_at(x, F.lit(n)).alias("x_ohm"))
    return F.when(r.isNotNull() | x.isNotNull(), F.create_map(F.lit("6.25_khz"), at(1), F.lit("50_khz"), at(2)))


def receipt_date(text: Column, name: Column) -> Column:
    """The file name's date before the printed one; null without either."""
    day = r"(\d{1,2}|[OQ]\d)\s*[/.-]\s*([A-Z]{3})\s*[/.-]\s*([20OQZSLI]{4})"
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.regexp_extract(text, day, 2))
    year = fn.repaired_digits(F.regexp_extract(text, day, 3))
    printed = F.when((month > 0) & year.rlike(r"^20\d{2}\z"), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(fn.repaired_digits(F.regexp_extract(text, day, 1)), 2, "0")))
    return F.coalesce(fn.file_date(name, "-_. "), printed)


def receipt_clock(text: Column) -> Column:
    """The first time that a clock can show, as `HH:MM`."""
    clocks = F.transform(F.regexp_extract_all(text, F.lit(r"\b[0-2OQIL]\d\s*[:.]\s*[0-5OQIL]\d\b"), F.lit(0)), lambda x: F.regexp_replace(fn.repaired_digits(x), r"\s*[:.]\s*", ":"))
    return F.try_element_at(F.filter(clocks, lambda x: x.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d\z")), F.lit(1))


def receipt_time(text: Column, name: Column) -> Column:
    """`YYYY-MM-DDTHH:MM:00`, midnight without a clock; null without a date."""
    return F.concat(receipt_date(text, name), F.lit("T"), F.coalesce(receipt_clock(text), F.lit("00:00")), F.lit(":00"))


def receipt_records(parsed: DataFrame, source_name: Column, method: str = "ocr") -> DataFrame:
    """Parsed or merged receipts as stored records: identity, source, input, metrics, ranges, extraction."""
    none, listed = F.array().cast("array<string>"), set(parsed.columns)
    of_merge = [F.col(c) if c in listed else none.alias(c) for c in ("corrected_fields", "conflicted_fields")]
    n = F.col("candidate_count") if "candidate_count" in listed else F.lit(None).cast("long")
    metrics = [c for c in (*RECEIPT_FIELDS, "bmr_kcal") if c not in ("age", "height_cm", "clothes_weight_kg")]
    return parsed.select(
        F.lit(1).alias("schema_version"),
        fn.stamp_id("tanita:", F.col("measured_at_local"), F.lit(None).cast("string")).alias("id"),
        F.lit("body_composition").alias("kind"),
        "measured_at_local",
        F.struct(F.lit("tanita_receipt").alias("type"), F.lit("TANITA DC-360").alias("device"), fn.blank_to_null(source_name).alias("filename")).alias("source"),
        F.struct("body_type", "gender", "age", "height_cm", "clothes_weight_kg").alias("input"),
        F.map_filter(F.create_map(*(x for c in metrics for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull()).alias("metrics"),
        F.struct(F.col("fat_percent_range").alias("fat_percent"), F.col("fat_mass_range").alias("fat_mass_kg")).alias("reference_ranges"),
        F.struct("physique_rating").alias("qualitative"),
        "bioelectrical",
        F.struct(F.lit(method).alias("method"), "completeness", "warnings", "derived_fields", *of_merge, n.alias("candidate_count"), "review_fields").alias("extraction"),
    )


def review_fields(text: Column, signs: dict[str, str], derived: Column | None) -> Column:
    """Paths whose sign a text shows, in order, without those that were derived."""
    derived = F.array().cast("array<string>") if derived is None else derived
    shown = F.array_compact(F.array(F.lit("measured_at_local"), *(F.when(text.rlike(f"(?i){sign}"), path) for path, sign in signs.items())))
    return F.array_except(F.array_distinct(shown), F.coalesce(derived, F.array().cast("array<string>")))


#: What shows that a printed report has a field (fixed values).
REPORT_SIGNS = {
    "metrics.body_water_l": r"Body\s+Water",
    "metrics.protein_kg": r"Protein\s+kg",
    "metrics.minerals_kg": r"Minerals\s+kg",
    "metrics.fat_mass_kg": r"Body\s+Fat\s+kg",
    "metrics.muscle_mass_kg": r"Muscle\s+Mass",
    "metrics.ffm_kg": r"Fat[- ]Free\s+Mass",
    "metrics.weight_kg": r"\bWeight\b",
    "metrics.bmr_kcal": r"\bBMR\b",
    "metrics.tdee_kcal": r"\bTDE\b",
    "metrics.physical_age": r"Physical\s+Age",
    "analysis.score": r"\bAnalysis\b",
    "qualitative.body_type": r"Body\s+Type\s*:",
    "targets.target_weight_kg": r"Target\s+Weight",
    "targets.weight_control_kg": r"Weight\s+Control",
    "targets.muscle_control_kg": r"Muscle\s+Control",
    "targets.fat_control_kg": r"Fat\s+Control",
}

_N, _R = r"([\d.,]+)", r"\(([\d.,]+)\s*~\s*([\d.,]+)\)"
#: The table of a printed report on one line: names of its groups, and its pattern.
TABLE_GROUPS = ("body_water_l", "body_water_min", "body_water_max", "body_water_sum", "protein_kg", "protein_min", "protein_max", "muscle_mass_kg", "muscle_mass_min", "muscle_mass_max", "minerals_kg", "minerals_min", "minerals_max", "ffm_kg", "ffm_min", "ffm_max", "fat_mass_kg", "fat_mass_min", "fat_mass_max", "weight_kg", "weight_min", "weight_max")
TABLE = rf"(?i)Body\s+Water\s+L\s*{_N}\s*{_R}\s*{_N}\s*Protein\s+kg\s*{_N}\s*{_R}\s*{_N}\s*{_R}\s*Minerals\s+kg\s*{_N}\s*{_R}\s*{_N}\s*{_R}\s*Body\s+Fat\s+kg\s*{_N}\s*{_R}\s*{_N}\s*{_R}"
#: Numbers that are printed behind words (fixed values).
PRINTED = {
    "bmr_kcal": r"\bBMR\s*([\d.,]+)\s*kcal",
    "tdee_kcal": r"\bTDE\s*([\d.,]+)\s*kcal",
    "physical_age": r"Physical\s+Age\s*(\d+)\s*Years",
    "target_weight_kg": r"Target\s+Weight\s*([\d.,]+)\s*kg",
    "weight_control_kg": r"Weight Control\s*([+-]?\d+(?:[.,]\d+)?)\s*kg",
    "muscle_control_kg": r"Muscle Control\s*([+-]?\d+(?:[.,]\d+)?)\s*kg",
    "fat_control_kg": r"Fat Control\s*([+-]?\d+(?:[.,]\d+)?)\s*kg",
}
SOLVED = {"weight": "weight_kg", "ffm": "ffm_kg", "fat": "fat_mass_kg", "muscle": "muscle_mass_kg", "minerals": "minerals_kg", "water": "body_water_l", "protein": "protein_kg"}


#: How a printed report tells its time.
STAMP = r"(?i)Date/Time\s+of\s+measurement\s*:\s*(\d{2,4})[./-](\d{1,2})[./-](\d{1,4})\s+(\d{1,2}):(\d{2})"


def report_time(text: Column, name: Column) -> Column:
    """The printed time; of the ways to read its date the one that the file name has, else the
    first that the calendar has."""
    a, b, c, hour, minute = (F.regexp_extract(text, STAMP, k) for k in range(1, 6))
    iso = lambda y, m, d: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    short = (F.length(a) == 2) & (F.length(c) == 2)
    ways = F.array(F.when(short, iso(F.concat(F.lit("20"), a), b, c)), F.when(short, iso(F.concat(F.lit("20"), c), b, a)), F.when(F.length(a) == 4, iso(a, b, c)))
    fine = F.filter(ways, lambda x: x.isNotNull() & F.try_to_date(x).isNotNull())
    named = fn.file_date(name)
    day = F.when(F.array_contains(fine, named), named).otherwise(F.coalesce(F.try_element_at(fine, F.lit(1)), named))
    return F.when(a != "", F.concat(day, F.lit("T"), F.lpad(hour, 2, "0"), F.lit(":"), minute, F.lit(":00"))).otherwise(F.concat(named, F.lit("T00:00:00")))


def printed_reports(docs: DataFrame) -> DataFrame:
    """(doc, text, source_name) to one row a report: metrics from its table, or solved from its
    loose numbers where the table cannot be read, targets, ranges, completeness and notes."""
    text = F.translate(F.coalesce("text", F.lit("")), " ", " ")
    base = docs.select("doc", "source_name", text.alias("t"), F.regexp_replace(text, r"\s+", " ").alias("flat"))
    table = base.select("*", F.regexp_extract("flat", TABLE, 0).alias("table"))
    names = [*TABLE_GROUPS]
    body_text = F.regexp_extract("t", r"(?is)Body\s+Composition\s+Analysis(.*?)(?:Shows\s+a\s+measurement|Thank\s+you|Selvas\s+Healthcare|\z)", 1)
    # every step is a column of its own, so it is computed once
    rows = table.select("*", body_text.alias("body"), F.regexp_extract("t", STAMP, 0).alias("stamp"))
    rows = rows.withColumn("body", F.when(F.col("body") == "", F.col("t")).otherwise(F.col("body")))
    loose = F.regexp_replace("body", r"\([\d.,]+\s*~\s*[\d.,]+\)", " ")
    numbers = F.transform(F.regexp_extract_all(loose, F.lit(r"(?<![A-Za-z])(-?\d+(?:[.,]\d+)?)(?![A-Za-z])"), F.lit(1)), fn.comma_number)
    rows = rows.withColumn("_v", F.when(F.col("table") == "", solve.plausible(numbers)))
    rows = rows.select("*", F.regexp_extract_all("table", F.lit(_N), F.lit(1)).alias("cells"), solve.solution(F.col("_v")).alias("_s"))
    cell = {name: fn.comma_number(F.get("cells", F.lit(k))).alias(name) for k, name in enumerate(TABLE_GROUPS)}
    printed = {name: fn.comma_number(F.regexp_extract("flat", f"(?i){p}", 1)).alias(name) for name, p in PRINTED.items()}
    rows = rows.select("doc", "source_name", "t", "flat", "table", "body", "stamp", *cell.values(), *printed.values(), *(F.col(f"_s.{k}").alias(f"_{v}") for k, v in SOLVED.items()))
    for name in SOLVED.values():
        rows = rows.withColumn(name, F.coalesce(name, f"_{name}"))
    for name, pattern in (("fat_mass_kg", r"Body\s+Fat\s+kg"), ("body_water_l", r"Body\s+Water\s+(?:L\s*)?"), ("protein_kg", r"Protein\s+kg"), ("minerals_kg", r"Minerals\s+kg")):
        rows = rows.withColumn(name, F.coalesce(name, fn.comma_number(F.regexp_extract("flat", rf"(?i){pattern}\s*([\d.,]+)", 1))))

    rules = _Rules(rows)
    rules.derive("weight_kg", fn.round1(F.col("ffm_kg") + F.col("fat_mass_kg")), "from fat-free mass + fat mass")
    rules.derive("ffm_kg", fn.round1(F.col("weight_kg") - F.col("fat_mass_kg")), "from weight - fat mass")
    rules.rows = rules.rows.withColumn("fat_percent", F.lit(None).cast("double"))
    rules.derive("fat_percent", fn.round1(F.col("fat_mass_kg") / F.col("weight_kg") * 100), "from fat mass / weight")
    rules.warn((F.col("table") == "") & F.col("_weight_kg").isNull(), "The composition table was only partially recognized; review its values.")
    rules.warn(F.abs(F.col("weight_kg") - F.col("ffm_kg") - F.col("fat_mass_kg")) > 0.25, "Weight, fat-free mass and fat mass do not reconcile; review them.")
    core = sum((F.col(c).isNotNull().cast("int") for c in REPORT_CORE[1:]), F.col(REPORT_CORE[0]).isNotNull().cast("int"))
    ranged = with_ranges(rules.rows, F.when(F.col("table") == "", F.col("body")))
    kind = F.trim(F.regexp_extract("t", r"(?i)Body\s+Type\s*:\s*([^\r\n]+)", 1))
    evaluation = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("t", r"(?is)Comprehensive\s+Evaluation\s+(.*?)(?=\s+Analysis\b)", 1), r"(?i)\+More", ""), r"\s+", " "))
    found = [F.when(F.col(f"{key}_range").isNotNull(), F.lit(f"reference_ranges.{name}.{end}")) for name, key in RANGED.items() for end in ("min", "max")]
    review = F.array_distinct(F.concat(review_fields(F.col("t"), REPORT_SIGNS, None), F.array_compact(F.array(*found))))
    return ranged.select(
        "doc",
        report_time(F.col("stamp"), F.col("source_name")).alias("measured_at_local"),
        "fat_percent",
        *SOLVED.values(),
        *PRINTED,
        fn.comma_number(F.regexp_extract("t", r"(?is)\bAnalysis\b.{0,180}?\b(\d{1,3})\b", 1)).alias("score"),
        fn.blank_to_null(kind).alias("body_type"),
        fn.blank_to_null(evaluation).alias("evaluation"),
        *(f"{key}_range" for key in RANGED.values()),
        (core / F.lit(float(len(REPORT_CORE)))).alias("completeness"),
        "warnings",
        "derived_fields",
        F.array_except(review, "derived_fields").alias("review_fields"),
    )


#: Metrics of a printed report that have a range, in the order they are printed in.
RANGED = {"body_water_l": "body_water", "protein_kg": "protein", "muscle_mass_kg": "muscle_mass", "minerals_kg": "minerals", "ffm_kg": "ffm", "fat_mass_kg": "fat_mass", "weight_kg": "weight"}


def with_ranges(rows: DataFrame, loose: Column) -> DataFrame:
    """rows, which have metrics and the ends of ranges read from a table, with <key>_range (min, max).
    Ranges that stand in loose text are dealt to the metrics one to one at the least cost (see
    solve.assigned_ranges); there are none if the text has fewer than metrics."""
    pairs = F.transform(F.regexp_extract_all(loose, F.lit(_R), F.lit(0)), lambda x: F.struct(*(fn.comma_number(F.regexp_extract(x, _R, k)).alias(end) for k, end in ((1, "min"), (2, "max")))))
    known = F.filter(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in RANGED)), lambda x: x["value"].isNotNull())
    rows = rows.withColumn("_pairs", F.filter(pairs, lambda p: p["min"].isNotNull() & p["max"].isNotNull())).withColumn("_known", known)
    rows = rows.withColumn("_dealt", solve.assigned_ranges(F.col("_known.value"), F.col("_pairs.min"), F.col("_pairs.max")))

    def limits(name: str, key: str) -> Column:
        low, high = F.col(f"{key}_min"), F.col(f"{key}_max")
        at = F.get("_dealt", F.array_position("_known.name", F.lit(name)).cast("int") - 1)
        return F.coalesce(F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("min"), high.alias("max"))), F.get("_pairs", at)).alias(f"{key}_range")

    return rows.select(*(c for c in rows.columns if c not in ("_pairs", "_known", "_dealt")), *(limits(*x) for x in RANGED.items()))


def report_records(parsed: DataFrame, source_name: Column, method: str = "pdf-text") -> DataFrame:
    """Parsed printed reports as stored records: identity, source, metrics, targets, ranges, extraction."""
    filled = lambda names: F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull())
    return parsed.select(
        F.lit(1).alias("schema_version"),
        fn.stamp_id("accuniq:", F.col("measured_at_local"), F.lit(None).cast("string")).alias("id"),
        F.lit("body_composition").alias("kind"),
        "measured_at_local",
        F.struct(F.lit("accuniq_report").alias("type"), F.lit("ACCUNIQ").alias("device"), F.lit("Selvas Healthcare Inc.").alias("manufacturer"), fn.blank_to_null(source_name).alias("filename")).alias("source"),
        filled([*RANGED, "fat_percent", "bmr_kcal", "tdee_kcal", "physical_age"]).alias("metrics"),
        filled(["target_weight_kg", "weight_control_kg", "muscle_control_kg", "fat_control_kg"]).alias("targets"),
        F.struct("score").alias("analysis"),
        F.struct(*(F.col(f"{key}_range").alias(name) for name, key in RANGED.items())).alias("reference_ranges"),
        F.struct("body_type", "evaluation").alias("qualitative"),
        F.struct(F.lit(method).alias("method"), "completeness", "warnings", "derived_fields", "review_fields").alias("extraction"),
    )


#: Free-text fields: source, path, and pattern (fixed values).
TEXT_FIELDS = (
    ("tanita", "input.body_type", r"\bBODY\s+TYPE\s*[:=\-]?\s*(.{1,80}?)(?=\s+(?:GENDER\b|AGE\b|HEIGHT\b|CLOTHES\s+WEIGHT\b|RESULT\b|---)|$)"),
    ("tanita", "input.gender", r"\bGENDER\s*[:=\-]?\s*(.{1,50}?)(?=\s+(?:AGE\b|HEIGHT\b|CLOTHES\s+WEIGHT\b|RESULT\b|---)|$)"),
    ("tanita", "qualitative.physique_rating", r"\bPHYSIQUE\s+RATING\s*[:=\-]?\s*(.{1,80}?)(?=\s+(?:BIOELECTRICAL(?:\s+DATA)?\b|6(?:\.25)?\s*K?HZ\b|---)|$)"),
    ("accuniq", "qualitative.body_type", r"\bBODY\s+TYPE\s*:\s*(.{1,100}?)(?=\s+(?:VALUES\b|BODY\s+COMPOSITION\b|COMPREHENSIVE\s+EVALUATION\b|SHOWS\b|ANALYSIS\b|---)|$)"),
)


def clean_candidate(text: Column) -> Column:
    """A found text without its frame; blank if it is too long or none."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[:=\-\s]+", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\|+", " "), r"\s+", " "), r"[,:;\-\s]+$", ""))
    return F.when((F.length(text) > 120) | text.rlike(r"(?i)GOOGLE\s+VISION|EXTRACTION\s+DIAGNOSTICS"), "").otherwise(text)


def recovered_texts(docs: DataFrame) -> DataFrame:
    """(doc, path, value): the best free text of each field: most words, then longest."""
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\r ", "\n "), r"\s+", " "))
    source = F.when(F.lower("source_name").contains("tanita"), "tanita").when(F.lower("source_name").contains("accuniq"), "accuniq").otherwise("unknown")
    rows = docs.select("doc", flat.alias("flat"), source.alias("source"))

    def best(pattern: str) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all("flat", F.lit(f"(?i){pattern}"), F.lit(1)), clean_candidate), lambda x: x != "")
        return F.array_min(F.transform(found, lambda x, i: F.struct((-F.size(F.split(x, " "))).alias("w"), (-F.length(x)).alias("n"), i.alias("i"), x.alias("v"))))["v"]

    items = F.array(*(F.struct(F.lit(path).alias("path"), F.when(F.col("source").isin("unknown", kind), best(p)).alias("value")) for kind, path, p in TEXT_FIELDS))
    return rows.select("doc", F.inline(items)).where("value IS NOT NULL")


def prefers_recovered(current: Column, recovered: Column) -> Column:
    """True if a recovered text says more than the current one."""
    a, b = F.upper(clean_candidate(current)), F.upper(clean_candidate(recovered))
    words = lambda x: F.size(F.split(x, " "))
    return (b != "") & ((a == "") | ((F.length(b) > F.length(a)) & (b.contains(a) | (words(b) > words(a)))))
