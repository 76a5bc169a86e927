"""The log list: summary lines, labels, sort orders and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somalog.functions.scalars import half_up, number, number_text

#: Sort orders: column and whether it descends (fixed values).
ORDERS = {
    "date-desc": ("date_value", True),
    "date-asc": ("date_value", False),
    "type-asc": ("type", False),
    "source-asc": ("source", False),
    "duration-desc": ("duration_minutes", True),
    "duration-asc": ("duration_minutes", False),
    "energy-desc": ("active_energy_kcal", True),
    "energy-asc": ("active_energy_kcal", False),
    "weight-desc": ("weight_kg", True),
    "weight-asc": ("weight_kg", False),
    "fat-desc": ("fat_percent", True),
    "fat-asc": ("fat_percent", False),
    "hr-desc": ("average_bpm", True),
    "hr-asc": ("average_bpm", False),
}
#: What a flag hides: the column and its value (fixed values).
FLAGS = {
    "show_body": ("type", "Body composition"),
    "show_workout": ("type", "Workout"),
    "show_tanita": ("source", "TANITA DC-360"),
    "show_accuniq": ("source", "ACCUNIQ"),
    "show_apple_health": ("source", "Apple Health"),
}


def sort_keys(order: str, place: str) -> list[Column]:
    """An order's keys: nulls last both ways, then newest first, then the place of the row."""
    column, down = ORDERS.get(order, ORDERS["date-desc"])
    first = F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_last()
    return [first, F.col("date_value").desc_nulls_last(), F.col(place).asc()]


def sorted_view(items: DataFrame, order: str, place: str) -> DataFrame:
    """items in an order, as one range sort."""
    return items.orderBy(*sort_keys(order, place))


def ranked_view(items: DataFrame, order: str, place: str, within: list[str] | None = None) -> DataFrame:
    """items and view_rank, from 1, in each group of `within`."""
    window = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*sort_keys(order, place))
    return items.withColumn("view_rank", F.row_number().over(window))


def visible(flags: dict[str, bool], search: str = "") -> Column:
    """Rows that no flag set to False hides and whose search text holds the searched text."""
    shown = F.lit(True)
    for flag, on in flags.items():
        if on is False:
            column, value = FLAGS[flag]
            shown = shown & ~F.coalesce(F.col(column) == value, F.lit(False))
    wanted = search.strip().lower()
    return shown & F.lower(F.coalesce("search_text", F.lit(""))).contains(wanted) if wanted else shown


def counts(items: DataFrame, test: Column) -> DataFrame:
    """One row: n_visible and n_total."""
    return items.agg(F.count_if(test).alias("n_visible"), F.count(F.lit(1)).alias("n_total"))


def _joined(parts: list[tuple[Column, str]]) -> Column:
    return F.concat_ws(" · ", *(F.when(x.isNotNull(), F.concat(number_text(x), F.lit(unit))) for x, unit in parts))


def body_summary(weight: Column, fat: Column, muscle: Column) -> Column:
    return _joined([(weight, " kg"), (fat, "% fat"), (muscle, " kg muscle")])


def workout_summary(duration: Column, energy: Column, bpm: Column) -> Column:
    return _joined([(half_up(duration), " min"), (half_up(energy), " kcal"), (half_up(bpm), " bpm avg")])


#: Numbers that are read back from a summary line (fixed values).
SUMMARY_NUMBERS = {
    "duration_minutes": r"([\d.]+)\s*min\b",
    "active_energy_kcal": r"([\d.]+)\s*kcal\b",
    "weight_kg": r"([\d.]+)\s*kg\b",
    "fat_percent": r"([\d.]+)%\s*fat\b",
    "average_bpm": r"([\d.]+)\s*bpm\s*avg\b",
}


def reread(summary: Column, kind: Column) -> list[Column]:
    """Numbers as the list shows them: rounded, and the first number of kilograms as weight."""
    read = {name: number(F.regexp_extract(summary, f"(?i){pattern}", 1)) for name, pattern in SUMMARY_NUMBERS.items()}
    read["weight_kg"] = F.when(kind == "Body composition", read["weight_kg"])
    return [c.alias(name) for name, c in read.items()]


#: Words that labels write in their own way (fixed values).
ACRONYMS = {"id": "ID", "ffm": "FFM", "tbw": "TBW", "bmi": "BMI", "bmr": "BMR", "tdee": "TDEE", "kg": "kg", "kj": "kJ", "kcal": "kcal", "cm": "cm", "bpm": "bpm", "ohm": "Ω", "khz": "kHz"}


#: What fields are called (fixed values).
FIELD_LABELS = {
    "schema_version": "Schema version",
    "id": "Record ID",
    "kind": "Record type",
    "workout_type": "Workout type",
    "start_at": "Start time",
    "end_at": "End time",
    "duration_minutes": "Duration (minutes)",
    "active_energy_kcal": "Active energy (kcal)",
    "measured_at_local": "Measured at",
    "source.type": "Source type",
    "source.device": "Device",
    "source.manufacturer": "Manufacturer",
    "source.filename": "Source file",
    "input.body_type": "Body type",
    "input.gender": "Gender",
    "input.age": "Age",
    "input.height_cm": "Height (cm)",
    "input.clothes_weight_kg": "Clothes weight (kg)",
    "metrics.weight_kg": "Weight (kg)",
    "metrics.fat_percent": "Body fat (%)",
    "metrics.fat_mass_kg": "Fat mass (kg)",
    "metrics.ffm_kg": "Fat-free mass (kg)",
    "metrics.muscle_mass_kg": "Muscle mass (kg)",
    "metrics.tbw_kg": "Total body water (kg)",
    "metrics.tbw_percent": "Total body water (%)",
    "metrics.bone_mass_kg": "Bone mass (kg)",
    "metrics.bmr_kj": "BMR (kJ)",
    "metrics.bmr_kcal": "BMR (kcal)",
    "metrics.metabolic_age": "Metabolic age",
    "metrics.visceral_fat_rating": "Visceral fat rating",
    "metrics.bmi": "BMI",
    "metrics.ideal_body_weight_kg": "Ideal body weight (kg)",
    "metrics.degree_of_obesity_percent": "Degree of obesity (%)",
    "metrics.body_water_l": "Body water (L)",
    "metrics.protein_kg": "Protein (kg)",
    "metrics.minerals_kg": "Minerals (kg)",
    "metrics.tdee_kcal": "TDEE (kcal)",
    "metrics.physical_age": "Physical age",
    "analysis.score": "Analysis score",
    "targets.target_weight_kg": "Target weight (kg)",
    "targets.weight_control_kg": "Weight control (kg)",
    "targets.muscle_control_kg": "Muscle control (kg)",
    "targets.fat_control_kg": "Fat control (kg)",
    "qualitative.physique_rating": "Physique rating",
    "qualitative.body_type": "Body type",
    "qualitative.evaluation": "Evaluation",
    "bioelectrical.6.25_khz.r_ohm": "R 6.25 kHz (Ω)",
    "bioelectrical.50_khz.r_ohm": "R 50 kHz (Ω)",
    "bioelectrical.6.25_khz.x_ohm": "X 6.25 kHz (Ω)",
    "bioelectrical.50_khz.x_ohm": "X 50 kHz (Ω)",
    "indicators.fat_percent.reading": "Fat % indicator",
    "indicators.bmi.reading": "BMI indicator",
    "indicators.muscle_mass.reading": "Muscle mass indicator",
    "indicators.bmr.reading": "BMR indicator",
    "heart_rate_bpm.average_bpm": "Average heart rate (bpm)",
    "heart_rate_bpm.min_bpm": "Minimum heart rate (bpm)",
    "heart_rate_bpm.max_bpm": "Maximum heart rate (bpm)",
    "heart_rate_bpm.samples": "Heart-rate samples",
    "extraction.method": "Extraction method",
    "extraction.completeness": "Extraction completeness",
    "extraction.date_source": "Date source",
    "extraction.derived_fields": "Derived fields",
    "extraction.corrected_fields": "Corrected fields",
    "extraction.conflicted_fields": "Conflicted fields",
    "extraction.review_fields": "Review fields",
    "extraction.warnings": "Extraction warnings",
}


def field_label(path: Column, labels: dict[str, str] = FIELD_LABELS) -> Column:
    """A field path in words: a given label, else its segments' words with capitals."""
    acronyms = F.create_map(*(F.lit(x) for pair in ACRONYMS.items() for x in pair))
    word = lambda w: F.coalesce(F.try_element_at(acronyms, F.lower(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    segment = lambda s: F.array_join(F.transform(F.filter(F.split(F.replace(s, F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != ""), word), " ")
    made = F.array_join(F.transform(F.split(path, r"\."), segment), " · ")
    if not labels:
        return made
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), path), made)


def editor_path_visible(path: Column) -> Column:
    """Of the indicators only the readings are edited."""
    return ~path.startswith("indicators.") | path.endswith(".reading")


def flattened(records: DataFrame, key: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, path, kind, value): a row for each field; fields: column to (path, kind)."""
    items = F.array(*(F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.coalesce(number_text(F.col(c)) if kind == "number" else F.col(c).cast("string"), F.lit("")).alias("value")) for c, (path, kind) in fields.items()))
    return records.select(key, F.inline(items))
