"""Column functions: numbers, times, identities, readings and labels as the logs define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
#: Levels of an indicator with four sections, and with three (fixed values).
FOUR_LEVELS, THREE_LEVELS = ("-", "0", "+", "++"), ("-", "0", "+")


def number(text: Column, blank_is_zero: bool = False) -> Column:
    """A whole text as a number, white space around it aside; null for anything else."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    value = F.when(plain.rlike(NUMBER), plain.cast("double")).when(plain.rlike(r"^0[xX][0-9a-fA-F]{1,15}\z"), F.conv(F.substring(plain, 3, 20), 16, 10).cast("double"))
    return F.when(plain == "", F.lit(0.0)).otherwise(value) if blank_is_zero else value


def comma_number(text: Column) -> Column:
    """A number whose first comma is a decimal point."""
    return number(F.regexp_replace(text, r"^([^,]*),", r"$1."))


def half_up(x: Column) -> Column:
    """To a whole number, halves upwards (also below zero)."""
    return F.floor(x + 0.5).cast("double")


def round1(x: Column) -> Column:
    """To one decimal, halves upwards."""
    return F.floor(x * 10 + 0.5) / F.lit(10.0)


def number_text(x: Column) -> Column:
    """A number as people write it: without a fraction if it is whole."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def export_time(text: Column) -> Column:
    """`2030-01-15 10:30:00 +0800` as `2030-01-15T10:30:00+08:00`; other texts get a T for their
    first space; blank is null."""
    full = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{2})(\d{2})\z"
    return F.when(text.rlike(full), F.regexp_replace(text, full, "$1T$2$3:$4")).otherwise(F.regexp_replace(blank_to_null(text), r"^([^ ]*) ", "$1T"))


def epoch_ms(text: Column) -> Column:
    """Milliseconds of a time with an offset, in the export's or the normal form; null if none."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})T", "$1 "), r" ?([+-]\d{2}):?(\d{2})\z", " $1$2")
    return F.unix_millis(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss Z")))


def minutes(value: Column, unit: Column) -> Column:
    """A duration in minutes: seconds and hours are converted, other units are taken as they are."""
    name = F.lower(F.coalesce(unit, F.lit("min")))
    return F.when(name.startswith("sec") | (name == "s"), value / 60).when(name.startswith("hour") | name.isin("hr", "h"), value * 60).otherwise(value)


def unit_matches(unit: Column, pattern: str, default: str) -> Column:
    """True if a unit, or the default where it is missing, holds the pattern, in any case."""
    return F.coalesce(blank_to_null(unit), F.lit(default)).rlike(f"(?i){pattern}")


def event_time(measured: Column, start: Column) -> Column:
    """The first of two time texts that is not blank, or blank."""
    return F.coalesce(blank_to_null(measured), blank_to_null(start), F.lit(""))


def period(time: Column) -> Column:
    """The month a time text begins with, or `unknown`."""
    return F.coalesce(blank_to_null(F.regexp_extract(time, r"^\d{4}-\d{2}", 0)), F.lit("unknown"))


def period_path(time: Column) -> Column:
    return F.concat(F.lit("data/events/"), period(time), F.lit(".json"))


def filename_key(name: Column) -> Column:
    """File names that differ in case and outer white space alone are the same; blank is null."""
    return blank_to_null(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+\z", "")))


def stamp_id(prefix: str, measured: Column, day: Column) -> Column:
    """A measurement's id: its time, else its day, else `pending`."""
    return F.concat(F.lit(prefix), F.coalesce(blank_to_null(measured), blank_to_null(day), F.lit("pending")))


def file_date(name: Column, separators: str = "-_.") -> Column:
    """The date in a file name, as ISO text, or null."""
    sep = f"[{separators}]" if separators != " " else " "
    return F.regexp_replace(blank_to_null(F.regexp_extract(name, rf"20\d{{2}}{sep}\d{{2}}{sep}\d{{2}}", 0)), r"^(\d{4}).(\d{2}).(\d{2})\z", "$1-$2-$3")


def repaired_digits(text: Column) -> Column:
    """Letters that are read for digits, as the digits."""
    return F.translate(text, "OQILZS", "001125")


def upload_kind(name: Column, mime: Column) -> Column:
    """What an uploaded file is, by name and MIME type."""
    name, mime = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(name.endswith(".zip") | mime.isin("application/zip", "application/x-zip-compressed"), "apple_health_zip")
        .when(name.endswith(".xml") | mime.contains("xml"), "apple_health_xml")
        .when(name.endswith(".pdf") | (mime == "application/pdf") | mime.startswith("image/") | name.rlike(r"\.(png|jpe?g|webp|heic|heif)\z"), "body_composition_report")
        .otherwise("unknown")
    )


#: What gives a report's source away, in order (fixed values).
REPORT_SIGNS = (
    ("accuniq", r"\bACCUNIQ\b|Selvas\s+Healthcare|Comprehensive\s+Evaluation|ACCUNIQ\s+Manager"),
    ("tanita", r"\bTANITA\b|DC\s*[-–]?\s*360|VISCERAL\s+FAT\s+RATING|BIOELECTRICAL\s+DATA"),
)


def report_source(text: Column, name: Column) -> Column:
    """Which device a report's text and file name point to."""
    both = F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(name, F.lit("")))
    out = None
    for source, sign in REPORT_SIGNS:
        test = both.rlike(f"(?i){sign}")
        out = F.when(test, source) if out is None else out.when(test, source)
    return out.otherwise("unknown")


#: Names of sources and kinds for display (fixed values).
SOURCE_NAMES = {"accuniq": "ACCUNIQ", "accuniq_report": "ACCUNIQ", "tanita": "TANITA DC-360", "tanita_receipt": "TANITA DC-360", "apple_health_zip": "Apple Health", "apple_health_xml": "Apple Health", "apple_health": "Apple Health"}
KIND_NAMES = {"body_composition": "Body composition", "workout": "Workout"}


def _named(value: Column, names: dict[str, str], other: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(value, F.lit(""))), other)


def source_label(kind: Column, device: Column | None = None) -> Column:
    """A source's name; else its device, its type, or `Unknown`."""
    other = F.coalesce(*([] if device is None else [blank_to_null(device), blank_to_null(kind)]), F.lit("Unknown"))
    return _named(kind, SOURCE_NAMES, other)


def kind_label(kind: Column) -> Column:
    return _named(kind, KIND_NAMES, kind)


def _sections(levels: tuple[str, ...], position: Column, most: int, bounds: tuple[Column, ...] | None = None) -> tuple[Column, Column]:
    at = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), position))
    ends = bounds or tuple(F.lit(i / len(levels)) for i in range(len(levels) + 1))
    level, percent = F.lit(levels[-1]), None
    part = lambda i: F.floor((at - ends[i]) / F.greatest(F.lit(0.000001), ends[i + 1] - ends[i]) * 100 / 5 + 0.5) * 5
    percent = part(len(levels) - 1)
    for i in reversed(range(len(levels) - 1)):
        level = F.when(at < ends[i + 1], levels[i]).otherwise(level)
        percent = F.when(at < ends[i + 1], part(i)).otherwise(percent)
    return level, F.greatest(F.lit(0), F.least(F.lit(most), percent)).cast("int")


def reading(level: Column, percent: Column) -> Column:
    return F.concat(level, F.lit(": "), percent.cast("string"), F.lit("%"))


def band_reading(name: Column, position: Column) -> Column:
    """Struct (level, section_percent, reading) of a position between 0 and 1; full sections count
    as 100 %."""
    return _reading(name, position, 100)


def position_reading(name: Column, position: Column, ticks: Column | None = None) -> Column:
    """The same, but a section ends at 95 %. ticks: an array of the positions between sections, where they
    are not equally long."""
    return _reading(name, position, 95, ticks)


def _reading(name: Column, position: Column, most: int, ticks: Column | None = None) -> Column:
    def of(levels: tuple[str, ...]) -> Column:
        bounds = None if ticks is None else (F.lit(0.0), *(F.get(ticks, F.lit(i)) for i in range(len(levels) - 1)), F.lit(1.0))
        level, percent = _sections(levels, position, most, bounds)
        return F.struct(level.alias("level"), percent.alias("section_percent"), reading(level, percent).alias("reading"))

    return F.when(name.isin("fat_percent", "bmi"), of(FOUR_LEVELS)).otherwise(of(THREE_LEVELS))


READING = r"^(\+\+|\+|0|-)\s*:\s*(\d{1,3})%\z"


def parsed_reading(text: Column, quantize: str) -> Column:
    """Struct (level, percent) of a reading, in steps of 5 up to 95; null if it is none.
    quantize: `floor` or `round`."""
    plain = F.trim(text)
    value = F.regexp_extract(plain, READING, 2)
    steps = value.cast("double") / 5
    percent = F.least(F.lit(95), (F.floor(steps) if quantize == "floor" else F.floor(steps + 0.5)) * 5).cast("int")
    return F.when(plain.rlike(READING), F.struct(F.regexp_extract(plain, READING, 1).alias("level"), percent.alias("percent")))


def stepped_reading(text: Column, direction: Column, levels: tuple[str, ...]) -> Column:
    """A reading one step of 5 % up or down, on to the next level at its ends."""
    names = F.array(*(F.lit(x) for x in levels))
    now = parsed_reading(text, "floor")
    place = F.greatest(F.array_position(names, now["level"]) - 1, F.lit(0)).cast("int")
    at = F.coalesce(place * 20 + now["percent"] / 5, F.lit(0)).cast("int") + F.signum(direction).cast("int")
    at = F.greatest(F.lit(0), F.least(F.lit(20 * len(levels) - 1), at))
    return reading(F.element_at(names, (F.floor(at / 20) + 1).cast("int")), (at % 20 * 5).cast("int"))


def decimal_step(value: Column, direction: Column, step: float = 0.1) -> Column:
    """A number one step up or down, rounded to the step's decimals; no number counts as 0."""
    scale = 10.0 ** len(f"{step}".partition(".")[2].rstrip("0"))
    return F.floor((F.coalesce(value, F.lit(0.0)) + direction * step) * scale + 0.5) / scale


def redacted(text: Column) -> Column:
    """A text without service keys, its white space collapsed."""
    text = F.regexp_replace(text, r"AIza[0-9A-Za-z_-]{20,}", "[redacted-api-key]")
    text = F.regexp_replace(text, r"(?i)([?&](?:key|api_key)=)[^&\s]+", "$1[redacted]")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def escaped_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def text_from_base64(x: Column) -> Column:
    return F.decode(F.unbase64(x), "UTF-8")


def base64_from_text(x: Column) -> Column:
    return F.base64(F.encode(x, "UTF-8"))


def path_from_segments(path: Column) -> Column:
    """A path with each segment escaped for a URL, without outer slashes."""
    return F.array_join(F.transform(F.split(F.regexp_replace(path, r"^/+|/+\z", ""), "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def coerced(raw: Column, kind: str) -> Column:
    """An edited text as its kind; a bad number or JSON text is an error, a blank number null."""
    if kind == "number":
        return F.when(F.trim(raw) == "", F.lit(None).cast("double")).otherwise(F.coalesce(number(raw), F.raise_error(F.concat(F.lit("Invalid number: "), raw)).cast("double")))
    if kind == "boolean":
        return F.coalesce(raw == "true", F.lit(False))
    if kind == "json":
        return F.parse_json(F.coalesce(blank_to_null(raw), F.lit("[]")))
    return raw.cast("string")


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and plain numbers, so equal documents are equal texts."""
    return F.to_json(F.try_parse_json(text))
