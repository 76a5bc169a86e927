import random

from pyspark.sql import functions as F

from somalog.operators import reports

RECEIPT = """~ body scan, station 12 ~
printed 7:05   03/NOV/2031
INPUT
  HEIGHT       164.5 cm
  GENDER       FEMALE
  CLOTHES WEIGHT
     1.2 kg
  BODY TYPE    ATHLETIC
  AGE          47
RESULT
  BMI          21.6
  BMR          5230 kJ    1250 kcal
  VISCERAL FAT RATING   4
  METABOLIC AGE         39
  WEIGHT       58.4 kg
  FFM          44.2 kg
  FAT MASS     14.2 kg
  FAT %        24.3 %
  TBW %        54.6 %
  TBW          31.9 kg
  BONE MASS    2.3 kg
  MUSCLE MASS  41.9 kg
  DEGREE OF OBESITY     -1.8 %
  IDEAL BODY WEIGHT     59.5 kg
DESIRABLE RANGE
  FAT MASS     13.2 - 19.8 kg
  FAT %        23.0 - 33.9 %
PHYSIQUE RATING   MUSCULAR
BIOELECTRICAL DATA
              6.25 kHz    50 kHz
  X           -31.0       -58.5
  R           712.4       648.1
taken at 07:06
"""
REPORT = """Practice at the harbour
Body Type: Slim, trained
Physical Age 41Years
Weight Control +1.5 kg Target Weight 64.0 kg
Fat Control -2.5 kg
Muscle Control +4.0 kg
BMR 1346 kcal TDE 1952 kcal
Date/Time of measurement: 2031-11-03 07:05
Comprehensive Evaluation Keep up
the swimming +More
Analysis
of all parts: 73 points
Body Composition Analysis
Body Water L 33.1 (29.8 ~ 36.4) 33.1
Protein kg 8.9 (8.1 ~ 9.9) 42.0 (38.5 ~ 45.9)
Minerals kg 3.2 (2.8 ~ 3.6) 45.2 (41.0 ~ 49.9)
Body Fat kg 17.3 (11.2 ~ 18.0) 62.5 (52.0 ~ 70.4)
Thank you
"""


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc string, text string, source_name string")


def test_receipts(spark):
    wrong_energy = RECEIPT.replace("1250 kcal", "1450 kcal")
    garbled = RECEIPT.replace("  FFM          44.2 kg\n", "").replace("41.9 kg", "4I.9 kg")
    short = "RESULT\nBMI 30.2\nWEIGHT 91.7kg"
    rows = docs(spark, ("whole", RECEIPT, "2031-11-03 x.pdf"), ("energy", wrong_energy, ""), ("short", short, "2032-05-06 scan.pdf"), ("none", None, None), ("garbled", garbled, "s"))
    got = {r.doc: r for r in reports.receipts(rows).collect()}
    a = got["whole"]
    assert (a.measured_at_local, a.weight_kg, a.fat_percent, a.bmr_kcal, a.bmr_kj) == ("2031-11-03T07:06:00", 58.4, 24.3, 1250.0, 5230.0)
    assert (a.body_type, a.gender, a.age, a.height_cm, a.clothes_weight_kg, a.physique_rating) == ("ATHLETIC", "FEMALE", 47.0, 164.5, 1.2, "MUSCULAR")
    assert (a.tbw_kg, a.tbw_percent, a.bone_mass_kg, a.muscle_mass_kg, a.visceral_fat_rating, a.metabolic_age) == (31.9, 54.6, 2.3, 41.9, 4.0, 39.0)
    assert a.completeness == 1.0 and a.warnings == [] and tuple(a.fat_percent_range) == (23.0, 33.9) and tuple(a.fat_mass_range) == (13.2, 19.8)
    assert {k: tuple(v) for k, v in a.bioelectrical.items()} == {"6.25_khz": (712.4, -31.0), "50_khz": (648.1, -58.5)}
    assert got["energy"].bmr_kcal == 1250 and "normalized to 1250" in " ".join(got["energy"].warnings)
    assert got["short"].measured_at_local == "2032-05-06T00:00:00" and got["short"].bioelectrical is None and got["short"].weight_kg == 91.7
    assert got["none"].weight_kg is None and got["none"].completeness == 0
    assert got["garbled"].ffm_kg == 44.2 and got["garbled"].derived_fields == ["metrics.ffm_kg"] and got["garbled"].muscle_mass_kg == 41.9


def test_printed_reports(spark):
    loose = REPORT.replace("Body Water L ", "").replace("Protein kg ", "")
    got = {r.doc: r for r in reports.printed_reports(docs(spark, ("a", REPORT, "2031-11-03 scan.pdf"), ("b", loose, ""), ("c", None, ""))).collect()}
    a = got["a"]
    assert (a.measured_at_local, a.weight_kg, a.fat_mass_kg, a.fat_percent, a.ffm_kg, a.muscle_mass_kg, a.body_water_l, a.protein_kg, a.minerals_kg) == ("2031-11-03T07:05:00", 62.5, 17.3, 27.7, 45.2, 42.0, 33.1, 8.9, 3.2)
    assert (a.bmr_kcal, a.tdee_kcal, a.physical_age, a.target_weight_kg, a.weight_control_kg, a.muscle_control_kg, a.fat_control_kg, a.score, a.body_type) == (1346.0, 1952.0, 41.0, 64.0, 1.5, 4.0, -2.5, 73.0, "Slim, trained")
    assert tuple(a.weight_range) == (52.0, 70.4) and tuple(a.minerals_range) == (2.8, 3.6) and a.completeness == 1.0 and a.evaluation == "Keep up the swimming"
    b = got["b"]
    assert (b.weight_kg, b.ffm_kg, b.fat_mass_kg, b.muscle_mass_kg) == (62.5, 45.2, 17.3, 42.0)
    assert got["c"].completeness == 0


def test_ranges_and_records_of_printed_reports(spark):
    loose = REPORT.replace("Body Water L ", "").replace("Protein kg ", "")
    few = loose.replace("(8.1 ~ 9.9)", "")
    rows = docs(spark, ("table", REPORT, "2031-11-03 scan.pdf"), ("loose", loose, ""), ("few", few, ""), ("none", None, ""))
    parsed = reports.printed_reports(rows)
    got = {r.doc: r for r in parsed.collect()}
    ranges = {"body_water": (29.8, 36.4), "protein": (8.1, 9.9), "muscle_mass": (38.5, 45.9), "minerals": (2.8, 3.6), "ffm": (41.0, 49.9), "fat_mass": (11.2, 18.0), "weight": (52.0, 70.4)}
    for doc in ("table", "loose"):
        assert {k: tuple(got[doc][f"{k}_range"]) for k in ranges} == ranges
        assert "reference_ranges.minerals_kg.max" in got[doc].review_fields and "metrics.fat_percent" not in got[doc].review_fields
    assert all(got["few"][f"{k}_range"] is None for k in ranges) and got["none"].review_fields == ["measured_at_local"]
    (record,) = reports.report_records(parsed.where("doc = 'loose'"), F.lit("scan.pdf")).collect()
    assert record.id == "accuniq:2031-11-03T07:05:00" and record.metrics["weight_kg"] == 62.5 and record.targets == {"target_weight_kg": 64.0, "weight_control_kg": 1.5, "muscle_control_kg": 4.0, "fat_control_kg": -2.5}
    assert tuple(record.reference_ranges.fat_mass_kg) == (11.2, 18.0) and record.analysis.score == 73.0 and record.source.manufacturer and record.extraction.method == "pdf-text"


def test_free_texts(spark):
    rows = docs(spark, ("a", "BODY TYPE: Standard\nBody Type: Standard muscular build Values", "accuniq"), ("b", "GENDER MALE AGE 3", "tanita"))
    got = {(r.doc, r.path): r.value for r in reports.recovered_texts(rows).collect()}
    assert got[("b", "input.gender")] == "MALE" and {doc for doc, _ in got} == {"a", "b"}
    assert got[("a", "qualitative.body_type")] == "Standard Body Type: Standard muscular build"
    pairs = spark.createDataFrame([("", "x"), ("Standard", "Standard build"), ("Standard", "Std"), ("a b", "a b"), ("x", "")], "c string, r string")
    assert [r[0] for r in pairs.select(reports.prefers_recovered(pairs.c, pairs.r)).collect()] == [True, True, False, False, False]


def test_records_and_review_fields(spark):
    rows = docs(spark, ("a", RECEIPT, "2031-11-03 x.pdf"), ("b", "RESULT\nWEIGHT 91.7kg", ""))
    got = {r.id: r for r in reports.receipt_records(reports.receipts(rows), reports.F.lit("2031-11-03 x.pdf")).collect()}
    assert set(got) == {"tanita:2031-11-03T07:06:00", "tanita:pending"}
    assert got["tanita:pending"].metrics == {"weight_kg": 91.7} and got["tanita:2031-11-03T07:06:00"].metrics["bmi"] == 21.6
    shown = docs(spark, ("a", REPORT, "")).select(reports.review_fields(reports.F.col("text"), reports.REPORT_SIGNS, reports.F.array(reports.F.lit("metrics.weight_kg")))).first()[0]
    assert shown[0] == "measured_at_local" and "analysis.score" in shown and "metrics.weight_kg" not in shown


def test_label_repairs(spark):
    said = {"HTGHI 170": "HEIGHT 170", "CLOTHL5 WEGHT 1": "CLOTHES WEIGHT 1", "a\n |M 55.5": "A\nFFM 55.5", "PHYSITQUE": "PHYSIQUE", "KB LOELEC TRI CAI OATA": "BIOELECTRICAL DATA", "VISCERAL FAI RATING &": "VISCERAL FAT RATING 8", "visceral fat rating B\n": "VISCERAL FAT RATING 8\n", "KBTOELECTRICAL": "BIOELECTRICAL"}
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", reports.labelled(F.col("t")).alias("x")).collect()}
    assert got == said


def test_tokens_of_lines_without_repairs_are_read_once(spark):
    """Lines that the short way takes give what all readings give, and few lines miss it."""
    rng = random.Random(5)
    rows = ["".join(rng.choices("0123456789.,BSHOQIL|ZGAK%/_- \t", k=rng.randint(0, 7))) for _ in range(4000)]
    rows += ["WEIGHT 58.4 KG", "TOTAL 173665.47", "BMR 5230 KJ 1250 KCAL", "FAT % 23.0 - 33.9 %", "TOTAL PRICE 12"]
    table = spark.createDataFrame([(x,) for x in rows], "x string").repartition(2)

    def every_reading(line):
        plain = F.regexp_replace(line, r"(^|\s)[BSH](?=\d{2,3}[.,])", "$1")
        texts = []
        for b in reports.B_DIGITS:
            text = F.regexp_replace(plain, r"([.,])\s*B(?=\s*(?:K?G|K|%|\z))", f"$1{b}")
            for letters, digit in (("B", b), *reports.DIGIT_LETTERS):
                text = F.regexp_replace(text, rf"(?<=[0-9.,])[{letters}](?=[0-9.,A-Z]|\z)|[{letters}](?=[0-9])", digit)
            texts.append(F.regexp_replace(text, r"H(?=\d)", "5"))
        found = [F.regexp_extract_all(reports._rewritten(t, reports.NUMBER_REPAIRS), F.lit(r"[-+]?\d+(?:[.,]\d+)?"), F.lit(0)) for t in (*texts, plain, line)]
        return F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")))

    got = table.select("x", reports.tokens(F.col("x")).alias("a"), every_reading(F.col("x")).alias("b"), F.col("x").rlike(reports.REPAIRABLE).alias("slow")).collect()
    assert [(r.x, r.a, r.b) for r in got if r.a != r.b] == []
    assert not any(r.slow for r in got if " " in r.x and len(r.x) > 10)


def test_loose_numbers_are_solved_in_their_row(spark):
    text = "Body Composition Analysis\n40 40,0 12 52 4 56 14 70 (60 ~ 80)\nThank you 11"
    docs = spark.createDataFrame([("a", text, ""), ("b", text.replace("14 70", ""), "")], "doc string, text string, source_name string")
    parsed = reports.printed_reports(docs).select("doc", "weight_kg", "ffm_kg", "protein_kg")
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(tuple(r) for r in parsed.collect()) == [("a", 70.0, 56.0, 12.0), ("b", None, None, None)]
