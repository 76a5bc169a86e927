from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.operators import consensus, parse_merge, reports

RECEIPT = "INPUT\nAGE 47\nHEIGHT 164.5 cm\nRESULT\n{}\nBIOELECTRICAL DATA\n{}\nR {}\nX {}\n{}"


def text(lines, heads="6.25kHz 50kHz", r="712.4 648.1", x="-31.0 -58.5", foot="03/NOV/2022 07:05"):
    return RECEIPT.format("\n".join(lines), heads, r, x, foot)


def merged(spark, *texts):
    docs = spark.createDataFrame([(f"{k:02}", t, "") for k, t in enumerate(texts)], "doc string, text string, source_name string")
    parses = reports.receipts(docs).withColumn("key", F.lit(1)).withColumnRenamed("doc", "place")
    (row,) = parse_merge.merged(parses, "key", "place").collect()
    return row


def test_what_was_seen_counts_before_what_was_derived(spark):
    full = ["WEIGHT 58.4kg", "FAT MASS 14.2kg", "FFM 44.2kg", "BONE MASS 2.3kg", "MUSCLE MASS 41.9kg"]
    row = merged(spark, text(full), text(["WEIGHT 58.4kg", "FAT MASS 14.9kg"]), text(["WEIGHT 58.4kg", "FAT MASS 14.9kg"]))
    assert row.fat_mass_kg == 14.9 and row.ffm_kg == 44.2  # two saw 14.9, but only one saw FFM
    assert "metrics.fat_mass_kg" in row.conflicted_fields and "metrics.ffm_kg" not in row.conflicted_fields
    assert any("do not reconcile" in w for w in row.warnings) and row.candidate_count == 3
    assert "metrics.ffm_kg" not in row.derived_fields and "metrics.fat_percent" in row.derived_fields
    assert row.review_fields[0] == "measured_at_local" and "metrics.ffm_kg" in row.review_fields and "metrics.fat_percent" not in row.review_fields


def test_pairs_are_taken_whole(spark):
    near, far = text(["WEIGHT 58.4kg"], r="712.4 648.1", x="-31.0 -58.5"), text(["WEIGHT 58.4kg"], r="812.4 648.1", x="-36.0 -58.0")
    row = merged(spark, far, far, near)
    assert {k: tuple(v) for k, v in row.bioelectrical.items()} == {"6.25_khz": (712.4, -36.0), "50_khz": (648.1, -58.0)}


def test_rules_run_on_the_winners(spark):
    a = text(["WEIGHT 58.4kg", "FFM 44.2kg", "MUSCLE MASS 41.9kg"])
    b = text(["WEIGHT 58.4kg", "FFM 44.2kg", "BONE MASS 5.3kg"])
    row = merged(spark, a, a, b)
    assert row.muscle_mass_kg == 38.9 and row.corrected_fields == ["metrics.muscle_mass_kg"]
    assert row.warnings[0].startswith("muscle_mass_kg was read as 41.9") and "metrics.muscle_mass_kg" in row.derived_fields


def test_times_and_texts(spark):
    row = merged(spark, text(["WEIGHT 58.4kg"], foot="03/NOV/2022"), text(["WEIGHT 58.4kg"], foot="03/NOV/2022 07:05"), text([], foot=""))
    assert (row.measured_at_local, row.date, row.time) == ("2022-11-03T07:05:00", "2022-11-03", "07:05")
    assert merged(spark, text([], foot="03/NOV/2022")).measured_at_local == "2022-11-03T00:00:00"
    nothing = merged(spark, None, "")
    assert nothing.measured_at_local is None and nothing.completeness == 0 and nothing.derived_fields == [] and nothing.weight_kg is None


def test_record_of_a_merge(spark):
    docs = spark.createDataFrame([("a", text(["WEIGHT 58.4kg"]), "")], "doc string, text string, source_name string")
    one = parse_merge.merged(reports.receipts(docs).withColumn("key", F.lit(1)), "key", "doc")
    record = reports.receipt_records(one, F.lit("scan.jpg")).first()
    assert record.id == "tanita:2022-11-03T07:05:00" and record.extraction.candidate_count == 1 and record.extraction.conflicted_fields == []
    alone = reports.receipt_records(reports.receipts(docs), F.lit("scan.jpg")).first()
    assert alone.extraction.candidate_count is None and alone.extraction.corrected_fields == []


def test_number_votes_in_order_of_rank(spark):
    rows = [(1, r, v, o) for r, (v, o) in enumerate([(1.0, False), (1.1, False), (1.2, True), (0.9, False), (1.2, True), (5.0, True)])] + [(2, 0, None, True)]
    votes = spark.createDataFrame(rows, T._parse_datatype_string("o int, r int, v double, n boolean"))
    assert [tuple(r) for r in consensus.number_vote(votes, ["o"], "v", "r", "n").collect()] == [(1, 1.2, 2, 2, True)]


def test_readings_are_shuffled_once_and_whole(spark):
    docs = spark.createDataFrame([("a", text(["WEIGHT 58.4kg"]), "")], "doc string, text string, source_name string")
    plan = parse_merge.merged(reports.receipts(docs).withColumn("key", F.lit(1).cast("long") + F.length("doc")), "key", "doc")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate " not in plan


def test_batches_end_anywhere(spark, monkeypatch):
    def weights(k):
        return ["WEIGHT {}kg".format(50 + k * 7 % 13 / 10), "FAT MASS 14.{}kg".format(k % 3), "BMI 2{}.4".format(k % 5)]

    texts = [text(weights(k), r=f"{700 + k % 4}.4 648.1", foot="03/NOV/2022 07:05" if k % 3 else "") for k in range(40)] + [None, ""]
    docs = spark.createDataFrame([(f"{k:02}", t, "") for k, t in enumerate(texts)], "doc string, text string, source_name string")
    parses = reports.receipts(docs).withColumn("key", F.when(F.col("doc") < "33", 1).otherwise(F.col("doc").cast("int")))
    rows = parse_merge.readings(parses, "key", "doc").sort("key", F.col("_merit").desc(), "_place").drop("_merit", "_place").toArrow()
    whole = [r for b in parse_merge._merged_batches(iter(rows.combine_chunks().to_batches())) for r in b.to_pylist()]
    monkeypatch.setattr(parse_merge, "OPEN_ROWS", 2)  # what is open goes on in short
    parts = [r for b in parse_merge._merged_batches(iter(rows.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    assert len(whole) == 10 and whole[0]["candidate_count"] == 33
    assert parts == whole
