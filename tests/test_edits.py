from pyspark.sql import functions as F

from somalog.operators import consensus, edits, indicators, merge, view

LOG = "id string, kind string, source struct<type:string>, measured_at_local string, metrics struct<weight_kg:double>, bioelectrical struct<`6.25_khz`:struct<r_ohm:double>>, note string"


def test_paths_keep_names_with_a_dot():
    assert edits.path_parts("bioelectrical.6.25_khz.r_ohm") == ["bioelectrical", "6.25_khz", "r_ohm"]
    assert edits.path_parts("id") == ["id"]


def test_set_paths_makes_parents_and_replaces_values(spark):
    df = spark.createDataFrame([(1, None, 5), (2, (7,), None)], "k int, a struct<x:int>, b int").withColumn("here", F.col("k") == 1)
    new = edits.set_paths(F.struct("k", "a", "b"), df.select("k", "a", "b").schema, {"a.y": (F.lit("n"), F.col("here")), "b.c.d": (F.lit(1), F.lit(True)), "a.x": (F.lit(9), F.lit(False))})
    got = [r.asDict(True) for r in df.select(new.alias("n")).select("n.*").orderBy("k").collect()]
    assert got == [{"k": 1, "a": {"x": None, "y": "n"}, "b": {"c": {"d": 1}}}, {"k": 2, "a": {"x": 7, "y": None}, "b": {"c": {"d": 1}}}]


def test_edited_records(spark):
    logs = spark.createDataFrame(
        [("a", "body_composition", ("accuniq_report",), "t1", (50.0,), None, "n"), ("b", "workout", None, None, None, None, None), ("c", "body_composition", None, "t3", None, None, "m"), ("d", "body_composition", None, "t4", (1.0,), None, None)],
        LOG,
    )
    given = [("a", "metrics.weight_kg", "61.5", 1), ("a", "metrics.weight_kg", " 62 ", 2), ("a", "bioelectrical.6.25_khz.r_ohm", "x", 1), ("c", "measured_at_local", " ", 1), ("c", "note", "", 1), ("b", "note", "hi", 1), ("b", "other", "z", 1), ("zz", "note", "no", 1)]
    fields = {"metrics.weight_kg": "number", "bioelectrical.6.25_khz.r_ohm": "number", "measured_at_local": "text", "note": "text"}
    rows = spark.createDataFrame(given, "id string, path string, value string, place int")
    got = {r.id: r for r in edits.edited(logs, rows, fields, form=True).collect()}
    assert set(got) == {"accuniq:t1", "b", "c", "d"}
    a, b, c, d = got["accuniq:t1"], got["b"], got["c"], got["d"]
    assert (a.replaced_id, a.metrics.weight_kg, a.bioelectrical, a.error) == ("a", 62.0, None, "Invalid number: x")
    assert (b.note, b.replaced_id, b.error, b.metrics) == ("hi", None, None, None)
    assert (c.measured_at_local, c.note, c.error) == (None, None, "Measured at is required before saving.")
    assert (d.replaced_id, d.metrics.weight_kg, d.error) == (None, 1.0, None)
    assert edits.edited(logs.limit(0), rows, fields).count() == 0
    kept = {r.note for r in edits.edited(logs, rows.where("id = 'c' AND path = 'note'"), fields).collect()}
    assert "" in kept  # the editor of stored records keeps a blank text


def shown(reading, source="indicator_graph"):
    return ("0", None, reading, 0.4, 0.9, source, "l")


def test_indicators_are_normalized_against_the_original(spark):
    maps = f"k int, i map<string,{indicators.INDICATOR}>, o map<string,{indicators.INDICATOR}>"
    rows = [(1, {"bmi": shown("0: 37%"), "bmr": shown("none"), "x": shown("0: 37%")}, {"bmi": shown("0: 35%")}), (2, {"bmi": shown("0: 35%")}, {"bmi": shown("0: 35%")}), (3, {"bmi": shown("0: 35%")}, None), (4, None, None)]
    got = {r.k: r.n for r in spark.createDataFrame(rows, maps).select("k", indicators.normalized(F.col("i"), F.col("o")).alias("n")).collect()}
    assert (got[1]["bmi"].reading, got[1]["bmi"].section_percent, got[1]["bmi"].source, got[1]["bmi"].position) in [("0: 35%", 35, "indicator_graph", 0.4)]
    assert got[1]["bmr"].reading == "none" and got[1]["x"].reading == "0: 37%"
    assert got[2]["bmi"].source == got[3]["bmi"].source == "indicator_graph" and got[4] is None


def test_attached_indicators_warn(spark):
    maps = f"k int, indicators map<string,{indicators.INDICATOR}>, found map<string,{indicators.INDICATOR}>, fat double, low double, high double, warnings array<string>, review_fields array<string>"
    rows = [(1, {"bmi": shown("0: 5%")}, {"fat_percent": ("+", 5, "+: 5%", 0.4, 0.9, "s", "l")}, 20.0, 10.0, 25.0, ["w"], None), (2, None, {"fat_percent": shown("0: 5%")}, 20.0, 10.0, 25.0, None, ["a"]), (3, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, maps)
    got = {r.k: r for r in indicators.attached(docs, "found", F.col("fat"), F.col("low"), F.col("high")).collect()}
    assert len(got[1].warnings) == 2 and got[2].warnings == [] and got[3].warnings == []
    assert set(got[1].indicators) == {"bmi", "fat_percent"} and got[3].indicators == {}
    assert got[2].review_fields[0] == "a" and len(got[1].review_fields) == 5


def test_cascade_tries_routes_in_order(spark):
    rows = [
        (1, "embedded", "tanita", 0.95, 41, 0), (1, "cloud", "tanita", 1.0, 9, 0),
        (2, "embedded", "tanita", 0.95, 40, 0), (2, "cloud", "tanita", 0.75, 9, 0), (2, "local", "tanita", 1.0, 9, 0),
        (3, "cloud", "accuniq", 0.6, 9, 0), (3, "cloud", "accuniq", 0.6, 9, 1), (3, "local", "accuniq", 0.6, 9, 0),
        (4, "cloud", "accuniq", 0.6, 9, 0), (4, "local", "accuniq", 0.5, 9, 0),
        (5, "cloud", "tanita", 0.6, 9, 0), (5, "local", "accuniq", 0.1, 9, 0),
        (6, "cloud", "tanita", None, 9, 0), (7, "embedded", "tanita", 0.1, 900, 0),
    ]
    docs = spark.createDataFrame(rows, "k int, route string, source string, completeness double, n_chars long, place int")
    got = {r.k: r.route for r in consensus.cascade(docs, "k").collect()}
    assert got == {1: "embedded", 2: "cloud", 3: "local", 4: "cloud", 5: "local", 6: "cloud"}
    best = {r.k: r.place for r in consensus.best_parse(docs.where("k = 3 AND route = 'cloud'"), "k", "completeness", "place").collect()}
    assert best == {3: 0}


def test_path_union_lookup_and_rank(spark):
    parses = spark.createDataFrame([(1, 2, ["c", "a"]), (1, 1, ["b", "a"]), (2, 1, None)], "k int, r int, p array<string>")
    assert {r.k: r.p for r in consensus.path_union(parses, "k", "p", "r").collect()} == {1: ["b", "a", "c"], 2: []}
    stored = spark.createDataFrame([("x", "u", 2), ("y", "u", 1), ("z", None, 0)], "id string, u string, s int")
    uploads = spark.createDataFrame([("u",), ("v",), (None,)], "u string")
    assert {r.u: r.existing_id for r in merge.existing_upload(uploads, stored, "u", "s").collect()} == {"u": "y", "v": None, None: None}
    logs = spark.createDataFrame([("a", "2030-01-01T05"), ("b", None), ("c", "2030-01-01T04"), ("d", "2030-01-01T05")], "id string, t string")
    ranks = {r.id: r.n for r in merge.log_rank(logs, F.col("t"), "n").collect()}
    assert ranks == {"b": 1, "c": 2, "a": 3, "d": 4} and [r.id for r in merge.sorted_logs(logs, F.col("t")).collect()] == ["b", "c", "a", "d"]


def test_known_labels(spark):
    paths = spark.createDataFrame([("bioelectrical.6.25_khz.r_ohm",), ("metrics.bmr_kj",), ("metrics.new_kg",)], "p string")
    assert [r.l for r in paths.select(view.field_label(F.col("p")).alias("l")).collect()] == ["R 6.25 kHz (Ω)", "BMR (kJ)", "Metrics · New kg"]


def test_path_union_of_equal_ranks(spark):
    """Of equal ranks the places in the lists decide."""
    parses = spark.createDataFrame([(1, ["N", "F", "2"], 7), (1, ["A", "F", "1"], 7), (1, ["Z"], 3)], "k int, p array<string>, r long")
    assert consensus.path_union(parses, "k", "p", "r").first().p == ["Z", "A", "N", "F", "1", "2"]


def test_path_union_follows_its_sql_on_odd_lines(spark, tmp_path):
    """Places are rounded, lines without a place come last, and what is no path is left out."""
    import duckdb

    import __spark_entry__

    lines = [
        (1, 5, 0, 1, 3.4, "A", "F"), (1, 5, 1, 1, 3.6, "R", "O"), (1, 5, 2, 1, 2.2, "N", "O"),  # 3, 4 and 2
        (2, 5, 0, 1, 1.5, "A", "F"), (2, 5, 3, 1, 1.4, "R", "F"), (2, 5, 2, 1, 0.5, "N", "O"),  # 2, 1 and 0
        (3, 5, 0, 1, 0.9, "A", "F"), (3, 5, 1, 1, 0.4, "R", "F"), (3, 5, 0, 1, 2.5, "N", "F"), (3, 5, 0, 1, 3.3, "Z", "F"),  # 1, 0, 2 and 3
        (4, None, 4, 1, 1.0, "A", "F"), (4, 9, 4, 2, 1.0, "R", "F"), (5, 5, 1, 1, None, "A", "F"), (5, 5, 1, 1, 1.0, None, "F"),
        (6, 5, None, 1, 1.0, None, None), (7, 5, None, 1, 1.0, None, "F"), (None, 5, -7, 1, 1.0, "", "F"),
    ]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.paths for r in __spark_entry__.queries()["path_union"](spark, str(tmp_path)).collect()}
    assert got == {1: "N,O,2,A,F,0,R,1", 2: "N,O,2,R,F,3,A,0", 3: "R,F,1,A,0,N,Z", 4: "R,F,4,A", 5: "F,1,A", 6: None, 7: "F", None: ",F,-2"}
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert got == dict(base.execute(__spark_entry__.oracle_sql()["path_union"]).fetchall())
