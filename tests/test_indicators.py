import json

from somalog.operators import indicators
from somalog.sources import store, words
from somalog.streaming.upsert import upsert


def box(level=None, percent=None, reading=None, position=None, source=None):
    return (level, percent, reading, position, 0.5 if position is not None else None, source, "label" if position is not None else None)


def test_reviewed_values_are_kept(spark):
    schema = f"id string, other int, indicators map<string,{indicators.INDICATOR}>"
    drawn = box("+", 35, "+: 35%", 0.586, "indicator_graph")
    new = [(k, 1, {"bmi": drawn, "bmr": drawn}) for k in ("manual", "moved", "plain", "none")] + [("empty", 1, None)]
    stored = [
        ("manual", 2, {"fat_percent": box("0", 10, "0: 10%", None, "manual_review"), "bmi": box("-", 5, "-: 5%", 0.01, "indicator_graph"), "bmr": box(reading="bad")}),
        ("moved", 2, {"bmi": box("+", 40, "+: 40%", 0.586, "indicator_graph")}),
        ("plain", 2, {"bmi": box("+", 35, "+: 35%", 0.586, "indicator_graph")}),
        ("empty", 2, {"bmi": box("+", 40, "+: 40%", None, "manual_review")}),
    ]
    got = {r.id: r.indicators for r in indicators.carried_over(spark.createDataFrame(new, schema), spark.createDataFrame(stored, schema), "id").collect()}
    assert set(got["manual"]) == {"fat_percent", "bmi", "bmr"} and got["manual"]["bmr"].position == 0.586
    assert (got["manual"]["bmi"].reading, got["manual"]["bmi"].source, got["manual"]["bmi"].position, got["manual"]["bmi"].locator) == ("-: 5%", "manual_review", None, None)
    assert got["moved"]["bmi"].reading == "+: 40%" and got["plain"]["bmi"].source == "indicator_graph"
    assert set(got["none"]) == {"bmi", "bmr"} and got["empty"]["bmi"].source == "manual_review"


def test_word_boxes(spark):
    corner = lambda x, y: {"x": x, "y": y}
    word = {"symbols": [{"text": "a"}, {"text": "b"}], "boundingBox": {"vertices": [corner(1, 2), corner(5, 2), corner(5, 9), {"x": 1}]}}
    full = {"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [word]}, {}]}]}]}}
    flat = {"textAnnotations": [{"description": "all"}, {"description": "w", "boundingPoly": {"vertices": [corner(3, 4), corner(6, 8)]}}]}
    rows = spark.createDataFrame([("f", json.dumps(full)), ("g", json.dumps(flat)), ("h", "{}")], "page string, response string")
    assert sorted(map(tuple, words.word_boxes(rows).collect())) == [("f", "ab", 1, 5, 0, 9), ("g", "w", 3, 6, 4, 8)]


def test_stream_into_the_store(spark, tmp_path):
    rows = [(json.dumps({"id": i, "kind": "k", "start_at": "2031-04-01", "v": v}), p) for p, (i, v) in enumerate([("a", 1), ("b", 2), ("a", 3)])]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "raw string, place long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("raw string, place long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    upsert(stream, f"{tmp_path}/store", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(json.loads(r.raw)["v"] for r in store.read(spark, f"{tmp_path}/store").collect()) == [2, 3]
