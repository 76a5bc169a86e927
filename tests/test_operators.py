import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somalog.functions import scalars as fn
from somalog.operators import asof, consensus, layout, merge, sessions, solve, view


def plain_asof(sessions_, samples, tolerance=1000):
    out = []
    for key, at, s in samples:
        before = [x for x in sessions_ if x[0] == key and x[1] <= at]
        if before:
            last = max(before, key=lambda x: (x[1], x[3]))
            if at <= last[2] + tolerance:
                out.append((s, last[3]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_asof_against_plain(spark, seed):
    rng = random.Random(seed)
    hour = asof.HOUR
    rows = []
    for i in range(120):
        start = rng.randrange(0, 60 * hour, rng.choice([1, hour]))
        rows.append((rng.randrange(3), start, start + rng.randrange(0, 5 * hour), i))
    rows += [(0, 5 * hour, 6 * hour, 500), (0, 5 * hour, 9 * hour, 501)]  # tied starts
    samples = [(rng.randrange(4), rng.randrange(-hour, 70 * hour), i) for i in range(400)]
    samples += [(0, e + d, 1000 + 10 * k + d % 7) for k, (_, _, e, _) in enumerate(rows[:40]) for d in (1000, 1001)]
    table = spark.createDataFrame(rows, "u long, start long, end long, pos long")
    points = spark.createDataFrame(samples, "u long, at long, s long")
    got = asof.attach(points, table, ["u"], "at", "start", "end", "pos")
    assert sorted((r.s, r.pos) for r in got.collect()) == plain_asof(rows, samples)
    one = asof.attach(points.drop("u"), table.drop("u"), [], "at", "start", "end", "pos", chunk_ms=10 * hour)
    assert sorted((r.s, r.pos) for r in one.collect()) == plain_asof([(0, *r[1:]) for r in rows], [(0, *s[1:]) for s in samples])


def test_asof_long_sessions_and_nulls(spark):
    """A session of ten million hours is one row; nulls take no part; ties of starts over chunks."""
    hour = asof.HOUR
    sessions = [("a", 0, 10**7 * hour, 1), ("b", 5, 6, 2), ("b", 5, 10**7 * hour, 3), (None, 0, 10**7 * hour, 4), ("c", None, 9, 5), ("c", 0, None, 6)]
    samples = [("a", 9 * 10**6 * hour, 1), ("a", 10**7 * hour + 1000, 2), ("a", 10**7 * hour + 1001, 3), ("a", -1, 4), ("b", 7 * hour, 5), ("b", 5, 6), (None, 5, 7), ("c", 5, 8), ("a", None, 9), ("d", 5, 10)]
    table = spark.createDataFrame(sessions, "u string, start long, end long, pos long")
    points = spark.createDataFrame(samples, "u string, at long, s long")
    got = asof.attach(points, table, ["u"], "at", "start", "end", "pos")
    assert sorted((r.s, r.pos) for r in got.collect()) == [(1, 1), (2, 1), (5, 3), (6, 3)] and got.columns == ["u", "at", "s", "start", "end", "pos"]
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert asof.attach(points.limit(0), table, ["u"], "at", "start", "end", "pos").count() == 0
    assert asof.attach(points, table.limit(0), ["u"], "at", "start", "end", "pos").count() == 0


def plain_merge(rows):
    kept = [r for r in rows if not r[1]]
    for r in rows:
        if r[1]:
            kept = [k for k in kept if not (k[2] == r[2] or (k[3] is not None and k[3] == r[3]))] + [r]
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_against_plain(spark, seed):
    rng = random.Random(seed)
    rows = [(i, i >= 60, f"id{rng.randrange(40)}", rng.choice([None, f"f{rng.randrange(30)}"])) for i in range(140)]
    table = spark.createDataFrame([(s, c, i, u or None) for s, c, i, u in rows], "seq long, incoming boolean, id string, up string")
    got = merge.merged(table, ["id", "up"], "seq", "incoming").select("seq", "incoming", "id", "up").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(plain_merge(rows), key=lambda r: r[0])


def test_merge_logs_identity(spark):
    schema = "seq long, id string, kind string, source struct<type: string, filename: string>"
    log = lambda s, i, t="tanita", f=None, k="body_composition": (s, i, k, (t, f))
    old = spark.createDataFrame([log(0, "a", f="One.PDF"), log(1, "b", f="two.pdf"), log(2, "c", k="workout", f="x"), log(3, "c", k="workout"), log(4, "", f="z"), log(5, "e", t="", f="q")], schema)
    new = spark.createDataFrame([log(0, "n", f=" one.pdf "), log(1, "m", t="Tanita", f="two.pdf"), log(2, "w", k="workout", f="x"), log(3, "v", t="", f="q"), log(4, "k", f=" ")], schema)
    assert sorted(r.id for r in merge.merge_logs(old, new).collect()) == ["b", "c", "c", "e", "k", "m", "n", "v", "w"]


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_numbers_and_times(spark):
    texts = ["", " 12.5 ", "0x10", "12d", "NaN", "1e3", "-.5", "5.", "x", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(fn.number(F.col("t"))).collect()] == [None, 12.5, 16.0, None, None, 1000.0, -0.5, 5.0, None, None]
    assert rows.select(fn.number(F.col("t"), True)).first()[0] == 0
    r = one(spark, a=fn.round1(F.lit(-0.25)), b=fn.round1(F.lit(0.25)), t=fn.export_time(F.lit("2030-01-15 10:30:00 +0800")), u=fn.export_time(F.lit("x y z")), n=fn.export_time(F.lit("")), ms=fn.epoch_ms(F.lit("2030-01-15T10:30:00+08:00")), bad=fn.epoch_ms(F.lit("soon")))
    assert (r.a, r.b, r.t, r.u, r.n, r.bad) == (-0.2, 0.3, "2030-01-15T10:30:00+08:00", "xTy z", None, None)
    assert r.ms == 1894674600000
    r = one(spark, p=fn.period(F.lit("2031-04-30T23:00:00+08:00")), q=fn.period(F.lit("")), path=fn.period_path(F.lit("2031-04-30")), e=fn.event_time(F.lit(""), F.lit("s")), f=fn.file_date(F.lit("a 2030-02_01.pdf")), g=fn.file_date(F.lit("none")), k=fn.filename_key(F.lit(" A.PDF ")))
    assert tuple(r) == ("2031-04", "unknown", "data/events/2031-04.json", "s", "2030-02-01", None, "a.pdf")


def test_readings(spark):
    r = one(spark, a=fn.position_reading(F.lit("fat_percent"), F.lit(0.586))["reading"], b=fn.position_reading(F.lit("bmr"), F.lit(0.501))["reading"], c=fn.band_reading(F.lit("bmi"), F.lit(0.249))["reading"], d=fn.position_reading(F.lit("bmi"), F.lit(0.249))["reading"], e=fn.parsed_reading(F.lit("+: 37%"), "floor")["percent"], f=fn.parsed_reading(F.lit(" ++ : 38%"), "round")["percent"], g=fn.parsed_reading(F.lit("+ 3"), "round"))
    assert tuple(r) == ("+: 35%", "0: 50%", "-: 100%", "-: 95%", 35, 40, None)
    step = lambda text, d, levels=fn.FOUR_LEVELS: fn.stepped_reading(F.lit(text), F.lit(d), levels)
    r = one(spark, a=step("0: 95%", 1), b=step("+: 0%", -1), c=step("++: 95%", 1), d=step("-: 0%", -1), e=step("+: 95%", 1, fn.THREE_LEVELS), f=step("bad", 1), g=fn.decimal_step(F.lit(70.2), F.lit(1)), h=fn.decimal_step(F.lit(70.2), F.lit(-1)))
    assert tuple(r) == ("+: 0%", "0: 95%", "++: 95%", "-: 0%", "+: 95%", "-: 5%", 70.3, 70.1)


def test_kinds_and_texts(spark):
    r = one(spark, a=fn.upload_kind(F.lit("A.ZIP"), F.lit("")), b=fn.upload_kind(F.lit("x"), F.lit("text/XML")), c=fn.upload_kind(F.lit("x.heic"), F.lit(None).cast("string")), d=fn.upload_kind(F.lit("x"), F.lit("y")), e=fn.report_source(F.lit("x"), F.lit("an accuniq file")), f=fn.report_source(F.lit("Visceral  fat rating"), F.lit("")), g=fn.source_label(F.lit("tanita")), h=fn.source_label(F.lit("new"), F.lit("")), i=fn.redacted(F.lit("a?key=secret&x  b\n")), j=fn.escaped_html(F.lit("<a & 'b'>")), k=fn.path_from_segments(F.lit("/a b/c/")), m=fn.canonical_json(F.lit('{"b":1.50,"a":[2,1]}')))
    assert tuple(r) == ("apple_health_zip", "apple_health_xml", "body_composition_report", "unknown", "accuniq", "tanita", "TANITA DC-360", "new", "a?key=[redacted]&x b", "&lt;a &amp; &#39;b&#39;&gt;", "a%20b/c", '{"a":[2,1],"b":1.5}')
    assert one(spark, a=fn.coerced(F.lit(" "), "number"), b=fn.coerced(F.lit("true"), "boolean")).asDict() == {"a": None, "b": True}
    with pytest.raises(Exception, match="Invalid number"):
        one(spark, a=fn.coerced(F.lit("12d"), "number"))


def test_view(spark):
    rows = [(0, "2030-01-01", 45.0), (1, "2030-01-03", None), (2, "2030-01-02", 60.0), (3, None, 60.0)]
    items = spark.createDataFrame(rows, "place int, date string, duration_minutes double").withColumn("date_value", F.unix_date(F.to_date("date")))
    order = lambda mode: [r.place for r in view.sorted_view(items, mode, "place").collect()]
    assert order("duration-desc") == [2, 3, 0, 1] and order("duration-asc") == [0, 2, 3, 1]
    assert order("date-asc") == [0, 2, 1, 3] and order("nonsense") == [1, 2, 0, 3]
    r = one(spark, a=view.body_summary(F.lit(70.0), F.lit(None).cast("double"), F.lit(52.5)), b=view.workout_summary(F.lit(59.5), F.lit(None).cast("double"), F.lit(101.25)), c=view.field_label(F.lit("metrics.body_bmr_kj")), d=view.field_label(F.lit("id"), {"id": "Record ID"}), e=view.editor_path_visible(F.lit("indicators.bmi.level")))
    assert tuple(r) == ("70 kg · 52.5 kg muscle", "60 min · 101 bpm avg", "Metrics · Body BMR kJ", "Record ID", False)


def plain_solution(v):
    best = None
    places = range(len(v))
    for w in places:
        for f in places:
            if f == w or not v[w] > v[f]:
                continue
            for a in places:
                if a in (w, f) or abs(v[w] - v[f] - v[a]) > 1.2:
                    continue
                for m in places:
                    for n in places:
                        if len({w, f, a, m, n}) < 5 or not v[f] > v[m] or abs(v[f] - v[m] - v[n]) > 1.0:
                            continue
                        for t in places:
                            for p in places:
                                if len({w, f, a, m, n, t, p}) < 7 or not v[m] > v[t] > v[p] or abs(v[m] - v[t] - v[p]) > 1.2:
                                    continue
                                score = abs(v[w] - v[f] - v[a]) + abs(v[f] - v[m] - v[n]) + abs(v[m] - v[t] - v[p]) + 2 * (v[w] != max(v)) + (not v[n] < v[p])
                                if best is None or score < best[-1]:
                                    best = (*(float(v[k]) for k in (w, f, a, m, n, t, p)), float(score))
    return best


def test_solver_and_ranges(spark):
    numbers = [40.0, 40.0, 12.0, 52.0, 4.0, 56.0, 14.0, 70.0]
    table = spark.createDataFrame([("a", i, v) for i, v in enumerate(numbers)] + [("few", 0, 1.0)] + [("many", i, 5.0) for i in range(30)], "k string, p int, v double")
    (r,) = solve.composition(table, "k", "p", "v").collect()
    assert (r.weight, r.ffm, r.fat, r.muscle, r.minerals, r.water, r.protein) == (70, 56, 14, 52, 4, 40, 12)
    import numpy as np

    for seed in range(12):
        v = np.random.default_rng(seed).integers(1, 30, 8 + seed % 3).astype(float)
        assert solve.solved(v) == plain_solution(v)

    rng = np.random.default_rng(7)
    from itertools import permutations

    for rows, columns in ((1, 1), (3, 3), (3, 6), (5, 7), (4, 18)):
        cost = rng.integers(0, 9, (rows, columns)).astype(float)
        want = min(permutations(range(columns), rows), key=lambda p: (sum(cost[i, c] for i, c in enumerate(p)), p))
        got = solve.best_assignment(cost)
        assert sum(cost[i, c] for i, c in enumerate(got)) == sum(cost[i, c] for i, c in enumerate(want)) and len(set(got)) == rows
    assert solve.best_assignment(np.zeros((3, 2))) is None


def test_votes(spark):
    rows = [("d", 1, "Male", 10.0, True), ("d", 2, "MALE", 10.1, True), ("d", 3, "Female", 10.2, False), ("d", 4, None, None, True), ("d", 5, "female", 10.25, True)]
    votes = spark.createDataFrame(rows, "doc string, rank int, text string, value double, observed boolean")
    (t,) = consensus.text_vote(votes, ["doc"], "text", "rank", F.col("observed")).collect()
    assert (t.value, t.n_observed, t.n, t.conflicted) == ("Male", 2, 2, True)
    (n,) = consensus.number_vote(votes, ["doc"], "value", "rank", "observed").collect()
    assert (n.value, n.n_observed, n.n, n.conflicted) == (10.0, 2, 2, True)


def test_layout(spark):
    words = [("p", "b", 50.0, 60.0, 10.0, 20.0), ("p", "a", 0.0, 40.0, 11.0, 21.0), ("p", "c", 0.0, 9.0, 40.0, 50.0), ("p", "tall", 70.0, 90.0, 5.0, 26.0)]
    table = spark.createDataFrame(words, "page string, text string, left double, right double, top double, bottom double")
    assert sorted((r.row, r.place, r.text) for r in layout.words_to_rows(table).collect()) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "tall"), (1, 0, "c")]
    points = spark.createDataFrame([(1, x) for x in (1, 2, 5, 6, 7, 20, 7)], "k int, x int")
    assert sorted((r.run_start, r.run_end, r.n) for r in layout.runs(points, ["k"], "x", 2, 3).collect()) == [(1, 7, 5)]
    values = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 1.01, 1.02, 9.0, 5.0])], "k int, i int, v double")
    (c,) = layout.dominant_cluster(values, ["k"], "v", "i", 0.02).collect()
    assert (c.position, c.cluster_size, c.sample_size) == (1.01, 3, 5)


def test_review_summary(spark):
    logs = spark.createDataFrame([("a", 1.0, 2), ("b", None, 0), ("c", 3.0, 4)], "start string, average double, n long")
    assert tuple(sessions.review_summary(logs, "start", "average", "n").first()) == (3, "a", "c", 2, 2, 6)


def test_assignment_of_many_ranges_to_eight_values():
    import itertools

    import numpy as np

    from somalog.operators import solve

    rng = np.random.default_rng(3)
    cost = rng.random((8, 60))
    cost[:, 20:] += 1
    found = solve.best_assignment(cost)
    assert len(set(found)) == 8 and sum(cost[range(8), found]) <= min(sum(cost[range(8), rng.permutation(20)[:8]]) for _ in range(3000))
    for _ in range(20):
        cost = rng.random((3, 19))
        best = min(itertools.permutations(range(19), 3), key=lambda p: (sum(cost[range(3), p]), p))
        assert solve.best_assignment(cost) == list(best)
    assert solve.best_assignment(np.zeros((2, 3))) == [0, 1]


def test_assignments_at_once_are_those_of_single_tables():
    rng = np.random.default_rng(3)
    for rows, columns in ((1, 1), (2, 5), (3, 3), (4, 6), (8, 8), (8, 20)):
        costs = rng.integers(0, 4, (30, rows, columns)) / 7.0  # many equal choices
        assert solve.best_assignments(costs).tolist() == [solve.best_assignment(c) for c in costs]


def test_orders_of_eight_lines_are_assigned_in_time(spark):
    """Thousands of tables of eight ranges a second, not a hundred."""
    rng = np.random.default_rng(4)
    v, low = rng.integers(1, 50, (6000, 8)).astype(float), rng.integers(0, 50, (6000, 8)).astype(float)
    of = solve.assigned_ranges.func
    began = time.process_time()
    got = of(pd.Series(list(v)), pd.Series(list(low)), pd.Series(list(low + 3)))
    assert time.process_time() - began < 6
    for k in range(0, 6000, 400):
        assert got[k] == solve.best_assignment(solve.range_cost(v[k][:, None], low[k][None, :], low[k][None, :] + 3))


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_words_against_all_rows(seed):
    """Rows that are over change nothing, whatever the heights; long pages stay cheap."""
    rng = np.random.default_rng(seed)
    n = 400
    top = np.round(rng.random(n) * (60, 600, 3000)[seed % 3], 1)
    bottom = top + np.round(rng.choice([-2, 0.5, 8, 12, 90], n, p=[0.05, 0.1, 0.5, 0.3, 0.05]) + rng.random(n), 1)
    order = np.argsort((top + bottom) / 2, kind="stable")
    top, bottom = top[order], bottom[order]
    got, plain = (f(top, bottom, (top + bottom) / 2) for f in (layout.rows_of, layout._plain_rows))
    assert got[0].tolist() == plain[0].tolist() and got[1].tolist() == plain[1].tolist()
    long = np.repeat(np.arange(6000.0) * 30, 10)
    began = time.process_time()
    assert layout.rows_of(long, long + 12, long + 6)[0].tolist() == np.repeat(np.arange(6000), 10).tolist()
    assert time.process_time() - began < 2


def test_pages_that_span_batches(spark):
    words = [(f"p{p}" if p else None, f"{p}-{i}", i % 10 * 20.0, i % 10 * 20.0 + 15, i // 10 * 30.0, i // 10 * 30.0 + 12) for p in range(4) for i in range(p * 37 + 5)]
    random.Random(2).shuffle(words)
    table = spark.createDataFrame(words, "page string, text string, left double, right double, top double, bottom double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = layout.words_to_rows(table).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(f"p{p}" if p else None, i // 10, i % 10, f"{p}-{i}") for p in range(4) for i in range(p * 37 + 5)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_numbers_of_many_items_are_solved_together(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    for parts in (1 << 20, 16):  # choices compared at once
        monkeypatch.setattr(solve, "MOST_CHOICES", parts)
        for n in (7, 9):
            v = rng.integers(1, 20, (12, n)) / rng.choice([1.0, 2.0], (12, 1))
            found = [None if np.isnan(x[-1]) else tuple(x) for x in solve.solutions(v)]
            assert found == [plain_solution(x) for x in v] and any(found)
    table = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([40, 40, 12, 52, 4, 56, 14, 70])] + [(2, i % 3, 5.0) for i in range(50)] + [(None, i, 5.0 + i) for i in range(9)], "k int, p int, v double")
    rows = solve.composition(table.repartition(3), "k", "p", "v")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert [(r.k, r.weight) for r in rows.collect()] == [(1, 70.0)]


def test_items_of_any_size_are_solved(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(11)
    for parts in (1 << 20, 32):  # sums compared at once
        monkeypatch.setattr(solve, "MOST_CHOICES", parts)
        for n in (7, 8, 9):
            for v in (rng.integers(1, 20, n) / 2, rng.choice(rng.integers(1, 90, 6) / 10, n), rng.integers(80, 90, n) * 1.0, np.append(rng.integers(1, 12, n - 1), 250.0)):
                found = solve.widest(v)
                assert (None if np.isnan(found[-1]) else tuple(found)) == plain_solution(v)
    monkeypatch.undo()
    for v in (rng.integers(1, 300, 30) / 10, rng.random(30) * 40, rng.permutation(np.tile(np.arange(1.0, 16), 4))):
        assert solve.widest(v).tolist() == solve.solutions(v[None, :])[0].tolist()


def test_keys_of_many_numbers_are_solved(spark):
    import numpy as np

    solvable = [40, 40, 12, 52, 4, 56, 14, 70]
    items = {"21": [5] * 13 + solvable, "many": [5] * 3000 + solvable[::-1], "different": [5] * 9 + solvable + [80 + k / 8 for k in range(21)], "none": range(100, 131), "few": solvable[:6] * 9}
    table = spark.createDataFrame([(k, i, float(x)) for k, v in items.items() for i, x in enumerate(v)], "k string, p int, v double")
    got = {r.k: tuple(r)[1:] for r in solve.composition(table.repartition(3), "k", "p", "v").collect()}
    want = (70.0, 56.0, 14.0, 52.0, 4.0, 40.0, 12.0, 0.0)
    plan = solve.composition(table, "k", "p", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    different = solve.solutions(np.array(items["different"][6:], float)[None, :])[0]
    assert got == {"21": want, "many": want, "different": tuple(different)} and different[0] == 82.5
