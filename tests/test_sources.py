import json
import zipfile

import pytest

from somalog.sources import commits, health_export, store

STRENGTH, HR, KCAL = health_export.STRENGTH, health_export.HEART_RATE, health_export.ENERGY


def record(kind, unit, start, end, value, source="Watch"):
    return f'<Record type="{kind}" sourceName="{source}" unit="{unit}" startDate="{start}" endDate="{end}" value="{value}"/>'


def workout(start, end, inner="", extra='duration="60" durationUnit="min"', kind=STRENGTH):
    head = f'<Workout workoutActivityType="{kind}" {extra} startDate="{start}" endDate="{end}"'
    return f"{head}>{inner}</Workout>" if inner else f"{head}/>"


T = "2030-01-15 {} +0800".format


def export(*parts):
    return "<HealthData>\n" + "\n".join(parts) + "\n</HealthData>"


def logs(spark, tmp_path, *parts):
    path = tmp_path / "export.xml"
    path.write_text(export(*parts))
    return {r.start_at[11:16]: r for r in health_export.import_xml(spark, str(path)).collect()}


def test_declared_statistics_come_first(spark, tmp_path):
    stats = f'<WorkoutStatistics type="{HR}" average="101.25" minimum="85" maximum="125" unit="count/min"/>'
    got = logs(
        spark,
        tmp_path,
        *(record(HR, "count/min", T(at), T(at), v, s) for at, v, s in (("10:30:00", 90, "A"), ("10:30:00", 90, "B"), ("10:40:00", 100, "A"), ("10:50:00", 110, "A"))),
        workout(T("10:30:00"), T("11:30:00"), stats),
        workout(T("08:00:00"), T("08:30:00"), kind="Running"),
    )
    (log,) = got.values()
    assert log.id == "apple-health:strength:2030-01-15T10:30:00+08:00" and log.duration_minutes == 60
    assert (log.heart_rate_bpm.average_bpm, log.heart_rate_bpm.min_bpm, log.heart_rate_bpm.max_bpm) == (101.25, 85, 125)
    assert [(s.at[11:19], s.bpm, s.end_at) for s in log.heart_rate_bpm.samples] == [("10:30:00", 90, None), ("10:40:00", 100, None), ("10:50:00", 110, None)]


def test_samples_fill_in_and_sessions_without_any_stay(spark, tmp_path):
    got = logs(
        spark,
        tmp_path,
        record(HR, "bpm", T("10:05:00"), T("10:05:30"), 80),
        record(HR, "bpm", T("10:06:00"), T("10:06:00"), 100),
        record(HR, "furlong", T("10:07:00"), T("10:07:00"), 900),
        *(record(KCAL, "kcal", T("10:08:00"), T("10:09:00"), v) for v in (12.5, 12.5, 7.5)),
        record(HR, "bpm", T("10:30:01"), T("10:30:01"), 120),  # a second after the end still counts
        record(HR, "bpm", T("10:30:02"), T("10:30:02"), 999),
        record(HR, "bpm", T("09:59:59"), T("09:59:59"), 999),
        workout(T("10:00:00"), T("10:30:00"), extra='duration="1800" durationUnit="sec"'),
        workout(T("12:00:00"), T("13:00:00"), extra='duration="1" durationUnit="hr" totalEnergyBurned="300" totalEnergyBurnedUnit="kcal"'),
        workout(T("20:00:00"), T("21:00:00"), f'<WorkoutStatistics type="{HR}" average="130" minimum="80" maximum="165" unit="count/min"/>'),
    )
    a, b, c = got["10:00"], got["12:00"], got["20:00"]
    assert (a.heart_rate_bpm.average_bpm, a.heart_rate_bpm.min_bpm, a.heart_rate_bpm.max_bpm) == (100, 80, 120)
    assert a.duration_minutes == 30 and a.active_energy_kcal == 20
    assert b.heart_rate_bpm is None and b.active_energy_kcal == 300 and b.duration_minutes == 60
    assert c.heart_rate_bpm.samples == [] and c.heart_rate_bpm.average_bpm == 130


def test_later_session_wins_where_sessions_overlap(spark, tmp_path):
    got = logs(
        spark,
        tmp_path,
        record(HR, "bpm", T("10:20:00"), T("10:20:00"), 70),
        record(HR, "bpm", T("10:40:00"), T("10:40:00"), 90),
        workout(T("10:00:00"), T("12:00:00")),
        workout(T("10:10:00"), T("10:30:00")),
    )
    assert got["10:10"].heart_rate_bpm.average_bpm == 70
    assert got["10:00"].heart_rate_bpm is None  # it still runs at 10:40, but another started after it


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_zip(spark, tmp_path, method):
    with zipfile.ZipFile(tmp_path / "export.zip", "w", method) as z:
        z.writestr("other/export.xml", "<HealthData/>")
        z.writestr("apple_health_export/export.xml", export(workout(T("10:00:00"), T("10:30:00"))))
        z.writestr("apple_health_export/export_cda.xml", "<x/>")
    (member,) = health_export.zip_members(spark, str(tmp_path / "export.zip")).collect()
    assert member.name == "apple_health_export/export.xml" and member.method == method
    assert health_export.import_zip(spark, str(tmp_path / "export.zip"), str(tmp_path / "xml")).count() == 1


def body(id_, at, name=None, weight=70.0, **more):
    return {"id": id_, "kind": "body_composition", "measured_at_local": at, "source": {"type": "tanita_receipt", "filename": name}, "metrics": {"weight_kg": weight}, **more}


def batch(spark, *rows):
    return spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(rows)], "raw string, place long")


def stored(spark, root):
    return sorted((r.period, json.loads(r.raw)["id"], json.loads(r.raw)["metrics"]["weight_kg"]) for r in store.read(spark, root).collect())


def test_store(spark, tmp_path):
    root = str(tmp_path / "logs")
    assert store.read(spark, root).count() == 0 and store.clear(spark, root) == 0
    first = batch(spark, body("a", "2031-04-30T23:00:00+08:00", "One.pdf"), body("b", "2031-05-01T00:00:00", "two.pdf"), body("c", None))
    assert store.save(spark, root, first) == 3
    assert stored(spark, root) == [("2031-04", "a", 70.0), ("2031-05", "b", 70.0), ("unknown", "c", 70.0)]
    assert store.save(spark, root, first) == 0
    assert store.save(spark, root, batch(spark, body("a", "2031-04-30T23:00:00+08:00", "One.pdf", 70), body("d", "2031-05-02", " TWO.pdf ", 71.5))) == 1
    assert stored(spark, root) == [("2031-04", "a", 70.0), ("2031-05", "d", 71.5), ("unknown", "c", 70.0)]
    assert store.save(spark, root, batch(spark, body("e", "2031-05-03", "x", 1), body("e", "2031-05-03", "x", 2))) == 1
    assert stored(spark, root)[2] == ("2031-05", "e", 2)

    assert [json.loads(r.raw)["id"] for r in store.newest(spark, root).orderBy("id").collect()] == ["d", "e"]
    assert not store.delete(spark, root, "2031-04:d") and not store.delete(spark, root, "nothing")
    assert store.delete(spark, root, "d") and store.delete(spark, root, "c")
    store.export_lines(spark, root, str(tmp_path / "out"))
    assert [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "e"]
    assert store.clear(spark, root) == 2 and store.read(spark, root).count() == 0


def interfering(monkeypatch, others):
    """Before each claim of a version but theirs, the next of others runs, if any is left."""
    claim, inside = commits.put_if_absent, []

    def late(*args):
        if others and not inside:
            inside.append(1)
            others.pop(0)()
            inside.pop()
        return claim(*args)

    monkeypatch.setattr(commits, "put_if_absent", late)
    monkeypatch.setattr(store, "WAIT_MS", 1)


def test_interleaved_writers_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "logs")
    one, two = batch(spark, body("a", "2031-05-01", "f1", 1)), batch(spark, body("b", "2031-05-02", "f2", 2), body("a", "2031-05-01", "f1", 9))
    interfering(monkeypatch, [lambda: store.save(spark, root, two)])
    assert store.save(spark, root, one) == 1  # merged again, after the other
    assert stored(spark, root) == [("2031-05", "a", 1), ("2031-05", "b", 2)]
    other = batch(spark, body("c", "2031-06-01", "f3", 3))
    others = [lambda: store.save(spark, root, other), lambda: store.delete(spark, root, "b")]
    interfering(monkeypatch, others)
    assert store.save(spark, root, batch(spark, body("d", "2031-05-07", "f4", 4))) == 1
    assert stored(spark, root) == [("2031-05", "a", 1), ("2031-05", "d", 4), ("2031-06", "c", 3)]
    assert [store.read(spark, root, v).count() for v in range(6)] == [0, 2, 2, 3, 2, 3]


def test_writers_of_other_months_need_no_second_merge(spark, tmp_path, monkeypatch):
    root, merges = str(tmp_path / "logs"), []
    merged = store._merged
    monkeypatch.setattr(store, "_merged", lambda *args: merges.append(1) or merged(*args))
    interfering(monkeypatch, [lambda k=k: store.save(spark, root, batch(spark, body(f"x{k}", f"2031-1{k}-01", f"g{k}", k))) for k in range(2)])
    assert store.save(spark, root, batch(spark, body("a", "2031-05-01", "f1", 1))) == 1
    assert len(merges) == 3 and [r[1] for r in stored(spark, root)] == ["a", "x0", "x1"]


def test_writers_give_up_after_three_attempts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "logs")
    interfering(monkeypatch, [lambda k=k: commits.commit(spark, root, commits.newest(spark, root), {"2031-05": f"data/write=w{k}/period=2031-05"}, f"w{k}") for k in range(3)])
    monkeypatch.setattr(store, "_of", lambda spark, root, manifest: spark.createDataFrame([], store.STORED))
    with pytest.raises(commits.Conflict):
        store.save(spark, root, batch(spark, body("a", "2031-05-01", "f1", 1)))
    assert commits.newest(spark, root).write == "w2" and store.vacuum(spark, root, keep_ms=-1) == 0


def test_a_failure_midway_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "logs")
    store.save(spark, root, batch(spark, body("a", "2031-05-01", "f1", 1)))
    before = stored(spark, root)

    def crash(*_):
        raise MemoryError("the driver is gone")

    monkeypatch.setattr(commits, "put_if_absent", crash)
    for change in (lambda: store.save(spark, root, batch(spark, body("a", "2031-05-01", "f1", 2))), lambda: store.clear(spark, root), lambda: store.delete(spark, root, "a")):
        with pytest.raises(MemoryError):
            change()
        assert stored(spark, root) == before
    monkeypatch.undo()
    assert store.vacuum(spark, root) == 0 and store.vacuum(spark, root, keep_ms=-1) == 3 and stored(spark, root) == before


def test_a_claim_that_failed_after_it_was_made_counts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "logs")
    claim = commits.put_if_absent

    def unsure(*args):
        claim(*args)
        return spark.sparkContext._jvm.java.nio.file.Files.size(spark.sparkContext._jvm.java.io.File("/nowhere").toPath())  # an I/O error

    monkeypatch.setattr(commits, "put_if_absent", unsure)
    assert store.save(spark, root, batch(spark, body("a", "2031-05-01", "f1", 1))) == 1
    assert stored(spark, root) == [("2031-05", "a", 1)]


@pytest.mark.parametrize("scheme", ["file", "other"])
def test_a_file_is_put_only_once(spark, tmp_path, monkeypatch, scheme):
    path = f"{tmp_path}/m/1.json"
    if scheme == "other":  # as on file systems whose rename refuses names that are taken
        inner = commits._fs

        class Named:
            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, name):
                return (lambda: "other") if name == "getScheme" else getattr(self.fs, name)

        monkeypatch.setattr(commits, "_fs", lambda spark, p: (lambda target, fs: (target, Named(fs)))(*inner(spark, p)))
    assert commits.put_if_absent(spark, path, "one") and not commits.put_if_absent(spark, path, "two")
    assert commits._text(spark, path) == "one" and list(commits.children(spark, f"{tmp_path}/m")) == ["1.json"]


def test_older_month_wins_an_id(spark, tmp_path):
    root = str(tmp_path / "logs")
    store.save(spark, root, batch(spark, body("x", "2031-05-01", "f1", 1), body("y", "2031-05-02", "f2", 2)))
    store.save(spark, root, batch(spark, body("x", "2031-04-01", "f3", 3), body("z", None, "f4", 4)))
    got = {r.id: json.loads(r.raw)["metrics"]["weight_kg"] for r in store.all_logs(spark, root).collect()}
    assert got == {"x": 3, "y": 2, "z": 4}


def test_array_files(spark, tmp_path):
    (tmp_path / "2031-04.json").write_text(json.dumps([body("a", "2031-04-01"), body("b", "2031-04-02")], indent=1))
    (tmp_path / "Unknown.json").write_text("")
    (tmp_path / "notes.json").write_text("[]")
    got = store.from_array_files(spark, str(tmp_path)).collect()
    assert [(r.period, r.place, json.loads(r.raw)["id"]) for r in got] == [("2031-04", 0, "a"), ("2031-04", 1, "b")]
    with pytest.raises(Exception, match="needs id and kind"):
        store.parsed(batch(spark, {"id": "", "kind": "x"}).selectExpr("raw", "place", "'' AS period")).collect()


def test_batches_and_months_are_merged_before_they_are_stored(spark, tmp_path):
    root = str(tmp_path)
    record = lambda id_, at, v: f'{{"id":"{id_}","kind":"k","start_at":"{at}T00:00:00","v":{v}}}'
    batch = [(record("a", "2024-01-05", 1), 0), (record("a", "2024-02-05", 2), 1), (record("b", "2024-01-06", 3), 2)]
    assert store.save(spark, root, spark.createDataFrame(batch, "raw string, place long")) == 2
    assert sorted((r.period, r.raw) for r in store.read(spark, root).collect()) == [("2024-01", batch[2][0]), ("2024-02", batch[1][0])]
    assert store.save(spark, root, spark.createDataFrame(batch[1:], "raw string, place long")) == 0
    month = spark.createDataFrame([(record("c", "2024-03-01", 1), 0, "2024-03"), (record("c", "2024-03-02", 2), 1, "2024-03")], "raw string, place long, period string")
    older = f"{root}/older"  # as stores were before they had versions
    month.write.mode("append").partitionBy("period").parquet(f"{older}/events")
    assert [r.raw for r in store.all_logs(spark, older).where("id = 'c'").collect()] == [month.collect()[1].raw]
    assert store.save(spark, older, spark.createDataFrame(batch, "raw string, place long")) == 2
    assert sorted(r.period for r in store.read(spark, older).collect()) == ["2024-01", "2024-02", "2024-03", "2024-03"] and store.read(spark, older, 0).count() == 2
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("staged")]
