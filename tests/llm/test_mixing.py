import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from somalog.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, taken string, _inside int")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = Decimal(sum(sizes.values())) * Decimal(str(share)), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: float(left * weight[s] / total) for s in open_}
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        open_ -= over
    return target


def test_budgets_are_met_exactly(spark):
    rows = [(i, ["a", "b", None, "é", "zero"][i % 5 if i < 200 else 0], None if i % 5 == 4 and i < 200 else "w " * (i % 17), "old", 1) for i in range(700)]
    rows += [rows[3], rows[3], (None, "b", "x y z", "old", 1)]
    sizes = {}
    for _, s, t, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    for per_bucket in (7, 10_000):
        got = mixing.mix(mixing.with_size(docs(spark, rows)), rows_per_bucket=per_bucket).collect()
        assert len(got) == len(rows)
        taken = {}
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert taken == {s: int(want[s] + 1e-9) for s in sizes}


def test_bucket_size_does_not_change_the_mix(spark):
    rows = [(i, "ab"[i % 2], "w " * (1 + i % 9), "", 0) for i in range(300)]
    one, two = (sorted((r.doc_id, r.taken) for r in mixing.mix(mixing.with_size(docs(spark, rows)), rows_per_bucket=n).collect()) for n in (5, 1000))
    assert one == two


def test_mixed_rows_repeat_and_cut_texts(spark):
    rows = [(i, "abc"[i % 3], "u v w x" if i % 2 else "t", "keep", 0) for i in range(60)]
    table = docs(spark, rows)
    out = mixing.mixed_rows(table)
    assert out.columns == table.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.with_size(table)).collect()}
    words = {}
    for r in out.collect():
        assert rows[r.doc_id][2].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}


def test_empty_table_and_no_words(spark):
    assert mixing.mix(mixing.with_size(docs(spark, []))).count() == 0
    got = mixing.mix(mixing.with_size(docs(spark, [(1, "a", None, "", 0), (2, None, "", "", 0)]))).collect()
    assert [r.taken for r in got] == [0, 0]


def test_rows_without_doc_id_are_dealt_by_size(spark):
    rows = [(None if i % 2 else i, "s", i % 7, i) for i in range(60)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long, _key long").withColumn("_row", F.lit("kept")).withColumn("_bucket", F.lit(3))
    got = mixing.mix(sized, share=0.6, rows_per_bucket=20)
    assert got.columns == [*sized.columns, "source_size", "target", "taken"]
    got = got.collect()
    total, budget = sum(r[2] for r in rows), int(got[0].target)
    assert sum(r.taken for r in got) == budget and budget == int(total * 0.6)
    md5 = lambda x: hashlib.md5(str(x if x is not None else "null").encode()).hexdigest()
    order, before, want = sorted(rows, key=lambda r: (md5(r[0]), r[0] is not None, r[0] or 0, r[2])), 0, []
    for r in order:
        want.append((str(r[0]), r[2], max(0, min(r[2], budget - before))))
        before += r[2]
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted(want)


def test_rows_without_doc_id_mix_alike_in_any_order(spark):
    rows = [(None if i % 3 else i, "s", f"word{i} x y" if i % 2 else f"a{i} b", f"l{i % 5}", i % 4) for i in range(120)]
    rows += [(None, "s", "same same", "l", k) for k in range(30)]  # told apart by other columns alone
    table = docs(spark, rows)
    mixes = [sorted(map(tuple, mixing.mixed_rows(t, share=0.7, rows_per_bucket=40).collect()), key=str) for t in (table, table.orderBy("text").repartition(7), table.repartition(3, "_inside"))]
    assert mixes[0] == mixes[1] == mixes[2] and 100 < len(mixes[0]) < 150
