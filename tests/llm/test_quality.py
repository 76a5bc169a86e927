import math
import random

import numpy as np

from somalog.llm import quality


def tables(spark, n=300):
    rng = random.Random(9)
    good, junk = [f"good{i}" for i in range(60)], [f"junk{i}***" for i in range(60)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choices(junk if bad else good, k=rng.randint(30, 90))), int(not bad)))
    docs = spark.createDataFrame([(i, t, True) for i, t, _ in rows] + [(n, None, True), (n + 1, "", True), (None, "good1", True), rows[5][:2] + (True,)], "doc_id long, text string, target boolean")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 3], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_counts_and_weights_against_plain(spark):
    docs, labels, rows = tables(spark)
    grams, wanted = quality.Grams(500), {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = np.ones(500), np.ones(500)
    for r in docs.collect():
        n = np.bincount(grams.of(r.text.encode() if r.text else None), minlength=500)
        raw += n
        if r.doc_id in wanted:
            target += n
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    ratio = quality.log_ratio(docs, labels, 500)
    assert np.allclose(ratio, want)
    for r in quality.log_weights(docs, ratio).collect():
        text = next(x.text for x in docs.collect() if x.doc_id == r.doc_id)
        assert math.isclose(r.log_weight, want[grams.of((text or "").encode())].sum(), abs_tol=1e-9)


def test_kth_key(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1e5), 1.5, -3.0, rng.random()]) for _ in range(2000)]
    keys = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 500, 1999, 2000, 3000):
        assert quality.threshold(keys, "v", k) == ranked[min(k, 2000) - 1]
    assert quality.threshold(keys.limit(0), "v", 3) == math.inf


def test_sample_follows_quality(spark):
    docs, labels, rows = tables(spark)
    got = quality.resample(docs, labels, keep=0.7, buckets=500).collect()
    kept = {r.doc_id for r in got if r.selected}
    held = [(i, q) for i, _, q in rows if i % 3 == 0]
    assert sum(i in kept for i, q in held if q) / sum(q for _, q in held) > 0.9
    assert sum(i in kept for i, q in held if not q) / sum(1 - q for _, q in held) < 0.1
    again = quality.resample(docs.repartition(7), labels, keep=0.7, buckets=500)
    assert {r.doc_id for r in again.collect() if r.selected} == kept
    assert abs(len([r for r in got if r.selected]) - math.ceil(0.7 * len(got))) <= 1


def test_without_target_or_rows(spark):
    docs, labels, _ = tables(spark, 8)
    assert {r.log_weight for r in quality.resample(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.resample(docs.limit(0), labels).count() == 0
