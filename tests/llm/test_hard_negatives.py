import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from somalog.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, x int, score int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def mined(spark, rows, **parameters):
    vectors = hard_negatives.quantized(table(spark, rows), F.col("label"))
    return {tuple(r) for r in hard_negatives.mine(vectors, vectors.where("vec_id % 10 = 0"), **parameters).collect()}


def plain(rows, every=10):
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            row = label, [math.floor(256 * float(np.float32(x))) for x in v]
            fine[i] = min(fine.get(i, row), row)
    out = set()
    for a, (label, x) in fine.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, lab) for i, (lab, y) in fine.items() if i != a and len(y) == len(x))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            ps = -s
            fits = [(i, -t) for t, i, lab in scored if lab != label and 80 * ps <= -100 * t <= 100 * ps]
            out |= {(a, p, k, i, ps, ns) for k, (i, ns) in enumerate(fits[:5], 1)}
    return out


def some_rows():
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=20).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(300 + i, rows[10][1], i % 3) for i in range(60)]  # a copied vector under all labels
    rows += [(1000 + i, rng.normal(size=8).astype(np.float32).tolist(), i % 2) for i in range(40)]  # another length
    rows += [(2000, None, 1), (2010, [], 1), (2020, [1.0] * 20, None), (2030, [float("nan")] + [1.0] * 19, 1), (2040, [float("inf")] * 20, 1), (2050, [None] * 20, 1), (None, [1.0] * 20, 1)]
    rows += [rows[20], (30, [0.5] * 20, 0), (2060, [0.0] * 20, 0), (2070, [-1.0] * 20, 7)]
    return rows


@pytest.mark.parametrize("shard_rows, block_rows", [(100_000, 64), (50, 3)])
def test_against_plain_products(spark, shard_rows, block_rows):
    rows = some_rows()
    assert mined(spark, rows, shard_rows=shard_rows, block_rows=block_rows) == plain(rows)


def test_empty_and_single_label(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(i, [1.0, float(i)], 4) for i in range(30)]) == set()
    assert mined(spark, [(0, [1.0], 1)]) == set()


def test_scores_are_exact_products():
    rng = np.random.default_rng(1)
    for dim, top in ((1, 1), (8, 300), (13, 2), (64, 1 << 20)):
        a, c = rng.integers(-top, top, size=(7, dim)), rng.integers(-top, top, size=(50, dim))
        got = hard_negatives.scores(hard_negatives.planes(c), hard_negatives.subset_sums(a))
        assert (got == c @ a.T).all()
    sums = hard_negatives.subset_sums(np.array([[1, 2, 4, 8, 16, 32, 64, 128]]))
    assert sums[0, 0b10000001, 0] == 129 and sums[0, 0b01000000, 0] == 2


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1), (2, [1.0], 2)])
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 1), (2, [1e12], 2)])


def test_whole_table_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op13_hard_negatives(spark, folder)
    rows = {tuple(r) for r in got.collect()}
    own = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert rows and rows == plain(own, every=100)
    base = duckdb.connect()
    base.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert set(base.sql(f"SELECT {', '.join(got.columns)} FROM ({hard_negatives.ORACLE_SQL})").fetchall()) == rows
