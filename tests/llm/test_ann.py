import numpy as np

from somalog.llm import ann


def plain(rows, k=5):
    rows = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, x in rows.items():
        if q % 50 == 0:
            scored = sorted((-(x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()), i) for i, y in rows.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_exact_when_all_are_reranked(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(60)]  # a copied vector
    rows += [(1000, None), (1050, []), (1100, [0.0] * 8), (1150, [float("nan")] + [1.0] * 7), (1200, [float("inf")] + [1.0] * 7), (1250, [1.0] * 7), (1251, [2.0] * 7), (None, [1.0] * 8), (1300, [None] * 8), rows[100]]
    docs = table(spark, rows)
    want = plain(rows)
    for shard_rows in (100_000, 50):
        got = ann.search(docs, docs.where("vec_id % 50 = 0"), rerank=1.0, shard_rows=shard_rows).collect()
        assert {r.query_id for r in got} == {q for q, found in want.items() if found}
        for q, found in want.items():
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [r for r, _, _ in mine] == list(range(1, len(found) + 1))
            assert [v for _, v, _ in mine] == [v for v, _ in found]
            assert np.allclose([s for *_, s in mine], [s for _, s in found])


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 64))
    rows = [(i, (centres[i % 10] + 2 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(3000)]
    docs = table(spark, rows)
    got = {}
    for r in ann.search(docs, docs.where("vec_id % 50 = 0"), shard_rows=1500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain(rows)
    assert np.mean([len(got[q] & {v for v, _ in found}) / 5 for q, found in want.items()]) >= 0.9


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(5)
    vectors, pivots = rng.normal(size=(50, 6)), rng.normal(size=(12, 6))
    shard, orders = ann.Shard(vectors, pivots, 5), ann._nearest(vectors, pivots, 5)

    def footrule(a, b):
        places = lambda o: np.array([list(o).index(p) if p in o else 5 for p in range(12)])
        return np.abs(places(a) - places(b)).sum()

    for q in range(10):
        got = shard.candidates(orders[q], 20)
        far = [footrule(orders[q], o) for o in orders]
        assert max(far[i] for i in got) <= sorted(far)[19]


def test_empty_table(spark):
    docs = table(spark, [])
    assert ann.search(docs, docs).count() == 0


def test_huge_and_tiny_norms_and_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (1, [1e-200, 0.0]), (2, [1e200, 1e200]), (3, [1e-310, -1e-310]), (4, [-1e308, 0.0]), (5, [3.0, 4.0]), (5, [0.6, 9.0]), (5, [3.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in ann.search(vectors, vectors.where("vec_id = 50")).collect()}
    want = {1: 1.0, 2: 0.5**0.5, 3: 0.5**0.5, 4: -1.0, 5: 0.6 / (0.36 + 81) ** 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
