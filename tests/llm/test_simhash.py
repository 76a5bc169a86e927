import random

import numpy as np
import xxhash

from somalog.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprint_is_the_majority_of_shingle_hashes():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "one", "One tWo three", "ÄB c d e", *(" ".join(rng.choices("ab cd ef ß".split(), k=rng.randint(1, 40))) for _ in range(50))]:
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_spanning_forest_joins_the_same_components_as_all_pairs():
    rng = np.random.default_rng(2)
    for n, flips in ((2, 3), (300, 4), (700, 6), (900, 64)):
        base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
        words = np.unique(np.array([int(base[rng.integers(3)]) ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, flips))}) for _ in range(n)], dtype=np.uint64))
        words = words[np.argsort(simhash.gray_rank(words))]
        prints = dict(enumerate(int(w) for w in words))
        want = plain_components(prints)
        forest = simhash._Forest(len(words))
        kept = simhash.linked(words, 4)
        forest.link(*np.array(kept, dtype=int).reshape(-1, 2).T)
        assert {i: forest.root(i) for i in prints} == want
        assert len(kept) == len(words) - len(set(want.values()))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([3, 60, 400]))
        for _ in range(rng.choice([1, 5, 30])):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "a", "a", "word " * 5000]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, "x", 7) for i, t in enumerate(texts)] + [(None, texts[0], "x", 7), (1, texts[0], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = {i: plain_fingerprint(t) for i, t, _, _ in rows if i is not None}
    want = plain_components(prints)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == want[1]
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def flipped(monkeypatch, prints):
    """Fingerprints by text, instead of those that texts have."""
    from pyspark.sql import functions as F

    mapped = F.create_map(*(F.lit(x) for pair in prints.items() for x in pair))
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs: docs.select("doc_id", mapped[F.col("text")].alias("fp")))


def test_rows_without_doc_id_link_and_bridge(spark, monkeypatch):
    flipped(monkeypatch, {"a": 0, "b": 0b111, "c": 0b111111, "d": 1 << 40, "e": 0b11 << 40, "f": 0x7FFF << 45})
    rows = [(7, "a"), (None, "b"), (9, "c"), (None, "d"), (None, "e"), (3, "f")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.fingerprint[-12:], str(r.doc_id), r.component_id) for r in got) == sorted(
        [("0" * 12, "7", 7), ("0" * 11 + "7", "None", 7), ("0" * 10 + "3f", "9", 7), ("010000000000", "None", 7), ("030000000000", "None", 7), ("e00000000000", "3", 3)]
    )


def test_hubs(spark):
    rows = [(0, i) for i in range(1, 300)] + [(i, i + 1000) for i in range(1, 200)] + [(5000, 5001)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(rows, "a long, b long"), hub=10).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{i + 1000: 0 for i in range(1, 200)}, 5000: 5000, 5001: 5000}


def test_links_of_fingerprints_by_themselves(spark):
    near = simhash.components(simhash._links(spark.createDataFrame([(v, v) for v in (0, 15, 255)], "fp long, rep long"), 4))
    assert {r.node: r.component for r in near.collect()} == {0: 0, 15: 0, 255: 0}
