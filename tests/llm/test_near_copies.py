import random

import numpy as np

from somalog.llm import near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def plain_groups(texts):
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def texts(rng, n_groups, copies, edits):
    vocabulary = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(n_groups):
        words = rng.choices(vocabulary, k=rng.choice([60, 150, 400]))
        for _ in range(rng.randint(1, copies)):
            copy = list(words)
            for _ in range(rng.randint(0, edits * len(words) // 100)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_groups_against_all_pairs(spark):
    rng = random.Random(5)
    rows = texts(rng, 60, 6, 3) + texts(rng, 3, 60, 2) + texts(rng, 40, 2, 6)
    rows += [None, "", " ", "one", "One", "two words here", rows[0].upper(), "long " * 30_000, "long " * 20_000]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, row int, `group` string").repartition(3)
    got = {r.doc_id: r.group for r in near_copies.with_group(docs).collect()}
    want = plain_groups(rows)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if want[i] == want[j]]
    assert all(want[i] == want[j] for i in got for j in range(i) if got[i] == got[j])  # nothing else is joined
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({g: min(i for i in got if got[i] == g) for g in got.values()}.values())


def test_big_nodes_and_pairs_that_fail(spark):
    rng = random.Random(6)
    rows = texts(rng, 2, 1, 0)[:1] * 3 + texts(rng, 1, 400, 1) + texts(rng, 1, 200, 14)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.group for r in near_copies.with_group(docs).collect()}
    want = plain_groups(rows)
    assert all(want[i] == want[j] for i in got for j in range(i) if got[i] == got[j])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if want[i] == want[j]]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)


def test_reach_and_tables():
    rng = np.random.default_rng(7)
    head, n_tables = near_copies.tables(1 << 20, 0.8, near_copies.RECALL)
    assert near_copies.tables(1 << 30, 0.8, 0.97)[0] > head
    orders, most, met, near = near_copies._bit_orders(n_tables), near_copies.reach(0.8), 0, 0
    for _ in range(200):
        items = rng.integers(0, 1 << 63, 360, dtype=np.uint64)
        pair = [np.sort(items[:324]), np.sort(items[36:])]  # 288 of 360: 0.8
        prints = np.array([np.frombuffer(near_copies.wide_fingerprint(x), np.uint8) for x in pair])
        near += int(np.bitwise_count(prints[0] ^ prints[1]).sum()) <= most
        met += any(len(set((near_copies._ranks(prints, o) >> np.uint64(64 - head)).tolist())) == 1 for o in orders)
    assert near >= 195 and met >= 185


def test_keep_one_keeps_a_row_of_every_group(spark):
    rng = random.Random(4)
    one, two, three, four = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(4))
    rows = [(None, one), (None, two), (None, two), (5, three), (5, four), (5, four), (None, four), (7, three), (8, None), (None, "")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, one), (None, two), (5, three), (5, four), (8, None)], key=str)
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bins_rule_no_near_copies_out():
    rng = random.Random(9)
    sets = [near_copies.shingles(t.encode()) for t in texts(rng, 12, 8, 12)]
    size = np.array([len(x) for x in sets], np.int64)
    counts = np.array([np.frombuffer(near_copies.bins(x), np.uint8) for x in sets])
    a, b = np.triu_indices(len(sets), 1)
    may = near_copies._may_fit(size, counts, 0.8)(a, b)
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    near = both * 5 >= 4 * (size[a] + size[b] - both)
    assert near.any() and may[near].all() and (may == near).mean() > 0.99
