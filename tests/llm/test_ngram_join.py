import random

import duckdb
import numpy as np
import pytest

from somalog.llm import ngram_join, queries

SCHEMA = "doc_id long, text string, component_id string, n int, token int"


def shingles(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain(rows, percent=85):
    """The sorted results for (doc_id, text), by comparing all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    each = sorted({s for s in sets if s}, key=lambda s: (len(s), sorted(s)))
    parent = {s: s for s in each}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    where = {}
    for s in each:
        for x in s:
            where.setdefault(x, []).append(s)
    for s in each:
        for other in {o for x in s for o in where[x]} - {s}:
            both = len(s & other)
            if 100 * both >= percent * (len(s) + len(other) - both):
                parent[root(s)] = root(other)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return sorted(((i, len(s), least.get(root(s)) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def got(spark, rows, **parameters):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in ngram_join.linked(docs, **parameters).collect()), key=str)


def some_rows(seed, groups=12):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(60)}"  # noqa: E731  few words, so that shingles repeat
    passage = [word() for _ in range(50)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "É a b c d"), (7, "é a b c d"), (None, "one two"), (None, None), (8, "same " * 30), (9, "same " * 9)]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((4, 6, 30, 80, 200, 400)))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 14)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.2:
                text += passage
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(k % 20)])) for k in range(40)]
    rows += [rows[20], (None, rows[21][1]), (20, rows[22][1]), (rows[30][0], rows[30][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = some_rows(seed)
    assert got(spark, rows) == plain(rows)


def test_nothing_is_left_to_the_first_links(spark, monkeypatch):
    """Without first links the prefixes alone find all, in lists of several blocks, at any cost."""
    rows = some_rows(3, groups=6)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    for percent, verify, crowd, block in ((85, 0.0, 1000, 1), (85, 1e6, 2, 700), (70, 32.0, 4, 100_000)):
        sets = ngram_join.screened(docs, percent, 4)
        none = sets.held.selectExpr("sid AS a", "sid AS b").limit(0)
        known = ngram_join.components_of(sets, percent, first=lambda *_: none, verify=verify, crowd=crowd, block=block)
        homes = {r.sid: r.component for r in ngram_join.with_component(sets.sets, known).collect()}
        least = {}
        for r in sets.sets.collect():
            if r.least is not None:
                least[homes[r.sid]] = min(r.least, least.get(homes[r.sid], r.least))
        of_set = {bytes(r.set): least.get(homes[r.sid]) for r in sets.sets.collect()}
        mine = sorted(((r.doc_id, r.n, of_set[bytes(r.set)] if r.n else r.doc_id) for r in sets.rows.collect()), key=str)
        assert mine == plain(rows, percent)


def test_empty_tables_and_long_texts(spark):
    assert got(spark, []) == []
    rng = random.Random(5)
    long = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    other = [f"u{i}" if i % 97 == 0 else w for i, w in enumerate(long)]
    rows = [(5, " ".join(long)), (3, " ".join(other)), (4, " ".join(long[:50_000])), (9, "a b c d e f g")]
    assert got(spark, rows) == plain(rows)


def test_group_of_near_copies_is_one_component(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(900):
        text = list(base)
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    assert {r[2] for r in got(spark, rows)} == {0}


def test_crowds_are_joined_in_place():
    rng = np.random.default_rng(1)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 100 - k % 12, replace=False), rng.integers(1000, 2000, k % 12).astype(np.uint64)])) for k in range(150)]
    home = np.array([k if k % 3 else 0 for k in range(150)])
    parent = {h: h for h in home.tolist()}

    def root(h):
        while parent[h] != h:
            h = parent[h]
        return h

    links = ngram_join.joining_links(np.arange(150), home, sets, 85)
    assert len(links) < len(set(home.tolist()))
    for a, b in links:
        assert ngram_join.similar(sets[a], sets[b], 85) and root(home[a]) != root(home[b])
        parent[root(home[a])] = root(home[b])
    for a in range(150):
        for b in range(a):
            assert root(home[a]) == root(home[b]) or not ngram_join.similar(sets[a], sets[b], 85)


def test_prefixes_grow_where_lists_are_long():
    rare, common = np.array([1] * 10 + [2] * 90), np.array([1] * 10 + [5000] * 90)
    level = lambda df, verify=32.0: ngram_join.prefix_level(df, 100, 85, verify)
    assert level(rare)[0] > 1 and level(common)[1] == level(common)[0] + 15
    assert level(common, 0.0) == (1, 16) and level(common, 1e9)[0] > level(common, 10.0)[0]
    assert ngram_join.prefix_level(np.ones(84, int), 100, 85) == (0, 0) and ngram_join.prefix_level(np.ones(85, int), 100, 85)[1] > 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = plain(rows)
    assert sorted((tuple(r) for r in queries.op11_ngram_join(spark, folder).collect()), key=str) == want
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(base.sql(ngram_join.ORACLE_SQL).fetchall(), key=str) == want
