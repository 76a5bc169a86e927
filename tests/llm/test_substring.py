import hashlib
import random

import numpy as np
import xxhash

from somalog.llm import substring


def place(doc_id, text):
    """What orders documents; without doc_id a hash of the text."""
    uid = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return (substring.LAST, uid - (uid >> 63 << 64)) if doc_id is None else (doc_id, 0)


def plain(rows, width=20):
    first = {}
    for doc_id, text in rows:
        words = (text or "").split()
        for i in range(len(words) - width + 1):
            at = (*place(doc_id, text), i)
            key = tuple(words[i : i + width])
            first[key] = min(first.get(key, at), at)
    out = []
    for doc_id, text in rows:
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] != (*place(doc_id, text), i):
                gone |= set(range(i, i + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(300)]
    passages = [rng.choices(words, k=rng.choice([19, 20, 21, 60, 150])) for _ in range(8)]
    texts = [None, "", " \n", "a " * 45, "a b " * 40, " ".join(passages[3])]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else rng.choices(words, k=rng.randint(1, 80))
        texts.append(" ".join(parts))
    texts += [texts[40]] * 9
    rng.shuffle(texts)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[50], (rows[60][0], rows[61][1]), (None, texts[3]), (None, texts[70]), (None, texts[71] + " x " + texts[72]), (None, texts[72]), (None, texts[72])]


def test_rolling_hashes_and_minima():
    words = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    for width in (1, 2, 3, 5, 7, 16, 20, 31):
        got = substring.rolling(words, width)
        want = [sum(int(w) * pow(substring._BASE, k, 1 << 64) for k, w in enumerate(words[i : i + width])) % (1 << 64) for i in range(200 - width + 1)]
        assert (got == substring._mixed(np.array(want, np.uint64))).all()
        assert (substring._least(words, width) == [min(words[i : i + width]) for i in range(200 - width + 1)]).all()
    assert len(substring.rolling(words[:4], 5)) == 0 and len(substring.rolling(words[:19], 20)) == 0


def test_against_plain_windows(spark):
    rows = corpus(4)
    want = plain(rows)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, uid string, n int").repartition(5)
    for words in (60, 900, 1_000_000):
        got = substring.dedup(docs, chunk_words=words).drop("kept").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_paths_name_an_earlier_source(spark):
    rows = [r for r in dict(corpus(5)).items() if r[0] is not None]
    texts = {i: (t or "").split() for i, t in rows}
    paths = substring.repeated_paths(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert paths
    for p in paths:
        assert (p.source, p.source_start) < (p.doc, p.start)
        n = p.n + 19
        assert texts[p.doc][p.start : p.start + n] == texts[p.source][p.source_start : p.source_start + n]


def test_empty_table(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_phrase_in_every_document_is_dealt_to_many_buckets(spark):
    rng = random.Random(6)
    phrase, words = [f"hot{i}" for i in range(16)], [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(rng.choices(words, k=25) + phrase + rng.choices(words, k=25))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in rows[::7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    often, _ = substring.hot_minimizers(substring._keyed(docs).drop("doc_id"), 20, 5, 1_000_000, 400)
    assert 1 <= len(often) <= 4
    assert not len(substring.hot_minimizers(substring._keyed(docs).drop("doc_id"), 20, 5, 1_000_000, 1_000_000)[0])
    held = [(i, i, np.array([substring.xxhash.xxh3_64_intdigest(w.encode()) for w in t.split()], np.uint64)) for i, t in rows[:400]]

    def largest(hot):
        sizes = {}
        for bucket, blob in substring._Chunk(list(held), 20, 5).packed(64, hot):
            key, least, *_ = substring._unpacked(blob)
            sizes[bucket] = sizes.get(bucket, 0) + int(np.isin(least, often).sum())
        return max(sizes.values()), sum(sizes.values())

    (before, all_before), (after, all_after) = largest(substring.NONE), largest(often)
    assert all_before == all_after and after * 8 < before
    for hot in (1, 400, 1_000_000):
        assert sorted(map(tuple, substring.dedup(docs, hot=hot).drop("kept").collect()), key=str) == plain(rows)


def test_spans_are_verified_at_their_source(spark):
    rows = [r for r in dict(corpus(7)).items() if r[0] is not None]
    texts = {i: (t or "").split() for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = substring._keyed(docs)
    paths = substring.compacted(substring.repeated_paths(docs, chunk_words=900))
    right = paths.collect()
    at = {(p.doc, p.uid, p.source, p.source_uid, p.start - p.source_start, p.start + p.n) for p in right}
    assert not any((p.doc, p.uid, p.source, p.source_uid, p.start - p.source_start, p.start) in at for p in right)
    assert {(p.doc, p.start, p.n) for p in substring.verified(keyed, paths, 20).collect()} == {(p.doc, p.start, p.n) for p in right}
    # as if hashes had met by chance: sources one word off, and spans one window too long
    false = [p for p in right if p.n < len(texts[p.doc]) - p.start - 19 and p.n < len(texts[p.source]) - p.source_start - 19]
    assert len(false) > 10
    wrong = spark.createDataFrame([(*p[:3], p.n + 1, *p[4:]) for p in false], substring.SPANS)
    moved = spark.createDataFrame([(*p[:6], p.source_start + 1) for p in false if p.n > 2], substring.SPANS)
    got = {(p.doc, p.start + k) for p in substring.verified(keyed, wrong, 20).collect() for k in range(p.n)}
    same = lambda p, k: texts[p.doc][p.start + k :][:20] == texts[p.source][p.source_start + k :][:20]
    assert got == {(p.doc, p.start + k) for p in false for k in range(p.n + 1) if same(p, k)} != {(p.doc, p.start + k) for p in false for k in range(p.n + 1)}
    for p in substring.verified(keyed, moved, 20).collect():
        own = texts[p.doc][p.start : p.start + p.n + 19]
        assert any(own == texts[q.source][p.start - q.start + q.source_start + 1 :][: len(own)] for q in false if q.doc == p.doc)


def test_colliding_hashes_remove_no_word_that_is_not_repeated(spark, monkeypatch):
    rows = corpus(8)
    few = lambda key, check, *place: substring_earlier(key % np.uint64(64), check * np.uint64(0), *place)
    substring_earlier = substring.earlier
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(substring)  # tasks get the module as it is patched here
    monkeypatch.setattr(substring, "earlier", few)
    try:
        got = {(r.doc_id, r.n_words): r.n_removed for r in substring.dedup(docs, chunk_words=900).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(substring)
    want = {(r[0], r[1]): r[2] for r in plain(rows)}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in want)
