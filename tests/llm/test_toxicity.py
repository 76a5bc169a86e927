import random

from somalog.llm import toxicity

BAD = ["stupid", "idiot", "worthless", "scum"]


def tables(spark, n=600):
    rng = random.Random(11)
    syllables = ["an", "re", "the", "ing", "ti", "on", "ou", "st", "ed", "ha", "lo", "mi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(20, 120))], i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(n, None, "x"), (n + 1, "", "x"), (None, "scum " * 9, "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_accuracy(spark):
    docs, labels, truth = tables(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.withColumn("held", toxicity.held_out(docs["doc_id"])), model).collect()
    held = [(r.score >= 0.7, truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    assert len(held) > 150
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.95
    assert sum(p and not y for p, y in held) <= 2
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(truth) + 4
    assert [r.score >= 0.7 for r in got if r.doc_id is None] == [True]
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1 and max(empty) < 0.3
    again = toxicity.score(docs, toxicity.train(docs.repartition(5), labels.repartition(3))).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = tables(spark, 300)
    flipped = labels.withColumn("toxic", labels["toxic"])
    flipped = flipped.where(~toxicity.held_out(flipped["doc_id"]))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert one == two


def test_without_labels_or_rows(spark):
    docs, labels, _ = tables(spark, 12)
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), None).count() == 0


def test_coded_words():
    assert toxicity.coded(b"") == b"" and toxicity.coded(b"ab") == b"\x01a\x02b"
    assert toxicity.coded(b"abcdefghij").endswith(b"\x08hij")


def plain_score(model, text):
    import math

    import zstandard

    def compressor(content):
        params = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, strategy=zstandard.STRATEGY_LAZY, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

    words = (text or "").lower().encode().split()
    numbered = lambda w: b"".join(bytes([i + 1, c]) for i, c in enumerate(w[:8])) + w[8:]
    windows = [model.marker + b"".join(map(numbered, words[i : i + model.window])) for i in range(0, len(words), model.window)]
    gains = sorted((len(compressor(model.ordinary).compress(w)) - len(compressor(model.toxic).compress(w)) for w in windows), reverse=True)
    gains = [g for g in gains if g > 4]
    x = [*[*gains, 0, 0][:2], math.log1p(sum(gains)), math.log1p(sum(g > 6 for g in gains)), math.log1p(len(words) // model.window), 1]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_scores_against_plain_compression(spark):
    docs, labels, _ = tables(spark, 200)
    docs = docs.unionByName(spark.createDataFrame([(900, "word idiot " * 5000, "x"), (901, "ß " * 9 + "sc", "x")], docs.schema))
    model = toxicity.train(docs, labels)
    assert len(model.toxic) == len(model.ordinary) and model.toxic != model.ordinary
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - plain_score(model, r.text)) < 1e-9


def plain_counts(texts):
    """The counts that the dictionaries are made of, of (text, toxic)."""
    import math
    from collections import Counter

    size = Counter(y for _, y in texts)
    stems = {y: Counter(g for t, label in texts if label == y for g in {w[:n] for w in t.lower().split() for n in range(4, 9) if n <= len(w)}) for y in (0, 1)}
    share, telling = size[1] / len(texts), set()
    for g, p in stems[1].items():
        q = stems[0][g]
        odds = math.log((p + 0.5) / (size[1] + 1)) - math.log((q + 0.5) / (size[0] + 1))
        surprise = 2 * (p * math.log(p / ((p + q) * share)) + (q * math.log(q / ((p + q) * (1 - share))) if q else 0))
        if p >= max(3, 0.005 * size[1]) and odds > 2.5 and surprise > 30:
            telling.add(g)
    found = Counter()
    for t, y in texts:
        if y:
            found.update(max(own, key=len) for w in t.lower().split() if (own := [w[:n] for n in range(4, 9) if n <= len(w) and w[:n] in telling]))
    return found, Counter(w for t, y in texts if not y for w in t.lower().split())


def test_what_is_trained(spark):
    """Dictionaries of all texts, and of all but a fold, are made of plain counts over those texts."""
    docs, labels, truth = tables(spark, 240)
    rows = [(r.text.encode(), truth[r.doc_id], r.doc_id % 3) for r in docs.collect() if r.doc_id in truth and r.text]
    learned = spark.createDataFrame([(bytearray(t), y, f) for t, y, f in rows], "text binary, toxic int, fold int")
    got = toxicity._dictionaries(learned, range(3))
    assert set(got) == {None, 0, 1, 2}
    for fold, trained in got.items():
        counts = plain_counts([(t, y) for t, y, f in rows if f != fold])
        assert counts[0] and any(b"idio" in g for g in counts[0])
        assert trained == toxicity._from_counts(*map(dict, counts))
    assert toxicity._dictionaries(learned.where("toxic = 1"), range(3)) == {}


def test_copies_in_the_sample_do_not_depend_on_order(spark):
    docs, labels, _ = tables(spark, 200)
    copies = docs.where("doc_id % 3 = 0").selectExpr("doc_id + 7000 AS doc_id", "concat(text, ' more') AS text", "score")
    both = docs.unionByName(copies)
    more = labels.unionByName(labels.where("doc_id % 3 = 0").selectExpr("doc_id + 7000 AS doc_id", "quality", "toxic"))
    assert toxicity.train(both, more) == toxicity.train(both.orderBy("text").repartition(7), more.repartition(2))
