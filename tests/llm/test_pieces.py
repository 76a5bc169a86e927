import random

import public_tokenizers
import pytest

from somalog.llm import pieces
from somalog.llm.queries import vocabulary_path

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a ", "Hello world", "line\n\tnext", "漢字😀é", "a▁b ▁", "▁", "x" * 3000, "ab" * 2000 + " end", " " * 300, "été naïve Straße", "\x00\x7f"]


def library():
    """The library's own unigram search over the same vocabulary."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def best(vocabulary, text):
    """Score of the best segmentation, tried in full."""
    if not text:
        return 0
    scores = {p: s for p, s, kind in vocabulary if kind == "piece"}
    floor = min(scores.values()) - 10
    table = [0.0]
    for end in range(1, len(text) + 1):
        table.append(max([table[s] + scores[text[s:end]] for s in range(end) if text[s:end] in scores] or [table[end - 1] + floor]))
    return table[-1]


def test_every_text_comes_back():
    model = pieces.load(PATH)
    for text in TEXTS:
        assert model.decode(model.encode(text)) == text


def test_same_ids_as_the_library():
    model, other, rng = pieces.load(PATH), library(), random.Random(5)
    letters = "aaeeiinnrrssttoulldhmc   é,.\n"
    for n in [1, 5, 40, 300] * 10:
        text = "".join(rng.choice(letters) for _ in range(n)).replace("\n", ";")
        got, want = model.encode(text).tolist(), other.encode(text)
        score = lambda ids: sum(map(other.get_score, ids))
        assert got == want or (n == 300 and score(got) >= score(want))  # the library sums in single precision


@pytest.mark.parametrize("closed", [True, False])
def test_streaming_finds_the_best_sum(closed):
    rng = random.Random(6)
    for _ in range(60):
        vocabulary = [("".join(rng.choice("ab▁") for _ in range(rng.randint(1, 6))), -rng.random() * 9, "piece") for _ in range(25)]
        vocabulary = list({p: (p, s, k) for p, s, k in vocabulary}.values()) + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
        if closed:
            vocabulary = [v for v in vocabulary if v[2] == "byte" or "▁" not in v[0].lstrip("▁")]
        model = pieces.Pieces(vocabulary)
        model.closed &= closed
        text = "".join(rng.choice("aab ") for _ in range(rng.randint(1, 400)))
        ids = model.encode(text).tolist()
        assert model.decode(ids) == text
        floor = min((s for _, s, k in vocabulary if k == "piece"), default=0) - 10
        got = sum(vocabulary[k][1] if vocabulary[k][2] == "piece" else floor for k in ids)
        bytes_of_mark = sum(1 for k in ids if vocabulary[k][2] == "byte")
        assert bytes_of_mark == 0 or got <= 0
        if bytes_of_mark == 0:
            assert abs(got - best(vocabulary, ("▁" + text.replace(" ", "▁")))) < 1e-6


def test_ids_leave_before_the_end():
    model = pieces.load(PATH)
    groups = list(model.stream(" the" * 500))
    assert len(groups) > 20 and [k for g in groups for k in g] == model._segment(" the" * 500).tolist()


def test_table(spark):
    rows = [(i, t, "old", 1.5) for i, t in enumerate([*TEXTS, None, "Hello world"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, other double")
    encoded = pieces.encode(docs, PATH)
    model = pieces.load(PATH)
    for r in encoded.collect():
        assert r.text == rows[r.doc_id][1] and r.other == 1.5
        if r.text is None:
            assert r.ids is None and r.n_ids is None
        else:
            assert r.exact and r.ids == model.encode(r.text).tolist() and r.n_ids == len(r.ids)
    assert {r.doc_id: r.text for r in pieces.decode(encoded.drop("text"), PATH).collect()} == {r[0]: r[1] for r in rows}
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_words_by_themselves_against_the_stream_over_whole_texts(spark):
    model = pieces.load(vocabulary_path())
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        if pieces.MARK not in text:
            assert model.encode(text).tolist() == [k for group in model.stream(f" {text}" if text else "") for k in group]
    docs = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, _text long")
    assert pieces.encode(docs, vocabulary_path()).first()._text == 2
