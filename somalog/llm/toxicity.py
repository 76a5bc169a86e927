"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled documents, one on ordinary text and one on
toxic text. A text is cut into windows of `window` words, each is compressed with either
dictionary, and the difference in length is the evidence that the window gives. A logistic
function of a document's strongest windows gives the score. It is calibrated on labelled documents
by cross-fitting: those of each fold are judged by dictionaries trained on the other folds.

Toxic documents are ordinary but for a few words, and zstandard's trainer picks what is frequent,
not what differs. Trained on all words of either kind the dictionaries don't tell them apart.
So the trainer gets, of the toxic documents, the beginnings of their words that toxic documents
have far more often than ordinary ones, as often as they hold them, and of the ordinary documents
all words. The toxic dictionary stands behind the ordinary one's content, and
the ordinary one is filled up to the same length, so whatever is ordinary is found by both at the
same distance. Every window starts with a marker that both dictionaries hold, which keeps
zstandard from storing short windows raw.

Words of fewer than four bytes can't tell (STEMS are the lengths of beginnings), and of longer ones
only the beginning does. The dictionaries are fitted on bounded counts: the STEMS_KEPT most frequent
telling beginnings, and the WORDS most frequent words of ordinary text.

Labels are learned from a sample of at most `per_class` documents of each class, taken by hash of
doc_id from the rows that are not held out. A text and its near copies in the sample count once
(of copies, the text of least hash). Everything is scored, whole texts.

Defined results: null and empty texts have no evidence and get the score of that; a document
without doc_id is scored and not held out; repeated rows are scored alike; without labels of
both classes all scores are 0; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.llm.common import cut, free

PER_CLASS, STEMS, WINDOW, BASE_BYTES = 4000, range(4, 9), 8, 16_000
#: At most so many telling beginnings, and so many of the most frequent words of either kind, are learned.
STEMS_KEPT, WORDS, FOLDS = 2000, 20_000, 5
#: A telling stem is in this share of toxic documents at least, its log odds are higher by ODDS,
#: and its likelihood ratio statistic rules out chance among some 100,000 stems.
RARE, ODDS, SURPRISE = 0.005, 2.5, 30.0
#: Bytes of the toxic dictionary for each byte of different beginnings, at least so many, and the
#: length of the runs that its trainer picks.
OWN_SHARE, OWN_LEAST, OWN_RUN = 2, 1024, 48
#: So many bytes of a word are numbered, with these.
DEPTH, PLACES = 8, bytes(range(1, 9))
FEATURES = 5
CACHED = 50_000


#: Odd factors that give independent orders of shingle hashes.
_ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _least_shingles(texts: pd.Series) -> pd.Series:
    """For each order, the least hash of a text's shingles of five words."""

    def of(text: bytes) -> list[int]:
        words = _words(text)
        hashes = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
        return [int((hashes * np.uint64(f) ^ (hashes >> np.uint64(29))).min().view(np.int64)) for f in _ORDERS]

    return texts.map(of)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    marker: bytes
    weights: tuple[float, ...]
    window: int


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _stems(word: bytes) -> list[bytes]:
    """A word's beginnings, of bounded length."""
    return [word[:n] for n in STEMS if n <= len(word)]


def coded(word: bytes) -> bytes:
    """A word with its leading bytes numbered, so that what matches there is a beginning."""
    n = min(len(word), DEPTH)
    out = bytearray(2 * n)
    out[::2], out[1::2] = PLACES[:n], word[:n]
    return bytes(out) + word[n:]


def _beginnings(text: bytes, telling: frozenset[bytes]) -> list[bytes]:
    """The longest telling beginnings of a text's words that have one."""
    return [max(found, key=len) for w in _words(text) if (found := [s for s in _stems(w) if s in telling])]


def _samples(counts: dict[bytes, int], least: int, most: int, rng: random.Random) -> list[bytes]:
    """Coded words as samples for the trainer: one for each `least` times a word occurs, `most` at most."""
    out = [coded(word) for word in sorted(counts) for _ in range(min(1 + counts[word] // least, most))]
    rng.shuffle(out)
    return out


def _counted(texts: DataFrame, of, variants: Sequence[int | None]) -> DataFrame:
    """(item, variant, toxic, ordinary): in how many of each label's texts, or how often, of(text,
    variant) yields an item. A variant leaves out the texts of its fold, None (written -1) no text. Where
    of doesn't depend on the variant, texts are read once and a fold is taken from the whole."""
    names = {v: -1 if v is None else v for v in variants}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, fold), part in batch.groupby(["toxic", "fold"]):
                found: dict[int, Counter] = {}
                for text in part["text"]:
                    for variant, items in of(text):
                        if variant is None or variant != fold:
                            found.setdefault(names.get(variant, -1), Counter()).update(items)
                for variant, counts in found.items():
                    yield pd.DataFrame({"item": list(counts), "variant": variant, "fold": fold, "toxic": label, "n": list(counts.values())})

    of_label = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    return texts.mapInPandas(run, "item binary, variant int, fold int, toxic int, n long").groupBy("item", "variant", "fold").agg(of_label(1).alias("toxic"), of_label(0).alias("ordinary"))


def _without_folds(counts: DataFrame, folds: Sequence[int]) -> DataFrame:
    """(item, variant, toxic, ordinary) of all folds (-1), and of all but each, from counts by fold."""
    whole = counts.groupBy("item").agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary")), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("toxic", "ordinary")))).alias("of"))
    left = lambda v: F.struct(F.lit(v).alias("variant"), *((F.col(c) - F.coalesce(F.try_element_at("of", F.lit(v))[c], F.lit(0))).alias(c) for c in ("toxic", "ordinary")))
    return whole.select("item", F.inline(F.array(*map(left, (-1, *folds)))))


def _trained(samples: list[bytes], size: int, k: int = 24) -> bytes:
    """Dictionary content that zstandard picks from the samples, without its entropy tables."""
    try:
        whole = zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[-size:]
    repeats = b"".join(x.to_bytes(4, "little") for x in (1, 4, 8))  # they end the tables
    return whole[whole.find(repeats) + len(repeats) :] if repeats in whole else whole


class _Evidence:
    def __init__(self, toxic: bytes, ordinary: bytes, marker: bytes, window: int) -> None:
        self.marker, self.window, self.seen = marker, window, {}
        self.by = [self._compressor(x) for x in (ordinary, toxic)]

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, strategy=zstandard.STRATEGY_LAZY, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress

    def features(self, text: bytes | None) -> list[float]:
        """Bytes that the toxic dictionary saves: in the best window, in the next best, and in
        all; the windows where it saves more than a chance match does; and all windows."""
        words, k, seen = _words(text), self.window, self.seen
        if len(seen) > CACHED:
            seen.clear()
        ordinary, toxic = self.by
        best = next_best = total = strong = 0
        for i in range(0, len(words), k):
            part = self.marker + b"".join([seen.get(w) or seen.setdefault(w, coded(w)) for w in words[i : i + k]])
            gain = len(ordinary(part)) - len(toxic(part))
            if gain > 4:
                total += gain
                strong += gain > 6
                if gain > best:
                    best, next_best = gain, best
                elif gain > next_best:
                    next_best = gain
        return [best, next_best, math.log1p(total), math.log1p(strong), math.log1p(len(words) // k)]


def _fitted(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, ...]:
    """Logistic weights, intercept last; `prior` corrects its odds for the sampling."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.3] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    w[-1] += prior
    return tuple(float(v) for v in w)


def _sampled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, fold) of the sample without near copies, and the labels' numbers."""
    known = cut(labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # 2 x per_class rows at most
    first = lambda *keys: F.min_by(F.struct(*keys), F.struct(F.xxhash64("text"), F.sha2("text", 256))).alias("first")
    texts = texts.groupBy("doc_id").agg(first("text", "toxic")).select("first.*").withColumn("least", _least_shingles("text"))
    texts = cut(texts)
    for k in range(len(_ORDERS)):  # a group of copies would decide by itself what is telling
        texts = texts.groupBy(F.col("least")[k].alias("_k"), "toxic").agg(first("text", "least")).select("toxic", "first.*")
    return cut(texts.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))), n


def _dictionaries(learned: DataFrame, folds: Sequence[int] = ()) -> dict[int | None, tuple[bytes, bytes, bytes]]:
    """The toxic and the ordinary dictionary, and the marker: of all texts (None), and for each of
    folds of the others. Without texts of both classes there are none. Each count is one pass over
    the texts, of all variants."""
    sizes = {(r.toxic, r.fold): r.n for r in learned.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = {v: [sum(n for (c, f), n in sizes.items() if c == label and f != v) for label in (0, 1)] for v in (-1, *folds)}
    usable = [v for v, n in size.items() if all(n)]
    if not usable:
        return {}
    stems = cut(_without_folds(_counted(learned, lambda text: [(None, {g for w in set(_words(text)) for g in _stems(w)})], [None]), folds))
    telling = {}
    for v in usable:
        p, q, (n0, n1) = F.col("toxic").cast("double"), F.col("ordinary").cast("double"), size[v]
        share = n1 / (n0 + n1)
        odds = F.log((p + 0.5) / (n1 + 1)) - F.log((q + 0.5) / (n0 + 1))
        surprise = 2 * (p * F.log(p / ((p + q) * share)) + F.when(q > 0, q * F.log(q / ((p + q) * (1 - share)))).otherwise(0.0))
        chosen = stems.where(F.col("variant") == v).where((p >= max(3.0, RARE * n1)) & (odds > ODDS)).where(surprise > SURPRISE)
        telling[v] = frozenset(bytes(r.item) for r in chosen.orderBy(F.desc("toxic"), "item").limit(STEMS_KEPT).collect())

    beginnings = cut(_counted(learned.where("toxic = 1"), lambda text: [(v, _beginnings(text, known)) for v, known in telling.items()], usable).groupBy("item", "variant").agg(F.sum("toxic").alias("n")))
    words = cut(_without_folds(_counted(learned.where("toxic = 0"), lambda text: [(None, _words(text))], [None]), folds))
    most = lambda rows, v, c: {bytes(r.item): r.n for r in rows.where((F.col("variant") == v) & (F.col(c) > 0)).orderBy(F.desc(c), "item").limit(WORDS).select("item", F.col(c).alias("n")).collect()}
    return {None if v == -1 else v: _from_counts(most(beginnings, v, "n"), most(words, v, "ordinary")) for v in usable}


def _from_counts(of_toxic: dict[bytes, int], of_ordinary: dict[bytes, int]) -> tuple[bytes, bytes, bytes]:
    """The dictionaries of counted beginnings and words, and their marker."""
    rng = random.Random(8)
    base = _trained(_samples(of_ordinary, 50, 30, rng), BASE_BYTES)
    own = _trained(_samples(of_toxic, 1, 30, rng), max(OWN_LEAST, OWN_SHARE * sum(len(coded(w)) for w in of_toxic)), OWN_RUN)
    marker, filler = (bytes(rng.randrange(128, 192) for _ in range(k)) for k in (48, len(own)))
    return base + own + marker, base + filler + marker, marker


def _judged(texts: DataFrame, dictionaries: tuple[bytes, bytes, bytes], window: int) -> DataFrame:
    """(f0, f1, ..., toxic) of texts (text, toxic)."""
    columns = [f"f{k}" for k in range(FEATURES)]

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _Evidence(*dictionaries, window)
        for batch in batches:
            yield pd.DataFrame([judge.features(t) for t in batch["text"]], columns=columns, dtype=float).assign(toxic=batch["toxic"].to_numpy())

    return texts.mapInPandas(evidence, ", ".join(f"{c} double" for c in columns) + ", toxic int")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, window: int = WINDOW) -> Model | None:
    """A model from the labelled documents that are not held out; None without both classes."""
    texts, n = _sampled(docs, labels, per_class)
    trained = _dictionaries(texts, range(FOLDS))
    if None not in trained:
        return None
    rows = None
    for fold in (v for v in trained if v is not None):  # judged by what no text of the fold went into
        judged = _judged(texts.where(F.col("fold") == fold), trained[fold], window)
        rows = rows.union(judged) if rows else judged
    if rows is None:
        return None
    rows = rows.orderBy(*rows.columns).toPandas()  # 2 x per_class rows at most
    y = rows.pop("toxic").to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    prior = math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(*trained[None], _fitted(rows.to_numpy(float), y, prior), window)


def _scores(model: Model | None, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Evidence(model.toxic, model.ordinary, model.marker, model.window) if model else None
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = np.zeros(batch.num_rows)
            if judge:
                x = np.array([judge.features(t.as_py()) for t in batch.column(at)], float).reshape(-1, FEATURES)
                out = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights[:-1]) + model.weights[-1], -30, 30)))
            batch = batch.remove_column(at)
            yield batch.append_column("score", pa.array(out))

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs and a column score between 0 and 1; the text is read, and nothing else."""
    docs = docs.drop("score")
    text = free(docs, "_bytes")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])
    return docs.withColumn(text, F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(_scores(model, text), schema)
