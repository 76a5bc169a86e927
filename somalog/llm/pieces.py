"""SentencePiece encoding and decoding by streaming Viterbi.

A text's best segmentation has the greatest sum of piece scores (of equal ones, each end is
reached by its longest piece). The search goes from left to right and keeps scores for one
piece length only; whenever the backpointers of all positions that a later piece could start at
pass through one boundary, the pieces up to there are final and leave as ids. In vocabularies
where no piece goes on with the word mark after another character, all paths converge at the end
of every word, so words can be searched by themselves and the ids of those that come again are
remembered (a bounded number). That is an exact shortcut: tests hold it against the stream over
whole texts.

The vocabulary file is read, never trained; its path is a parameter. Characters without a piece
are encoded as UTF-8 byte pieces, and so is the word mark itself where a text holds it, so
decoding gives every text back exactly. A vocabulary's scores are used as a unigram model's are,
whatever it was trained as; for a BPE vocabulary, whose scores are ranks, ids are the ones of
the best sum of ranks and not of the merge order.

Defined results: a null text has null ids, an empty text none; repeated rows are encoded alike;
an empty table gives an empty result; other columns pass, but for `ids` and `n_ids`.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somalog.llm.common import free

MARK, UNKNOWN_PENALTY = "▁", 10.0
REMEMBERED, LONG, CHECK_EVERY = 120_000, 48, 32
#: So many texts' ids leave a task at once.
ROWS = 500
_SEGMENTS = re.compile(r" *[^ ]+| +")


class Pieces:
    """A vocabulary: (piece, score, kind) in order of ids; kind is "piece", "byte" or "other"."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]) -> None:
        self.bytes = [0] * 256
        self.table: list[bytes] = []
        self.tails: dict[str, tuple[float, int] | None] = {}  # pieces, and ends of pieces
        self.tree: dict = {}  # by character; 0 holds a piece's score and id
        self.longest, lowest, self.closed = 1, 0.0, True
        for k, (piece, score, kind) in enumerate(vocabulary):
            plain = piece.replace(MARK, " ")
            self.table.append(bytes([int(piece[3:5], 16)]) if kind == "byte" else plain.encode() if kind == "piece" else b"")
            if kind == "byte":
                self.bytes[int(piece[3:5], 16)] = k
            elif kind == "piece":
                self.closed &= " " not in plain.lstrip(" ")
                self.longest, lowest = max(self.longest, len(plain)), min(lowest, score)
                for i in range(1, len(plain)):
                    self.tails.setdefault(plain[i:], None)
                self.tails[plain] = (score, k)
                node = self.tree
                for c in plain:
                    node = node.setdefault(c, {})
                node[0] = (score, k)
        self.unknown = lowest - UNKNOWN_PENALTY
        self.known: dict[str, array] = {}  # the latest words
        self.older: dict[str, array] = {}  # those before

    def _spelled(self, start: int, end: int, k: int, text: str) -> list[int]:
        return [k] if k >= 0 else [self.bytes[b] for b in text[start:end].encode()]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a stretch of text (spaces are word marks), in groups as they become final."""
        tails, longest = self.tails, self.longest
        best, back = {0: 0.0}, {}  # position: score, within reach; (start, id), not yet final
        done = 0
        for end in range(1, len(text) + 1):
            top, start, k = best[end - 1] + self.unknown, end - 1, -1
            for length in range(1, min(longest, end) + 1):
                hit = tails.get(text[end - length : end], 0)
                if hit == 0:
                    break
                if hit is not None and end - length in best:
                    value = best[end - length] + hit[0]
                    if value >= top:
                        top, start, k = value, end - length, hit[1]
            best[end], back[end] = top, (start, k)
            best.pop(end - longest, None)
            if end == len(text) or end % CHECK_EVERY == 0:
                agreed = end if end == len(text) else self._agreed(best, back, done)
                out, at = [], agreed
                while at > done:
                    out.append((at, *back[at]))
                    at = back[at][0]
                if out:
                    yield [x for at, start, k in reversed(out) for x in self._spelled(start, at, k, text)]
                    for at in range(done + 1, agreed + 1):
                        back.pop(at, None)
                    done = agreed

    @staticmethod
    def _agreed(best: dict, back: dict, done: int) -> int:
        """The last boundary that the paths to all positions within reach share."""
        live = sorted(best)
        at, path = live[0], {done}
        while at > done:
            path.add(at)
            at = back[at][0]
        shared = max(path)
        for at in live[1:]:
            while at not in path:
                at = back[at][0]
            shared = min(shared, at)
        return shared

    def _word(self, text: str) -> array:
        """The same for a stretch that is short enough to finish before anything is final."""
        root, unknown, n = self.tree, self.unknown, len(text)
        best, came, ids = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            base, node, end = best[start], root, start
            if base + unknown > best[start + 1]:
                best[start + 1], came[start + 1], ids[start + 1] = base + unknown, start, -1
            while end < n:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                hit = node.get(0)
                if hit is not None:
                    value = base + hit[0]
                    if value > best[end]:
                        best[end], came[end], ids[end] = value, start, hit[1]
        end, out = len(text), []
        while end:
            start, k = came[end], ids[end]
            if k < 0:
                out += reversed(self._spelled(start, end, k, text))
            else:
                out.append(k)
            end = start
        out.reverse()
        return array("i", out)

    def _segment(self, text: str) -> array:
        if len(text) <= LONG:
            return self._word(text)
        return array("i", [k for group in self.stream(text) for k in group])

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        out = array("i")
        for n, part in enumerate(text.split(MARK) if text else ()):
            if n:
                out.extend(self.bytes[b] for b in MARK.encode())
            part = part if n else f" {part}"
            known, older = self.known, self.older
            for segment in _SEGMENTS.findall(part) if self.closed else [part] if part else []:
                ids = known.get(segment)
                if ids is None:
                    ids = older.get(segment)
                    if ids is None:
                        ids = self._segment(segment)
                    if len(segment) <= LONG:
                        if len(known) >= REMEMBERED:
                            known, older = {}, known
                            self.known, self.older = known, older
                        known[segment] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        """The text that was encoded."""
        return b"".join(map(self.table.__getitem__, ids))[1:].decode()


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda k: "byte" if model.is_byte(k) else "other" if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) else "piece"
    return Pieces([(model.id_to_piece(k), model.get_score(k), kind(k)) for k in range(model.get_piece_size())])


def _encoded(path: str, source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids, sizes, exact = array("i"), [], []
            for text in batch.column(batch.schema.get_field_index(source)):
                text = text.as_py()
                if text is None:
                    sizes.append(None)
                    exact.append(None)
                    continue
                found = pieces.encode(text)
                sizes.append(len(found))
                exact.append(pieces.decode(found) == text)
                ids += found
            ends = np.cumsum([0, *(n or 0 for n in sizes)])
            offsets = pa.array(ends, pa.int32(), mask=np.array([*(n is None for n in sizes), False]))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            rest = batch.drop_columns([source])
            yield pa.RecordBatch.from_arrays([*rest.columns, lists, pa.array(sizes, pa.int64()), pa.array(exact, pa.bool_())], names=[*rest.schema.names, "ids", "n_ids", "exact"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs and ids array<int>, n_ids long, and exact, true if decoding the ids gave the text."""
    docs = docs.drop("ids", "n_ids", "exact")
    text = free(docs, "_text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids array<int>, n_ids long, exact boolean"])
    return docs.withColumn(text, F.col("text")).mapInArrow(_encoded(path, text), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with a column ids) and the text; null for null ids."""
    encoded = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "text string"]))
