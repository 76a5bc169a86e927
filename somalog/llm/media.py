"""Media columns: content-addressed payloads in tar shards.

A payload (here a text's bytes, padded to whole rows of 64 samples) is stored as a PNG image of
8-bit gray samples under its SHA-256 in a tar shard in the shared folder. Rows carry
(digest, shard, offset, length). Reads go by range: the first 33 bytes of an image fill the
metadata columns (width, height, bit depth), the rest is only read where samples are needed.

Shards are written where the texts are read, without moving texts: a task keeps each digest once
in its shard, and the index keeps one place for each digest. A payload that n tasks see is
stored n times at most, once a shard, and always read from the one indexed place. A shard is
written under a name of its own and is part of the store only if its rows are in the index, so
a task that is lost or run twice leaves an unused file behind and no wrong row.

Defined results: a null text is stored as the empty text; repeated rows share one payload; an
empty table gives an empty result and no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somalog.llm.common import checkpoint_root, cut

ROW = 64
HEAD_BYTES = 33
#: A task starts another shard after so many bytes.
SHARD_BYTES = 256 << 20
PLACES = "digest string, shard string, offset long, length long"


def padded(text: bytes | None) -> bytes:
    """The payload: zero bytes up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def image(payload: bytes) -> bytes:
    """A PNG of 64 columns, one byte a pixel, without filtering."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 5)) + chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first 33 bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">IIB", head[16:25])


def samples(stored: bytes) -> bytes:
    """The payload of a stored image."""
    width, height, depth = header(stored)
    at, data = 8, b""
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            data += stored[at + 8 : at + 8 + size]
        at += size + 12
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width * depth // 8 + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """A difference hash: a bit a column, set if its samples sum to more than the next one's."""
    sums = np.frombuffer(payload, np.uint8).reshape(-1, ROW).sum(axis=0, dtype=np.int64)
    return np.packbits(sums > np.roll(sums, -1)).tobytes().hex()


class _Shard:
    def __init__(self, root: str) -> None:
        self.files, path = fs.FileSystem.from_uri(root)
        self.files.create_dir(path, recursive=True)
        self.path = f"{path}/{uuid.uuid4().hex}.tar"
        self.out = self.files.open_output_stream(self.path)
        self.size, self.known = 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest not in self.known:
            entry = tarfile.TarInfo(f"{digest}.png")
            entry.size = len(data)
            head = entry.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
            self.known[digest] = (self.size + len(head), len(data))
            self.size += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
        return self.known[digest]

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


def _stored(root: str, shard_bytes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or b""
                payload = padded(text)
                digest = hashlib.sha256(payload).hexdigest()
                if shard and shard.size > shard_bytes:
                    shard.close()
                    shard = None
                shard = shard or _Shard(root)
                place = shard.known.get(digest) or shard.add(digest, image(payload))
                rows.append((doc_id, len(text), digest, shard.path.rsplit("/", 1)[1], *place))
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if shard:
            shard.close()

    return run


def store(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """Store all payloads. Returns the rows (doc_id, n_bytes, digest), the index (digest, shard,
    offset, length) with one place for each digest, and the folder of the shards."""
    root = f"{checkpoint_root(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    rows = cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_stored(root, shard_bytes), "doc_id long, n_bytes long, " + PLACES))
    index = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    return rows.select("doc_id", "n_bytes", "digest"), index, root


def _by_shard(root: str, of, schema: pa.Schema):
    """Rows of the index to of(read, digest, length), where read(start, size) is a range of
    the stored bytes. Rows come sorted by shard, so a task opens each of its shards once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(root)
        name, source = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != name:
                    if source:
                        source.close()
                    name, source = shard, files.open_input_file(f"{path}/{shard}")
                rows.append(of(lambda start, size, source=source, offset=offset: source.read_at(size, offset + start), digest, length))
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if source:
            source.close()

    return run


def _placed(index: DataFrame) -> DataFrame:
    return index.repartition("shard", F.floor(F.col("offset") / (16 << 20))).sortWithinPartitions("shard", "offset")


def metadata(index: DataFrame, root: str) -> DataFrame:
    """(digest, width, height, depth): from headers alone."""
    schema = pa.schema([("digest", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("depth", pa.int64())])
    read = _by_shard(root, lambda read, digest, length: (digest, *header(read(0, HEAD_BYTES))), schema)
    return _placed(index).mapInArrow(read, "digest string, width long, height long, depth long")


def measured(index: DataFrame, root: str) -> DataFrame:
    """A row for each digest: what the stored bytes, read back, hold."""
    kinds = {"digest": "string", "width": "long", "height": "long", "depth": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    schema = pa.schema([(k, pa.int64() if v == "long" else pa.string()) for k, v in kinds.items()])

    def of(read, digest: str, length: int) -> tuple:
        head = read(0, HEAD_BYTES)
        size = header(head)
        stored = head + read(HEAD_BYTES, length - HEAD_BYTES)
        payload = samples(stored)
        return digest, *size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), length, hashlib.sha256(stored).hexdigest(), feature(payload)

    return _placed(index).mapInArrow(_by_shard(root, of, schema), ", ".join(f"{k} {v}" for k, v in kinds.items()))


def media_columns(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) and what is read back from there."""
    rows, index, root = store(docs, shard_bytes)
    index = cut(index)
    return rows.join(index.join(measured(index, root), "digest"), "digest")
