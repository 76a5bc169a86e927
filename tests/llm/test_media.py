import hashlib
import io
import tarfile
import zlib
from pathlib import Path

from pyarrow import fs

from somalog.llm import media

TEXTS = [None, "", "a", "x" * 64, "x" * 65, "é" * 500, "long " * 40_000, "a", "same", "same", "same"]


def test_image_round_trip():
    for text in TEXTS:
        payload = media.padded(None if text is None else text.encode())
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == (text or "").encode()
        stored = media.image(payload)
        assert media.samples(stored) == payload
        assert media.header(stored[:33]) == (64, len(payload) // 64, 8)


def docs(spark):
    rows = [(i, t, "clash", 5) for i, t in enumerate(TEXTS)] + [(2, "a", "clash", 5), (None, "same", "clash", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, offset int").repartition(3), rows


def test_values_are_read_back(spark):
    table, rows = docs(spark)
    for size in (1, 1 << 30):
        got = media.media_columns(table, shard_bytes=size).collect()
        assert len(got) == len(rows)
        texts = {i: (t or "").encode() for i, t, *_ in rows}
        for r in got:
            payload = media.padded(texts[r.doc_id])
            stored = media.image(payload)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
            assert (r.width, r.height, r.depth, r.feature) == (64, len(payload) // 64, 8, media.feature(payload))
        assert len({(r.shard, r.offset) for r in got}) == len({r.digest for r in got}) == 7


def test_shards_are_tar_files(spark):
    table, _ = docs(spark)
    _, index, root = media.store(table)
    files, path = fs.FileSystem.from_uri(root)
    shards = {x.base_name: Path(x.path).read_bytes() for x in files.get_file_info(fs.FileSelector(path))}
    for r in index.collect():
        with tarfile.open(fileobj=io.BytesIO(shards[r.shard])) as tar:
            found = [m for m in tar.getmembers() if m.name == f"{r.digest}.png"]
            assert [(m.offset_data, m.size) for m in found] == [(r.offset, r.length)]
            assert hashlib.sha256(media.samples(tar.extractfile(found[0]).read())).hexdigest() == r.digest
    heads = {r.digest: r.height for r in media.metadata(index, root).collect()}
    assert len(heads) == index.count() and min(heads.values()) == 1


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
