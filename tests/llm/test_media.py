import hashlib
import io
import tarfile
import zlib

from tenderspark.llm import media
from tenderspark.llm.shared import file_system

TEXTS = ["", "a", "é" * 288, "é" * 289, "word " * 50_000, None, "a"]


def test_png_round_trip():
    for t in TEXTS:
        payload = media.padded(t)
        assert len(payload) % 576 == 0 and len(payload) >= 576
        png = media.encode_png(payload)
        assert media.decode_png(png) == payload
        assert media.parse_header(png[:33]) == (576, len(payload) // 576, 8)


def test_table(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 2)], "doc_id long, text string, length int")
    index = media.store_media(docs)
    rows = {r.doc_id: r for r in media.read_media(media.read_headers(index)).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256, r.digest) == (r.length, r.digest, r.media_sha256)
        fs, path = file_system(r.shard)
        with fs.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
            assert media.decode_png(tar.extractfile(f"{r.digest}.png").read()) == payload
    assert rows[1].feature == rows[6].feature
    assert media.canonical(index).count() == 6
    table = media.media_table(docs.repartition(5))
    assert table.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    both = [r[1:] for r in table.where("doc_id IN (1, 6)").collect()]
    assert len(both) == 2 and both[0] == both[1]
    assert media.media_table(docs.limit(0)).count() == 0
