"""Media columns: content-addressed payloads in tar shards.

`store_media` turns every payload into an 8-bit greyscale PNG of fixed width, names it by the SHA-256 of the stored
bytes and appends it to the tar shard of its task. The rows that come back carry only digest, shard, offset and length.
`read_headers` fills metadata columns from a range read of the first 33 bytes of each object, `read_media` reads whole
objects back and computes features. All three are narrow: no payload is ever shuffled, a shard holds a digest once, and
`canonical` picks one location per digest across shards when a single address is wanted.

Defined results: a null text is the empty text; the empty text is padded to one row of 576 samples; repeated rows share
one stored object and give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.shared import file_system, new_path

WIDTH = 576
PAD = b"\xff"
SHARD_BYTES = 256 << 20
STRETCH_BYTES = 16 << 20
HEADER_BYTES = 33
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX_SCHEMA = "doc_id long, digest string, shard string, offset long, length long"
HEADER_SCHEMA = INDEX_SCHEMA + ", width int, height int, bit_depth int"
MEDIA_SCHEMA = (
    HEADER_SCHEMA + ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of the text, filled with 255 to a positive multiple of WIDTH (255 never occurs in UTF-8)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + PAD * (WIDTH * max(1, -(-len(data) // WIDTH)) - len(data))


def encode_png(payload: bytes) -> bytes:
    """Lossless 8-bit greyscale PNG, WIDTH samples a row, filter type 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    out = io.BytesIO()
    out.write(PNG_SIGNATURE)
    for kind, body in (
        (b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)),
        (b"IDAT", zlib.compress(lines, 1)),
        (b"IEND", b""),
    ):
        out.write(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
    return out.getvalue()


def parse_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER_BYTES of a PNG."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    """Samples of a PNG written by encode_png; chunk checksums are verified."""
    width, height, _ = parse_header(data[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


class _TarShards:
    """Appends members to tar files of about SHARD_BYTES. A retried task writes files of new names, so rows of the
    attempt that is committed always point at complete shards."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.folder, self.out = folder, None
        self.fs.create_dir(self.path, recursive=True)

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.name}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        place = f"{self.folder}/{self.name}", self.at + len(head), len(data)
        self.at += len(head) + len(data) + (-len(data) % 512)
        return place

    def full(self) -> bool:
        return self.out is not None and self.at >= SHARD_BYTES

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, digest, shard, offset, length; the index is a written table."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _TarShards(f"{folder}/shards"), {}
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    payload = padded(text.as_py())
                    key = hashlib.sha256(payload).digest()
                    if key not in seen:
                        media = encode_png(payload)
                        digest = hashlib.sha256(media).hexdigest()
                        seen[key] = (digest, *shards.add(f"{digest}.png", media))
                    rows.append((doc_id, *seen[key]))
                    if shards.full():
                        shards.close()
                        seen.clear()
                yield _batch(rows, INDEX_COLUMNS)
        finally:
            shards.close()

    index = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def canonical(index: DataFrame) -> DataFrame:
    """digest -> its first location over all shards (one row a digest)."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


INDEX_COLUMNS = [("doc_id", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
HEADER_COLUMNS = [("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32())]
FEATURE_COLUMNS = [
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
]


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(p, t) for p, (_, t) in zip(parts, columns, strict=True)], [n for n, _ in columns])


def _ranges(rows: list[tuple], size) -> Iterator[tuple[tuple, bytes]]:
    """Each row with `size(row)` bytes from its place; a shard is opened once for a run of rows."""
    shard, handle = None, None
    for row in rows:
        if row[2] != shard:
            if handle:
                handle.close()
            fs, path = file_system(row[2])
            shard, handle = row[2], fs.open_input_file(path)
        yield row, handle.read_at(size(row), row[3])
    if handle:
        handle.close()


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def read_headers(index: DataFrame) -> DataFrame:
    """Metadata columns from header-only range reads. The index is small beside the media, so its own files say nothing
    about the work: its rows are dealt by stretches of shards first."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = index.repartition(n, "shard", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("shard", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, tuple] = {}
            out = []
            for row, head in _ranges(_rows(batch), lambda _: HEADER_BYTES):
                known.setdefault(row[2:4], parse_header(head))
                out.append((*row, *known[row[2:4]]))
            yield _batch(out, INDEX_COLUMNS + HEADER_COLUMNS)

    return index.mapInArrow(read, HEADER_SCHEMA)


def features(media: bytes) -> tuple:
    """Feature columns of one stored object."""
    payload = decode_png(media)
    data = payload.rstrip(PAD)
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256)
    p = share[share > 0] / len(samples)
    feature = f"mean={samples.mean():.4f};distinct={len(p)};entropy={-(p * np.log2(p)).sum() + 0.0:.4f}"
    return (
        len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
        hashlib.sha256(media).hexdigest(), feature,
    )


def read_media(headers: DataFrame) -> DataFrame:
    """Whole objects by range read, with features computed from the bytes that were stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, tuple] = {}
            rows = sorted(_rows(batch), key=lambda r: r[2:4])
            fresh = {r[2:4]: r for r in rows}
            for row, media in _ranges(list(fresh.values()), lambda r: r[4]):
                known[row[2:4]] = features(media)
                if known[row[2:4]][5] != row[1]:
                    raise ValueError(f"{row[2]} at {row[3]} does not hold {row[1]}")
            yield _batch([(*r, *known[r[2:4]]) for r in rows], INDEX_COLUMNS + HEADER_COLUMNS + FEATURE_COLUMNS)

    return headers.mapInArrow(read, MEDIA_SCHEMA)


def media_table(docs: DataFrame) -> DataFrame:
    """Store, index, fill metadata and read back, for every document: the columns that its text alone decides, so that
    equal texts have equal rows. `store_media` has the places."""
    found = read_media(read_headers(store_media(docs)))
    return found.select("doc_id", *(name for name, _ in FEATURE_COLUMNS), "digest", *(name for name, _ in HEADER_COLUMNS))
