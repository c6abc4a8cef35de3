"""Web archives: WARC records in ZIP packages, read by range without extraction.

Each task writes one package: a ZIP whose members are stored, not compressed again. `archive/data.warc.gz` holds one
gzip member a record, `indexes/index.cdx` a line a record with its range. The reader parses the ZIP's end record, its
ZIP64 locator and record and the central directory, finds the two members and range-reads the records.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a response, the
others revisits that carry no payload.

Defined results: a null html is empty; a record without page_id is always a response; repeated rows of the smallest
page_id of a group are all responses; smaller payloads are all responses; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.shared import file_system, new_path

MIN_REVISIT = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2000-01-01T00:00:00Z"  # the tables carry no crawl time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGE_BYTES = 256 << 20
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RESULT_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the payload's length, but not the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def parse_record(data: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    refers = _number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, refers, payload


class Package:
    """Writes one ZIP of stored members."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, data: bytes) -> None:
        packed = gzip.compress(data, 1, mtime=0)
        self.data.write(packed)
        self.lines.append(f"{'-' if page_id is None else page_id} {self.at} {len(packed)}")
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("\n".join(self.lines).encode())
        self.zip.close()


def directory(read_at, size: int) -> dict[str, tuple[int, int, int]]:
    """Member name -> (method, stored size, offset of its local header), from the central directory.

    read_at(n, offset) returns n bytes. ZIP64 records are used where the plain fields are saturated.
    """
    tail = min(size, 22 + 65_535)
    end = read_at(tail, size - tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no ZIP end record")
    entries, length, start = struct.unpack_from("<HII", end, at + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read_at(20, size - tail + at - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        big = read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, start = struct.unpack_from("<QQQ", big, 32)
    central, at, out = read_at(length, start), 0, {}
    for _ in range(entries):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", central, at + 10)[0]
        packed, plain = struct.unpack_from("<II", central, at + 20)
        names, extras, comments = struct.unpack_from("<HHH", central, at + 28)
        offset = struct.unpack_from("<I", central, at + 42)[0]
        name = central[at + 46 : at + 46 + names].decode()
        extra, end_extra = at + 46 + names, at + 46 + names + extras
        while extra + 4 <= end_extra:
            tag, n = struct.unpack_from("<HH", central, extra)
            if tag == 1:  # 64-bit values of the saturated fields, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", central, extra + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            extra += 4 + n
        out[name] = method, packed, offset
        at = end_extra + comments
    return out


def member_start(read_at, members: dict, name: str) -> tuple[int, int]:
    """(offset of the first byte, size) of a stored member."""
    method, size, offset = members[name]
    if method != 0:
        raise ValueError(f"{name} is compressed")
    head = read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return offset + 30 + names + extras, size


def read_package(read_at, size: int) -> Iterator[tuple]:
    """All records of a package in the order of its index, each by its own range."""
    members = directory(read_at, size)
    index_at, index_size = member_start(read_at, members, INDEX)
    data_at, data_size = member_start(read_at, members, DATA)
    for line in read_at(index_size, index_at).decode().splitlines():
        _, offset, length = line.split(" ")
        if int(offset) + int(length) > data_size:
            raise ValueError("the index points behind its archive")
        yield parse_record(gzip.decompress(read_at(int(length), data_at + int(offset))))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat the payload of a smaller page_id."""
    payload = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(f"n >= {MIN_REVISIT}")
    first = base.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    return base.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, url, html -> the packages written (archive, records), a written table."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    plain = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    dealt = plain.join(revisits(pages), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(f"{path}/packages", recursive=True)
        package, done = None, []

        def close():
            package.close()
            out.close()
            done.append((name, len(package.lines)))

        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    name = f"{folder}/packages/{uuid.uuid4().hex}.wacz"
                    out = file_system(name)[0].open_output_stream(file_system(name)[1])
                    package = Package(out)
                package.add(page_id, record(page_id, url, (html or "").encode(), refers))
                if package.at >= PACKAGE_BYTES:
                    close()
                    package = None
        if package is not None:
            close()
        if done:
            names, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], ["archive", "records"])

    dealt.mapInArrow(write, "archive string, records long").write.parquet(f"{folder}/index")
    return spark.read.schema("archive string, records long").parquet(f"{folder}/index")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """archive -> one row a record, read from the packages alone. Packages are bounded, so each is one unit of work."""
    columns = RECORD_SCHEMA if payloads else RESULT_SCHEMA
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    picked = list(range(7)) if payloads else [0, 2, 3, 4, 5]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = file_system(name)
                with fs.open_input_file(path) as f:
                    rows = []
                    for row in read_package(f.read_at, f.size()):
                        rows.append(tuple(row[k] for k in picked))
                        if len(rows) == 500:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), picked, strict=True)], [names[k] for k in picked])

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n, "archive").mapInArrow(read, columns)
