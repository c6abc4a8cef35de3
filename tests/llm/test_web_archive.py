import hashlib
import io
import struct
import zipfile

import pytest

from tenderspark.llm import web_archive as wa

PAGES = [(5, "http://a/\r\nX: y é", "x" * 100), (3, None, "x" * 100), (9, "u", "é" * 50), (4, "u", "é" * 50), (1, "u", "x" * 99), (2, "u", "x" * 99), (6, "u", None), (7, "u", ""), (8, "u", "line\r\n\r\n" * 40_000), (None, "u", "x" * 100), (3, None, "x" * 100)]


def test_table(spark):
    df = spark.createDataFrame([(*p, 1, 2) for p in PAGES], "page_id long, url string, html string, digest int, refers_to int")
    archives = wa.write_archives(df)
    rows = wa.read_archives(archives).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    expected = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        ref = first.get(h) if i is not None and h in first and i != first[h] else None
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if ref is None else "revisit", ref))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str) == sorted(expected, key=str)
    assert {r.page_id: bytes(r.payload) for r in rows if r.record_type == "response"}[8] == ("line\r\n\r\n" * 40_000).encode()
    assert wa.read_archives(wa.write_archives(df.limit(0))).count() == 0
    assert wa.read_archives(archives, payloads=False).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def package(rows):
    out = io.BytesIO()
    p = wa.Package(out)
    for i, url, html in rows:
        p.add(i, wa.record(i, url, (html or "").encode(), None))
    p.close()
    return out.getvalue()


def reader(data):
    return lambda n, at: data[at : at + n]


def test_any_zip_tool_reads_the_packages():
    data = package(PAGES)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == [wa.DATA, wa.INDEX]
    assert [r[0] for r in wa.read_package(reader(data), len(data))] == [p[0] for p in PAGES]


def test_zip64_directory():
    """The same package with all directory fields saturated and the values in ZIP64 records."""
    data = package(PAGES[:3])
    end = data.rfind(b"PK\x05\x06")
    entries, length, start = struct.unpack_from("<HII", data, end + 10)
    central, at, wide = data[start : start + length], 0, b""
    for _ in range(entries):
        packed, plain = struct.unpack_from("<II", central, at + 20)
        names, extras, comments = struct.unpack_from("<HHH", central, at + 28)
        offset = struct.unpack_from("<I", central, at + 42)[0]
        extra = struct.pack("<HHQQQ", 1, 24, plain, packed, offset)
        head = bytearray(central[at : at + 46])
        struct.pack_into("<II", head, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<HHH", head, 28, names, len(extra), 0)
        struct.pack_into("<I", head, 42, 0xFFFFFFFF)
        wide += bytes(head) + central[at + 46 : at + 46 + names] + extra
        at += 46 + names + extras + comments
    big = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, len(wide), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(wide), 1)
    data = data[:start] + wide + big + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert [r[0] for r in wa.read_package(reader(data), len(data))] == [5, 3, 9]


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        wa.directory(reader(b"x" * 100), 100)
