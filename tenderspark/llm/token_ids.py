"""Token ids in raw binary shards, with a minimal perfect hash from document keys to places.

A shard is two files: `<name>.ids`, the little-endian ids of its documents one after another and nothing else, and
`<name>.idx`, a perfect hash of the document keys with, for each slot, a fingerprint, the offset and the id count. A
lookup hashes the key, compares the fingerprint and reads one range. Shards follow ascending doc_id: documents are
range-partitioned by doc_id and, where a doc_id repeats, by the beginning of the text, and sorted within a partition,
which spills to disk and never meets in one task. `manifest` tells the first and last key of each shard.

Texts are split as the byte-level vocabulary splits them, and each distinct part is encoded once by the tokenizers
library; ids of a text are those of its parts (test: equal to encoding whole texts). Added tokens of the vocabulary are
recognised as the library does: a text that holds one is encoded whole.

Defined results: a null text is empty and holds only the end id; repeated rows of one doc_id each get their own ids,
in the order of their text, and share the key of the first of their shard; a null doc_id sorts first and has no key; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderspark.llm.perfect_hash import PerfectHash, fingerprints
from tenderspark.llm.shared import file_system, new_path

END_ID = 2
#: Fixed by the vocabulary: how byte-level texts are cut before merging.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with the classes of the standard library, which agree on most characters and are cut faster.
PLAIN_PARTS = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
CACHE = 600_000  # distinct parts remembered by a task at a time
BATCH_BYTES = 4 << 20
SHARD_DOCS_SCHEMA = "shard string, pos int, doc_id long, n_tokens long, shard_start long, has_key boolean"


class PartEncoder:
    """Raw ids of whole texts, encoding each distinct part once and keeping its ids as bytes."""

    def __init__(self, tokenizer_json: str, kind: str = "<u4"):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind = Tokenizer.from_str(tokenizer_json), kind
        self.added = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"] if t["content"]]
        self.cut, self.cut_plain = regex.compile(PARTS).findall, re.compile(PLAIN_PARTS).findall
        self.kinds = [regex.compile(c) for c in (r"\p{L}", r"\p{N}", r"\s")], [re.compile(c) for c in (r"[^\W\d_]", r"\d", r"\s")]
        self.plain: set[str] = set()  # characters that both patterns put into the same class
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before; parts that are met again move on

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        whole = [any(a in text for a in self.added) for text in texts]
        cuts = [[] if w else self.cut_plain(t) if self._is_plain(t) else self.cut(t) for t, w in zip(texts, whole, strict=True)]
        if new := set(chain.from_iterable(cuts)).difference(known):
            fresh = new.difference(older)
            known.update((p, older[p]) for p in new - fresh)
            self._learn(list(fresh))
        return [self._encode_whole(t) if w else b"".join(map(known.__getitem__, parts)) for t, w, parts in zip(texts, whole, cuts, strict=True)]

    def _encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _is_plain(self, text: str) -> bool:
        new = set(text).difference(self.plain)
        agree = {c for c in new if [bool(k.match(c)) for k in self.kinds[0]] == [bool(k.match(c)) for k in self.kinds[1]]}
        self.plain |= agree
        return len(agree) == len(new)

    def _learn(self, fresh: list[str]) -> None:
        """Encode parts. Those of a space and letters are encoded in one string, which the library cuts before each
        space just as it did in the text; its word numbers tell the parts apart."""
        size = np.dtype(self.kind).itemsize
        plain = [p for p in fresh if p[0] == " " and p[1:].isalpha()]
        rest = [p for p in fresh if not (p[0] == " " and p[1:].isalpha())] if len(plain) < len(fresh) else []
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            joined = self.tokenizer.encode("".join(some), add_special_tokens=False)
            ends = ((np.flatnonzero(np.diff(np.array(joined.word_ids))) + 1) * size).tolist()
            if len(ends) + 1 == len(some):
                data = np.array(joined.ids, self.kind).tobytes()
                self.known.update((p, data[a:b]) for p, a, b in zip(some, [0, *ends], [*ends, len(data)], strict=True))
            else:
                rest += some
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, self.kind).tobytes()


@functools.cache
def encoder_of(vocabulary: str, kind: str) -> PartEncoder:
    """One encoder a process: tasks that reuse a Python worker find the parts of earlier tasks."""
    return PartEncoder(vocabulary, kind)


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file, read on the driver (a fixed vocabulary of about 1.6 MB); executors get its text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def id_type(vocabulary: str) -> str:
    """Two bytes where all ids fit, else four."""
    model = json.loads(vocabulary)
    most = max([END_ID, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def _index_bytes(keys: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> bytes:
    perfect = PerfectHash.build(keys)
    slot = perfect.slots(keys)
    table = np.zeros(len(keys), [("fingerprint", "<u4"), ("offset", "<i8"), ("count", "<i8")])
    table["fingerprint"][slot], table["offset"][slot], table["count"][slot] = fingerprints(keys.view(np.uint64)), offsets, counts
    out = io.BytesIO()
    np.savez(out, table=table, perfect=np.frombuffer(perfect.dump(), np.uint8))
    return out.getvalue()


def write_ids(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, partitions: int | None = None) -> DataFrame:
    """doc_id, text -> one row a document (shard, pos, doc_id, n_tokens, shard_start, has_key), a written table.

    pos is the place in the shard, shard_start the number of ids of the shard before it, has_key true for the row that
    the perfect hash holds: the first of its doc_id. Shard names begin with the
    number of their range, so their order is that of doc_id.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    vocabulary = vocabulary or tokenizer_json()
    kind = id_type(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = file_system(folder)
        fs.create_dir(f"{path}/shards", recursive=True)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        encoder, at, pos = encoder_of(vocabulary, kind), 0, 0
        size, end = np.dtype(kind).itemsize, np.array([END_ID], kind).tobytes()
        keys: list[tuple[int, int, int]] = []
        last = None
        with fs.open_output_stream(f"{path}/shards/{name}.ids") as out:
            for batch in batches:
                for low, high in _slices(batch):
                    part = batch.slice(low, high - low)
                    rows = []
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                        n = len(ids) // size + 1
                        out.write(ids)
                        out.write(end)
                        has_key = doc_id is not None and doc_id != last
                        rows.append((pos, doc_id, n, at, has_key))
                        if has_key:
                            keys.append((doc_id, at, n))
                            last = doc_id
                        at, pos = at + n, pos + 1
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), pa.array(c[0], pa.int32()), *(pa.array(x, pa.int64()) for x in c[1:4]), pa.array(c[4], pa.bool_())], ["shard", "pos", "doc_id", "n_tokens", "shard_start", "has_key"]
                    )
        table = np.array(keys, np.int64).reshape(-1, 3)
        with fs.open_output_stream(f"{path}/shards/{name}.idx") as out:
            out.write(_index_bytes(np.ascontiguousarray(table[:, 0]), table[:, 1], table[:, 2]))

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = dealt.repartitionByRange(n, "doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(write, SHARD_DOCS_SCHEMA).write.parquet(f"{folder}/documents")
    return spark.read.schema(SHARD_DOCS_SCHEMA).parquet(f"{folder}/documents").withColumn("folder", F.lit(folder)).withColumn("kind", F.lit(kind))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BATCH_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes) - sizes) // BATCH_BYTES
    edges = np.flatnonzero(np.diff(block)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True) if len(sizes) else ()


class ShardReader:
    """Keyed and positional access to one shard."""

    def __init__(self, folder: str, name: str, kind: str):
        fs, path = file_system(folder)
        self.kind, self.size = kind, np.dtype(kind).itemsize
        with fs.open_input_file(f"{path}/shards/{name}.idx") as f:
            z = np.load(io.BytesIO(f.read()))
        self.perfect, self.table = PerfectHash.load(z["perfect"].tobytes()), z["table"]
        self.file = fs.open_input_file(f"{path}/shards/{name}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, count) of each key; -1 where the fingerprint says that the key is not here."""
        slot = self.perfect.slots(keys)
        if not len(self.table):
            return np.full(len(keys), -1), np.full(len(keys), -1)
        row = self.table[np.maximum(slot, 0)]
        ok = (slot >= 0) & (row["fingerprint"] == fingerprints(keys.astype(np.int64).view(np.uint64)))
        return np.where(ok, row["offset"], -1), np.where(ok, row["count"], -1)

    def ids(self, offset: int, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(count * self.size, offset * self.size), self.kind)


def read_ids(written: DataFrame) -> DataFrame:
    """Rows of write_ids -> doc_id, start, n_tokens, ids_crc32, keyed: from the shards' bytes.

    Documents with a key are read at the offset and count that the perfect hash returns, repeats at their own place.
    start adds the totals of earlier shards (one number a shard). keyed tells that the perfect hash leads to the
    document's own place; it is false for rows that repeat a doc_id and null without one.
    """
    totals = written.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select(F.col("shard").alias("of"), F.coalesce(before, F.lit(0)).alias("base"))  # as many rows as shards
    placed = written.join(base, F.col("shard") == F.col("of")).select("folder", "kind", "shard", "doc_id", "n_tokens", "shard_start", "has_key", "base")
    # The table is small beside the ids, so its own files say nothing about the work: a task a shard, as when writing.
    placed = placed.repartition(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("shard")).sortWithinPartitions("shard", "shard_start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] != name:
                    name, reader = row[2], ShardReader(row[0], row[2], row[1])
                if rows and rows[-1][0] is not reader:
                    yield _crc(rows)
                    rows = []
                rows.append((reader, *row[3:]))
            if rows:
                yield _crc(rows)

    def _crc(rows: list[tuple]) -> pa.RecordBatch:
        reader = rows[0][0]
        offsets, counts = reader.find(np.array([r[1] or 0 for r in rows], np.int64))
        out = []
        for (_, doc_id, n, at, has_key, base), o, c in zip(rows, offsets.tolist(), counts.tolist(), strict=True):
            if has_key and o < 0:
                raise ValueError(f"the perfect hash does not hold document {doc_id}")
            place = o if has_key else at
            ids = reader.ids(place, c if has_key else n)
            out.append((doc_id, base + place, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), None if doc_id is None else (o, c) == (at, n)))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.bool_())], ["doc_id", "start", "n_tokens", "ids_crc32", "keyed"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, keyed boolean")


def manifest(written: DataFrame) -> DataFrame:
    """Rows of write_ids -> shard, first, last: the keys of each shard (one row a shard)."""
    return written.where("has_key").groupBy("shard").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def lookup(folder: str, shards: list[tuple[str, int, int]], kind: str, key: int) -> np.ndarray | None:
    """ids of one document by key: a hash, a fingerprint and one range read in the shard whose keys span it. `shards`
    are the rows of `manifest`."""
    for name, first, last in shards:
        if not first <= key <= last:
            continue
        reader = ShardReader(folder, name, kind)
        offsets, counts = reader.find(np.array([key], np.int64))
        if offsets[0] >= 0:
            return reader.ids(int(offsets[0]), int(counts[0]))
    return None
