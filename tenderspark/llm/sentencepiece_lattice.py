"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words that no piece crosses: before each space mark and, within such a run, between two characters
that stand side by side in no piece of the model. The distinct words of each input block are written down, the distinct
words of all blocks are exploded into their substrings of bounded length, the substrings meet the piece table in an
equi-join, the edges are grouped by word, and a fold with Spark's higher-order `aggregate` turns the lattice of a word
into its pieces: the best path (Viterbi) for unigram models, the model's own score-ordered merges for merge-type models,
over the same edges. Characters without a piece become byte pieces. Words longer than MAX_WORD characters, whose
lattices would grow without bound, take the same merges or the same path in a linked list inside the task that meets
them.

No text is shuffled. What is shuffled is the set of distinct words of each input block (a file split): once to fold each
word a single time for the whole table and join its pieces to the blocks that hold it, once to bring the words of a block
together again as a small dictionary, which is read by the tasks that scan that block again.

Defined results: a null or empty text has no ids; repeated rows give equal rows; U+2581 reads as a space; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.columns import let
from tenderspark.llm.shared import file_system, new_path, written

SPACE = "▁"
MAX_WORD = 32  # boundaries are bits of a long
_PLACES = 64
ROWS = 500  # texts held as ids at a time
SEEN = 500_000  # runs remembered by a task that lists the words of a block
_runs = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall


@dataclass(frozen=True)
class Pieces:
    """The model's tables; their size is the vocabulary's."""

    scores: dict[str, float]  # ordinary pieces only
    ids: dict[str, int]
    byte_ids: list[int]
    unknown: int
    merges: bool  # merge-type model, else unigram
    prefix: bool

    @functools.cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(class of each code point, table[class, class]: the two stand side by side in some piece)."""
        pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        codes = {c: i for i, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
        classes, table = np.zeros(0x110000, np.int32), np.zeros((len(codes) + 1, len(codes) + 1), bool)
        for c, i in codes.items():
            classes[ord(c)] = i
        for one, two in pairs:
            table[codes[one], codes[two]] = True
        return classes, table

    @functools.cached_property
    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all pieces, begin of each id, length of each id)."""
        known = self.text_of
        parts = [known.get(i, b"") for i in range(max(known, default=-1) + 1)]
        sizes = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes

    @functools.cached_property
    def text_of(self) -> dict[int, bytes]:
        out = {i: p.encode() for p, i in self.ids.items()}
        return out | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.scores))


def load_pieces(path: str | None = None) -> Pieces:
    """Read a model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind = model.trainer_spec.model_type
    normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
    if kind not in (1, 2) or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("only unigram and merge-type models without text normalisation are supported")
    byte_ids = [i for i, p in enumerate(model.pieces) if p.type == 6]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
    return Pieces({p: s for p, (_, s) in normal.items()}, {p: i for p, (i, _) in normal.items()}, byte_ids, unknown, kind == 2, model.normalizer_spec.add_dummy_prefix)


def runs(text: str | None, prefix: bool = True) -> list[str]:
    """A text cut before its runs of space marks."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " ":
        return _runs((SPACE if prefix else "") + text.replace(" ", SPACE))
    return ((SPACE if prefix else "") + text.replace(" ", f" {SPACE}")).split(" ")


def split_runs(found: list[str], pieces: Pieces) -> tuple[list[str], np.ndarray]:
    """(words of all runs, number of words of each run): cut where no piece has these two neighbours."""
    text = "".join(found)
    classes, table = pieces.neighbours
    kinds = classes[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    first = np.zeros(len(kinds), bool)
    first[1:] = ~table[kinds[:-1], kinds[1:]]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begins = np.cumsum(sizes) - sizes
    first[begins] = True
    at = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(at, begins), append=len(at))
    edges = [*at.tolist(), len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)], counts


def cut(text: str | None, pieces: Pieces) -> list[str]:
    """Words of a text; pieces never cross from one to the next."""
    found = runs(text, pieces.prefix)
    return split_runs(found, pieces)[0] if found else []


def merge_word(word: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a word by merging the best-scored neighbours first, leftmost among equals (linked list and heap)."""
    n = len(word)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []

    def push(i):
        j = end[i]
        if j < n and (s := scores.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (-s, i, j, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if end[i] != j or end[j] != e:
            continue
        end[i], end[j] = e, -1
        if e < n:
            back[e] = i
            push(i)
        if back[i] >= 0:
            push(back[i])
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


def best_path(word: str, scores: dict[str, float], longest: int) -> list[str]:
    """Pieces of a word with the highest sum of scores; a character without a piece costs UNKNOWN."""
    best: list[tuple] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        found = [(best[b][0] + s, -b) for b in range(max(0, e - longest), e) if (s := scores.get(word[b:e], UNKNOWN if e - b == 1 else None)) is not None]
        best.append(max(found))
    out, e = [], len(word)
    while e:
        out.append(word[-best[e][1] : e])
        e = -best[e][1]
    return out[::-1]


UNKNOWN = -1e6


def _edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """The columns of `words` and edges, one row a row of `words` (which are distinct): array<struct<loss, begin, end>>,
    or for merges, whose order is all that counts, array<long> of rank, begin and end in one number.

    The substrings meet the piece table by hash, and the pieces are compared, in a broadcast join: the table has the
    vocabulary's size, which load_pieces fixes. A word also sends the empty string, which meets a row of its own, so
    that words without edges stay. Where `words` is partitioned by some of its columns already, grouping the edges
    needs no further exchange.
    """
    rank = {s: i for i, s in enumerate(sorted(set(pieces.scores.values()), reverse=True))}
    rows = [(p, rank[s] if pieces.merges else -float(s)) for p, s in pieces.scores.items()]
    schema = "piece string, loss long" if pieces.merges else "piece string, loss double"
    table = words.sparkSession.createDataFrame([*rows, ("", type(rows[0][1])(0))], schema).select(F.xxhash64("piece").alias("h"), "piece", "loss")
    least = 2 if pieces.merges else 1  # merges need pairs only
    keys, b, k = words.columns, F.col("b"), F.col("k")
    tails = words.select(*keys, F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.length("word") - least))).alias("b"))
    tails = tails.select(*keys, "b", F.when(b >= 0, F.substring("word", b + 1, F.lit(pieces.longest))).otherwise("").alias("tail"))
    sizes = F.when(b >= 0, F.sequence(F.lit(least), F.length("tail"))).otherwise(F.array(F.lit(0)))
    subs = tails.select(*keys, "b", "tail", F.explode(sizes).alias("k")).select(*keys, "b", "k", F.substring("tail", F.lit(1), k).alias("sub"))
    # equal strings, written so that the hash alone is the join's key: a row that meets none costs one probe
    same = F.startswith("sub", "piece") & (F.length("sub") <= F.length("piece"))
    met = subs.withColumn("h", F.xxhash64("sub")).join(F.broadcast(table), "h").where(same)
    edge = (F.col("loss") * _PLACES + b) * _PLACES + b + k if pieces.merges else F.struct("loss", b.alias("begin"), (b + k).alias("end"))
    return met.groupBy(*keys).agg(F.collect_list(F.when(b >= 0, edge)).alias("edges"))


def _merged(edges, n):
    """Fold: boundaries 0..n, bits of a number, lose at each step the one inside the best-scored edge that spans two
    neighbours, the leftmost of equals."""
    one = F.lit(1).cast("long")

    def bit(place):
        return F.call_function("shiftleft", one, place)

    def masks(edge):
        begin, end = F.pmod(F.call_function("div", edge, F.lit(_PLACES)), F.lit(_PLACES)).cast("int"), F.pmod(edge, F.lit(_PLACES)).cast("int")
        return F.struct((bit(begin) + bit(end)).alias("ends"), (bit(end) - bit(begin + 1)).alias("inside"))

    def step(bounds, edges):
        fits = F.filter(edges, lambda e: (bounds.bitwiseAND(e.ends) == e.ends) & (F.bit_count(bounds.bitwiseAND(e.inside)) == 1))
        return F.coalesce(bounds.bitwiseAND(F.bitwise_not(F.get(fits, F.lit(0)).inside)), bounds)

    def fold(ordered):
        steps = F.least(F.size(ordered), n - 1)  # each merge takes an edge and a boundary
        return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), bit(n + 1) - 1, lambda bounds, _: step(bounds, ordered))).otherwise(bit(n + 1) - 1)

    bits = let(F.transform(F.sort_array(edges), masks), fold)
    return let(bits, lambda x: F.filter(F.sequence(F.lit(0), n), lambda i: x.bitwiseAND(bit(i)) != 0))


def _viterbi(edges, n):
    """Fold: for each end the least (loss, begin) over the edges that end there, then the way back from the end."""

    def way(best, loss, begin):
        return F.struct((F.get(best, begin).loss + loss).alias("loss"), begin.alias("begin"))

    def reach(best, end):
        found = F.transform(F.filter(edges, lambda e: e.end == end), lambda e: way(best, e.loss, e.begin))
        return F.concat(best, F.array(F.array_min(F.concat(found, F.array(way(best, F.lit(-UNKNOWN), end - 1))))))

    start = F.array(F.struct(F.lit(0.0).alias("loss"), F.lit(0).alias("begin")))
    walk = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(F.aggregate(F.sequence(F.lit(1), n), start, reach).alias("best"), F.array(n).alias("bounds")),
        lambda a, _: F.struct(a.best.alias("best"), F.when(F.get(a.bounds, F.lit(0)) > 0, F.concat(F.array(F.get(a.best, F.get(a.bounds, F.lit(0))).begin), a.bounds)).otherwise(a.bounds).alias("bounds")),
    )
    return walk.bounds


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """Columns with `word` (distinct rows, at most MAX_WORD characters) -> the same and bounds: where pieces begin and end."""
    n = F.length("word")
    bounds = let(F.col("edges"), lambda edges: _merged(edges, n) if pieces.merges else _viterbi(edges, n))
    return _edges(words, pieces).select(*words.columns, bounds.alias("bounds"))


def _scanned(docs: DataFrame) -> DataFrame:
    """`docs` with `_block`, a number of the file split that a row is read from. What is not a plain scan is written
    to the shared folder first."""
    where = [F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_block")]
    try:
        return docs.select("*", *where)
    except AnalysisException:
        return written(docs, "scan").select("*", *where)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None], pa.RecordBatch]]:
    """(block, texts, rows) of up to ROWS rows of one block."""
    blocks = batch.column("_block").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for low, high in zip(edges, edges[1:], strict=False):
        for at in range(low, high, ROWS):
            rows = batch.slice(at, min(ROWS, high - at))
            yield int(blocks[at]), rows.column("text").to_pylist(), rows


def _block_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(_block, word): words of each block of 2 to MAX_WORD characters, hardly ever twice."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        block, seen, listed = None, set(), set()
        for here, texts, _ in (x for b in batches for x in _slices(b)):
            if here != block or len(seen) > SEEN:
                block, seen, listed = here, set(), set()
            fresh = set(chain.from_iterable(runs(t, own.prefix) for t in texts)).difference(seen)
            if not fresh:
                continue
            seen |= fresh
            words = {w for w in split_runs(list(fresh), own)[0] if 2 <= len(w) <= MAX_WORD} - listed
            listed |= words
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block), pa.int64()), pa.array(list(words), pa.string())], ["_block", "word"])

    return docs.select("_block", "text").mapInArrow(run, "_block long, word string")


def dictionaries(docs: DataFrame, pieces: Pieces) -> str:
    """Write the pieces of the words of each block, as words cut by spaces; the folder they are in.

    A word is folded once for the whole table. Its pieces are joined to the blocks that hold it (a common word has a
    short row for each block, no more), and the rows of a block, which its texts bound, meet in one task.
    """
    spark = docs.sparkSession
    n, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, "sentencepiece")
    found = written(_block_words(docs, pieces), "words")

    def pieces_of(bounds):
        ends = F.slice(bounds, 2, F.size(bounds) - 1)
        return F.array_join(F.transform(ends, lambda e, i: F.substring(F.col("word"), F.get(bounds, i) + 1, e - F.get(bounds, i))), " ")

    words = found.select("word").repartition(n, "word").distinct()
    cuts = let(F.col("bounds"), pieces_of)  # the fold runs once a word
    known = encode_words(words, pieces).select("word", cuts.alias("cuts"))
    placed = found.join(known, "word").select("_block", "cuts").repartition(n, "_block")
    placed.write.partitionBy("_block").parquet(folder)
    return folder


def encode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id, text -> doc_id, ids array<int>."""

    def ids(doc_ids: pa.Array, offsets: np.ndarray, values: np.ndarray, _: Pieces) -> list[pa.Array]:
        return [doc_ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))]

    return _encoded(docs, pieces, ids, "doc_id long, ids array<int>")


def encode_summary(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id, text -> doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), text_sha256 (of the ids' decoded text),
    in the task that encodes, so that ids are not passed on."""

    def digest(doc_ids: pa.Array, offsets: np.ndarray, values: np.ndarray, own: Pieces) -> list[pa.Array]:
        edges = offsets.tolist()
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in decode_many(values, offsets, own)]
        return [doc_ids, pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64()), pa.array(texts, pa.string())]

    return _encoded(docs, pieces, digest, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string")


def _encoded(docs: DataFrame, pieces: Pieces | None, emit: Callable, schema: str) -> DataFrame:
    """emit(doc_ids, offsets, values, pieces) makes the columns of `schema` from the ids of some documents."""
    pieces = pieces or load_pieces()
    base = _scanned(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    folder = dictionaries(base, pieces)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bytes_of = _PieceBytes(own)
        block, lookup, known = None, None, {}
        for here, texts, rows in (x for b in batches for x in _slices(b)):
            if here != block:
                lookup, known = None, {}  # let the old ones go first
                block, lookup = here, WordIds(_load(f"{folder}/_block={here}", bytes_of), own, bytes_of)
            found = [runs(t, own.prefix) for t in texts]
            if fresh := list(set(chain.from_iterable(found)).difference(known)):
                known.update(zip(fresh, lookup.of_runs(fresh), strict=True))
            out = [b"".join(map(known.__getitem__, words)) for words in found]
            offsets = np.cumsum([0, *map(len, out)]) // 4
            values = np.frombuffer(b"".join(out), "<i4")
            yield pa.RecordBatch.from_arrays(emit(rows.column("doc_id"), offsets, values, own), names)

    return base.select("doc_id", "text", "_block").mapInArrow(run, schema)


class _PieceBytes(dict):
    """Ids of a piece as bytes, remembered for each piece met."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = np.array(piece_ids([piece], self.pieces), "<i4").tobytes()
        return found


class WordIds:
    """Ids of runs as bytes, by a dictionary of words that grows with the single characters and long words met."""

    def __init__(self, known: dict[str, bytes], pieces: Pieces, bytes_of: _PieceBytes):
        self.known, self.pieces, self.bytes_of = known, pieces, bytes_of

    def of_runs(self, found: list[str]) -> list[bytes]:
        words, counts = split_runs(found, self.pieces)
        for w in set(words).difference(self.known):
            if 1 < len(w) <= MAX_WORD:
                raise KeyError(f"the dictionary does not hold {w!r}")
            parts = _long_word(w, self.pieces) if len(w) > 1 else w
            self.known[w] = b"".join(map(self.bytes_of.__getitem__, parts))
        ids = list(map(self.known.__getitem__, words))
        edges = [0, *np.cumsum(counts).tolist()]
        return [ids[a] if b == a + 1 else b"".join(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _load(folder: str, bytes_of: _PieceBytes) -> dict[str, bytes]:
    """word -> ids as bytes, of the words in a folder."""
    from pyarrow import fs

    files, path = file_system(folder)
    out: dict[str, bytes] = {}
    for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if not info.path.endswith(".parquet"):
            continue
        with files.open_input_file(info.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(50_000, columns=["cuts"]):
                cuts = batch.column(0)
                words = pc.replace_substring(cuts, " ", "").to_pylist()
                last = np.cumsum(pc.count_substring(cuts, " ").to_numpy(zero_copy_only=False) + 1)
                ids = list(map(bytes_of.__getitem__, " ".join(cuts.to_pylist()).split(" ")))
                ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[last - 1].tolist()
                data = b"".join(ids)
                out.update((w, data[a:b]) for w, a, b in zip(words, [0, *ends], ends, strict=False))
    return out


def _long_word(word: str, pieces: Pieces) -> list[str]:
    return merge_word(word, pieces.scores) if pieces.merges else best_path(word, pieces.scores, pieces.longest)


def piece_ids(parts: list[str], pieces: Pieces) -> list[int]:
    out: list[int] = []
    for p in parts:
        i = pieces.ids.get(p)
        if i is not None:
            out.append(i)
        elif pieces.byte_ids:
            out += [pieces.byte_ids[b] for b in p.encode("utf-8")]
        else:
            out.append(pieces.unknown)
    return out


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    known = pieces.text_of
    text = b"".join([known.get(i, b"") for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if pieces.prefix and text.startswith(" ") else text


def decode_many(values: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> list[str]:
    """decode_ids of values[offsets[i] : offsets[i + 1]] for each i; ids must be those of the model."""
    data, begins, sizes = pieces.stored
    size = sizes[values]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(begins[values] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    at = ends[offsets].tolist()
    texts = [flat[a:b].decode("utf-8", "replace").replace(SPACE, " ") for a, b in zip(at, at[1:], strict=False)]
    return [t[1:] if pieces.prefix and t.startswith(" ") else t for t in texts]


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces or load_pieces())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids or [], shared.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

