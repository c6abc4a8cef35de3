"""Near-duplicate components by circulant MinHash.

Two permutations of D slots make all coordinates (Li and Li, 2022): the first scatters a text's shingles over the
slots, the second, shifted circularly by k, gives coordinate k as the least value over the text's slots. ROWS
coordinates make a band; texts that share a band meet in a bucket. A pair of similarity 0.8 misses all BANDS bands with
probability (1 - 0.8**ROWS)**BANDS, under 1e-4 at the defaults.

Links are confirmed on full shingle sets (64-bit hashes of the shingles). Only components are wanted, so a bucket is
not expanded into its pairs: equal sets collapse to one representative first, each bucket is compared with two pivots,
and only members that are still in different components of a bucket are compared further, in blocks.

Hot groups: copies find the first of their set by way of the first of a place, and the pairs of a pivot meet its text in
parts, so neither brings a group into one task. Buckets meet their pivots as ids only, in a join of two written tables,
which adaptive execution splits where one bucket is large.

Defined results: a null or blank text has an empty set, is linked with nothing and is kept; repeated rows of a document
are one node of the graph and give one row each; rows without doc_id are returned with no component and kept; an empty
table gives an empty table; ties fall to the smallest doc_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.components import connected_components, merged
from tenderspark.llm.shared import unused, written
from tenderspark.llm.shingles import mix, shingle_sets

SLOTS = 1 << 20
ROWS, BANDS = 7, 40
SEED = 20
BLOCK, BLOCK_BYTES = 256, 8 << 20  # members and text of a residual block
PLACES = 1024  # rows of one key are dealt over so many places
PAIRS = 2_000  # pairs of one pivot that meet its text in a task
_CHUNK = 1 << 13  # shingles worked on at once


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """(first, second followed by its own beginning, so that a shift is a slice)."""
    rng = np.random.default_rng(SEED)
    first, second = rng.permutation(SLOTS).astype(np.int32), rng.permutation(SLOTS).astype(np.int32)
    return first, np.concatenate([second, second[: ROWS * BANDS]])


def signatures(hashes: np.ndarray, counts: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """int32[texts, ROWS * BANDS]; every count must be positive."""
    first, second = tables
    slots = first[(hashes >> np.uint64(44)).astype(np.int64)]
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), ROWS * BANDS), np.int32)
    at = 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + _CHUNK)))
        begin, end = starts[at], starts[stop - 1] + counts[stop - 1]
        part, cuts = slots[begin:end], starts[at:stop] - begin
        for k in range(ROWS * BANDS):
            out[at:stop, k] = np.minimum.reduceat(second[k : k + SLOTS][part], cuts)
        at = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """int64[texts, BANDS]: a hash of each band that also tells its number."""
    bands = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bands.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ bands[:, :, r])
    return key.view(np.int64)


def as_bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, key_a, key_b (a 128-bit sum over the set), bands."""
    schema = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = permutations()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes, counts = shingle_sets(as_bytes(part.column(1).to_pylist()), width)
                full = np.flatnonzero(counts)
                keys = np.zeros((2, len(counts)), np.int64)
                bands = np.zeros((len(full), BANDS), np.int64)
                if len(full):
                    cuts = (np.cumsum(counts) - counts)[full]
                    for k, salt in enumerate((0x51ED270B, 0xB5026F5A)):
                        keys[k, full] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), cuts).view(np.int64)
                    bands = band_keys(signatures(hashes, counts[full], tables))
                offsets = np.concatenate([[0], np.cumsum((counts > 0) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))],
                    ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) -> the pairs whose full shingle sets are similar enough. texts: node, body. An `a` may have very many
    pairs, a `b` has few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                left, right = as_bytes(part.column(2).to_pylist()), as_bytes(part.column(3).to_pylist())
                unique = {t: k for k, t in enumerate(dict.fromkeys(left + right))}
                hashes, counts = shingle_sets(list(unique), width)
                sets = np.split(hashes, np.cumsum(counts)[:-1])
                keep = [similar(sets[unique[x]], sets[unique[y]], percent) for x, y in zip(left, right, strict=True)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    placed = pairs.withColumn("place", F.pmod(F.xxhash64("b"), F.lit(PLACES)))
    counts = placed.groupBy("a", "place").agg(F.count("*").alias("n"))
    total = counts.groupBy("a").agg(F.sum("n").alias("n"))
    parts = counts.select("a", "place").join(total, "a").select("a", "place", F.pmod("place", F.ceil(F.col("n") / PAIRS)).alias("part"))
    dealt = written(placed.join(parts, ["a", "place"]).select("a", "b", "part"), "pairs")
    left = dealt.select("a", "part").distinct().join(texts.selectExpr("node a", "body left_body"), "a")
    right = dealt.join(texts.selectExpr("node b", "body right_body"), "b")
    both = right.join(left, ["a", "part"]).select("a", "b", "left_body", "right_body")
    return both.mapInArrow(run, "a long, b long")


def _block_links(pdf: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """Links of the different components of one or two blocks whose members are linked, as a forest."""
    pdf = pdf.drop_duplicates(["member", "body"])  # a doc_id may stand for several texts
    bodies = as_bytes(pdf["body"].tolist())
    hashes, counts = shingle_sets(bodies, width)
    owner = np.repeat(np.arange(len(bodies)), counts)
    _, column, often = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(bodies), len(bodies)), np.float32)  # products of incidence matrices, exact below 2**24
    step = 4096
    for low in range(0, int(column.max()) + 1 if len(column) else 0, step):
        inside = (column >= low) & (column < low + step)
        m = np.zeros((len(bodies), step), np.float32)
        m[owner[inside], column[inside] - low] = 1
        common += m @ m.T
    union = counts[:, None] + counts[None, :] - common.astype(np.int64)
    linked = 100 * common.astype(np.int64) >= percent * union
    head = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
    nodes, out = pdf["component"].to_numpy(), []
    for i, j in zip(*np.nonzero(np.triu(linked & (head[:, None] != head[None, :]), 1)), strict=True):
        if head[i] != head[j]:
            out.append((nodes[i], nodes[j]))
            head[head == head[j]] = head[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _residual_links(rest: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of components, by members of a bucket of `rest` (bucket, member, component) that are linked.

    The largest component of a bucket is its core, the other members are strays. Both are dealt into blocks of about
    BLOCK members and BLOCK_BYTES of text. Blocks of strays meet each other and those of the core; blocks of the core do not meet each other,
    for their members are linked already. So a core member is sent as often as there are blocks of strays.
    """
    weights = texts.groupBy(F.col("node").alias("member")).agg(F.sum(F.octet_length("body")).alias("bytes"))
    sizes = rest.join(weights, "member").groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    core = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "bytes")).alias("core"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks_of(n, size):
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")

    p, q = blocks_of(F.col("core.n"), F.col("core.bytes")), blocks_of(F.col("n") - F.col("core.n"), F.col("bytes") - F.col("core.bytes"))
    blocks = core.select("bucket", F.col("core.component").alias("core"), p.alias("p"), q.alias("q"))
    placed = rest.join(blocks, "bucket").withColumn("in_core", F.col("component") == F.col("core"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("member"), F.when(F.col("in_core"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    p, q, own = F.col("p"), F.col("q"), F.col("own")

    def meeting(low, high):
        return F.struct(low.alias("low"), high.alias("high"))

    with_strays = F.transform(F.sequence(F.lit(0), q - 1), lambda o: meeting(o, q + own))
    with_all = F.transform(F.sequence(F.lit(0), q + p - 1), lambda o: meeting(F.least(own, o), F.greatest(own, o)))
    meets = placed.select("bucket", "member", "component", F.explode(F.when(F.col("in_core"), with_strays).otherwise(with_all)).alias("m"))
    bodies = meets.select("bucket", "member", "component", "m.low", "m.high").join(texts.selectExpr("node member", "body"), "member")
    return bodies.groupBy("bucket", "low", "high").applyInPandas(lambda pdf: _block_links(pdf, width, percent), "a long, b long").distinct()


def _copies(full: DataFrame) -> DataFrame:
    """(a, b): documents of equal sets, each linked to the first of its place and that to the first of all."""
    placed = full.select("key_a", "key_b", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place"), "doc_id")
    firsts = placed.groupBy("key_a", "key_b", "place").agg(F.min("doc_id").alias("near"), F.count("*").alias("n"))
    groups = firsts.groupBy("key_a", "key_b").agg(F.min("near").alias("a"), F.sum("n").alias("all")).where("all > 1")
    up = firsts.join(groups, ["key_a", "key_b"]).select("a", F.col("near").alias("b"))
    down = placed.join(firsts.where("n > 1"), ["key_a", "key_b", "place"]).select(F.col("near").alias("a"), F.col("doc_id").alias("b"))
    return up.union(down).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, kept, one row an input row."""
    rows = written(sketch(docs, width), "sketch")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = full.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    members = sets.select(F.col("first.doc_id").alias("member"), F.explode("first.bands").alias("bucket")).distinct()
    members = written(members, "members")
    pivots = members.groupBy("bucket").agg(F.min("member").alias("pivot"), F.min(F.struct(F.xxhash64("member").alias("h"), "member")).alias("other"), F.max("member").alias("last"))
    pivots = written(pivots.where("pivot <> last").selectExpr("bucket", "pivot", "other.member other"), "pivots")
    meet = written(members.join(pivots, "bucket"), "buckets")
    texts = docs.selectExpr("CAST(doc_id AS long) node", "text body").join(meet.selectExpr("member node").distinct(), "node", "left_semi")
    texts = written(texts, "texts")
    pairs = meet.selectExpr("pivot x", "member y").union(meet.selectExpr("other x", "member y")).where("x <> y")
    pairs = pairs.groupBy(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).agg(F.min("x").alias("a"))
    pairs = pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
    links = written(confirm(pairs, texts, width, percent), "links")
    found = connected_components(links.union(_copies(full)))

    # Buckets whose members are still apart: their pivots are done, the rest is compared in blocks.
    placed = meet.join(found.withColumnRenamed("node", "member"), "member", "left")
    placed = placed.selectExpr("bucket", "pivot", "other", "member", "coalesce(component, member) component")
    placed = written(placed, "placed")
    rest = placed.where("member <> pivot AND member <> other")
    apart = rest.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    rest = written(rest.join(apart, "bucket").select("bucket", "member", "component"), "rest")
    out = rows.select(F.col("doc_id").alias("node"), "n_shingles").join(found, "node", "left")
    out = out.select("node", "n_shingles", F.coalesce("component", "node").alias("component"))
    if not rest.isEmpty():
        more = written(_residual_links(rest, texts, width, percent), "more")
        if not more.isEmpty():
            out = merged(out, more)
    return out.selectExpr("node doc_id", "n_shingles", "component component_id", "component <=> node kept")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of `docs`, one document of each component: that of the smallest doc_id. Rows without doc_id stay,
    and so do repeated rows of the document that is kept; columns may have any names."""
    name = unused("copy", docs)
    copies = near_duplicates(docs.select("doc_id", "text"), width, percent).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(name), "left_anti")


#: 2-word shingles, similarity 0.8: all pairs with a common shingle, then everything reachable.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, b FROM r JOIN both_ways ON a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
