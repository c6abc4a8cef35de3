"""Batch hybrid retrieval: exact and approximate nearest neighbours, keyword search, fusion, floors and diversity.

Queries: query_id, tenant, proposal_id (the bid, or null), text, embedding, and the optional exact-match filters
industry, document_type, outcome (null: no filter). Chunks: chunk_id, tenant, proposal_id (null: the tenant's library),
source_name, content, embedding and the same three tags. A query searches two pools of its tenant, its bid's chunks and
the library. Scores are cosines rounded to SCORE_DIGITS, so equal vectors tie however they are summed; ties go to the
smaller chunk_id. Hits are rows (query_id, chunk_id, ...), never arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions import numbers, text as texts
from tenderspark.functions.columns import let
from tenderspark.operators import keyword_index, vector_index
from tenderspark.operators.keyword_index import KeywordIndex, pool_of
from tenderspark.operators.vector_index import Codebook
from tenderspark.sources.shared import written

SCORE_DIGITS = 6
BLOCK, QUERY_BLOCK, CODE_BLOCK = 4096, 1024, 65_536  # chunks, queries and codes compared at once
RRF = 60
TAGS = ["industry", "document_type", "outcome"]
FLOOR, WEAK_FLOOR = 0.35, 0.20
LEG_FACTOR, LEG_LEAST = 3, 15
QUOTE_WORDS, QUOTE_CHARS = 8, 20
MAX_BROADCAST_QUOTES = 100_000


def metadata_filter(chunks: DataFrame, **wanted: str | None) -> DataFrame:
    """P-04: exact matches on the given tags; None adds nothing."""
    for tag, value in wanted.items():
        if value is not None:
            chunks = chunks.where(F.col(tag) == value)
    return chunks


def pool_filter(chunks: DataFrame, proposal_id=None) -> DataFrame:
    """P-05: one bid's chunks, or the library."""
    return chunks.where(F.col("proposal_id").eqNullSafe(F.lit(proposal_id)))


def in_both_pools(queries: DataFrame) -> DataFrame:
    """Each query once for the library and once for its bid, with `pool` and `origin`."""
    bid = queries.where("proposal_id IS NOT NULL").select("*", pool_of(F.col("proposal_id")).alias("pool"), F.lit("bid").alias("origin"))
    return bid.union(queries.select("*", F.lit("").alias("pool"), F.lit("library").alias("origin")))


def _top(query: pd.DataFrame, chunk: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k chunks of one block for each query."""
    out: list[tuple] = []
    if len(query) and len(chunk):
        x, y = (np.stack(d["embedding"].to_numpy()).astype(np.float64) for d in (query, chunk))
        sizes = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = np.round((x @ y.T) / sizes, SCORE_DIGITS)
        ids = chunk["chunk_id"].to_numpy()
        tags = {t: chunk[t].to_numpy() for t in TAGS}
        for i, q in enumerate(query.itertuples(index=False)):
            ok = ~np.isnan(scores[i])
            for t in TAGS:
                if (want := getattr(q, t)) is not None:
                    ok &= tags[t] == want
            at = np.flatnonzero(ok)
            if len(at) > k:  # what reaches the k-th best score, ties included
                s = scores[i][at]
                at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
            at = at[np.lexsort((ids[at], -scores[i][at]))[:k]]
            out += [(q.query_id, q.origin, c, s) for c, s in zip(ids[at].tolist(), scores[i][at].tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(("query_id", "origin", "chunk_id", "score"), columns, strict=True)})


def _blocked(queries: DataFrame, chunks: DataFrame, keys: list[str], block_rows: int = BLOCK) -> tuple[GroupedData, GroupedData]:
    """Both sides grouped for a cogroup over chunks and queries with equal `keys`: a large key's chunks are spread over blocks
    of about `block_rows` and its queries over blocks of about QUERY_BLOCK, and each pair of blocks meets in a task."""
    of_chunks = chunks.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    of_queries = queries.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    blocks = of_chunks.join(of_queries, keys)

    def dealt_over(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """`rows` in a block of their own, once for each block of the other side."""
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        placed = rows.join(blocks, keys).select(*rows.columns, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int").alias(own), f"{other}s")
        return placed.select(*rows.columns, own, every)

    dealt = dealt_over(chunks, "chunk_id", "block", "query_block")
    asked = dealt_over(queries, "query_id", "query_block", "block")
    on = [*keys, "block", "query_block"]
    asked, dealt = (d.select(*(F.col(c).alias(c) for c in d.columns)) for d in (asked, dealt))  # both may come from one table
    return asked.groupBy(*on), dealt.groupBy(*on)


def _blocked_top(queries: DataFrame, chunks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Exact top k among chunks with equal `keys`; only k rows of a query leave a pair of blocks."""
    chunks, queries = chunks.where("embedding IS NOT NULL"), queries.where("embedding IS NOT NULL")
    ids = {"query_id": dict(queries.dtypes)["query_id"], "chunk_id": dict(chunks.dtypes)["chunk_id"]}
    asked, dealt = _blocked(queries, chunks, keys)
    met = asked.cogroup(dealt).applyInPandas(lambda q, c: _top(q, c, k), f"query_id {ids['query_id']}, origin string, chunk_id {ids['chunk_id']}, score double")
    return ranked(met, ["query_id", "origin"], [F.desc("score"), F.asc("chunk_id")], k)


def ranked(hits: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    out = hits.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def _chunk_side(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select("chunk_id", "tenant", pool_of(F.col("proposal_id")).alias("pool"), "embedding", *TAGS, *more)


def _query_side(queries: DataFrame, *more: str) -> DataFrame:
    return in_both_pools(queries).select("query_id", "origin", "tenant", "pool", "embedding", *TAGS, *more)


def knn_join(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """J-01, dense leg: query_id, origin, chunk_id, score, rank."""
    return _blocked_top(_query_side(queries), _chunk_side(chunks), ["tenant", "pool"], k)


def short_list(queries: DataFrame, coded: DataFrame, codebook: Codebook, share: float, least: int) -> DataFrame:
    """query_id, origin, chunk_id: of each block of codes the best `share` for each query, and at least `least`."""
    asked = _query_side(queries).where("embedding IS NOT NULL")
    side = coded.select("chunk_id", "tenant", pool_of(F.col("proposal_id")).alias("pool"), "code", *TAGS)
    book = queries.sparkSession.sparkContext.broadcast(codebook)

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "origin": [], "chunk_id": []}
        if len(q) and len(c):
            ok = np.ones((len(q), len(c)), bool)
            for t in TAGS:
                held = c[t].to_numpy()
                for i, want in enumerate(q[t]):
                    if want is not None:
                        ok[i] &= held == want
            ids = c["chunk_id"].to_numpy()
            for i, at in enumerate(vector_index.best_codes(book.value.tables(q["embedding"]), c["code"], ok, share, least)):
                out["query_id"] += [q["query_id"].iloc[i]] * len(at)
                out["origin"] += [q["origin"].iloc[i]] * len(at)
                out["chunk_id"] += ids[at].tolist()
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in out.items()})

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, origin string, chunk_id {dict(coded.dtypes)['chunk_id']}"
    left, right = _blocked(asked, side, ["tenant", "pool"], CODE_BLOCK)
    return left.cogroup(right).applyInPandas(best, kinds)


def ann_candidates(queries: DataFrame, chunks: DataFrame, k: int, share: float = 0.2, least: int = 20, codebook: Codebook | None = None, coded: DataFrame | None = None) -> DataFrame:
    """J-12, approximate dense leg: query_id, origin, chunk_id, score, rank.

    All codes of a query's pools are scored by look-ups, and the best `share` of each block of codes, at least `least`, is
    ranked by its true vectors. `codebook` and `coded` are those of an index that was built before.
    """
    codebook = codebook or vector_index.fit(chunks)
    coded = coded if coded is not None else vector_index.build(chunks.select("chunk_id", "tenant", "proposal_id", "embedding", *TAGS), codebook)
    short = written(short_list(queries, coded, codebook, share, least), "short")
    x, y = (d.where("embedding IS NOT NULL").select(f"{n}_id", F.col("embedding").alias(v)) for d, n, v in ((queries, "query", "x"), (chunks, "chunk", "y")))
    scored = short.join(x, "query_id").join(y, "chunk_id").select("query_id", "origin", "chunk_id", F.round(numbers.cosine(F.col("x"), F.col("y")), SCORE_DIGITS).alias("score"))
    return ranked(scored.where("score IS NOT NULL"), ["query_id", "origin"], [F.desc("score"), F.asc("chunk_id")], k)


def ann_recall(queries: DataFrame, chunks: DataFrame, k: int, share: float = 0.2) -> DataFrame:
    """J-12 against J-01, as one row: asked pools, exact hits, how many of them the short lists hold, and the share of the
    vectors in reach of the queries that was read."""
    codebook = vector_index.fit(chunks)
    coded = vector_index.build(chunks.select("chunk_id", "tenant", "proposal_id", "embedding", *TAGS), codebook)
    short = written(short_list(queries, coded, codebook, share, k), "short")
    exact = written(knn_join(queries, chunks, k), "exact")
    hits = exact.join(short, ["query_id", "origin", "chunk_id"], "left_semi").agg(F.count("*").alias("found"))
    reach = _query_side(queries).join(_chunk_side(chunks).groupBy("tenant", "pool").agg(F.count("embedding").alias("n")), ["tenant", "pool"]).agg(F.sum("n").alias("reach"))
    totals = exact.agg(F.count_distinct("query_id", "origin").alias("asked"), F.count("*").alias("hits"))
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  each side has one row
    return one(totals).join(one(hits), "_one").join(one(short.agg(F.count("*").alias("read"))), "_one").join(one(reach), "_one").drop("_one")


def keyword_join(queries: DataFrame, chunks: DataFrame, k: int, index: KeywordIndex | None = None) -> DataFrame:
    """J-02, keyword leg: chunks that hold all terms of the query, by sum of ln(1 + frequency).

    `index` is that of `chunks`; without one it is built and written here. Queries that ask the same of the same pool are
    searched once. Only the queries' own texts are tokenised.
    """
    index = index or keyword_index.build(chunks)
    asked = _query_side(queries, "text").select("query_id", "origin", "tenant", "pool", *TAGS, F.sort_array(F.array_distinct(keyword_index.terms(F.col("text")))).alias("terms"))
    # Written before it is filtered: the filter would be pushed to the table behind the queries and tokenise all of it.
    asked = written(asked, "asked").where(F.size("terms") > 0).withColumn("ask", F.sha2(F.to_json(F.struct("tenant", "pool", "terms")), 256))
    found = keyword_index.matches(asked.select("ask", "tenant", "pool", "terms").dropDuplicates(["ask"]), index)
    top = asked.select("ask", "query_id", "origin", *(F.col(t).alias(f"q_{t}") for t in TAGS)).join(found, "ask")
    met = top.join(chunks.select("chunk_id", *TAGS), "chunk_id")
    for t in TAGS:
        met = met.where(F.col(f"q_{t}").isNull() | (F.col(f"q_{t}") == F.col(t)))
    best = ranked(met.withColumn("weight", F.round("weight", SCORE_DIGITS)), ["query_id", "origin"], [F.desc("weight"), F.asc("chunk_id")], k).select("query_id", "origin", "chunk_id", "rank")
    # Vectors join last, to at most k rows of a query.
    scored = best.join(queries.select("query_id", F.col("embedding").alias("x")), "query_id").join(chunks.select("chunk_id", F.col("embedding").alias("y")), "chunk_id")
    return scored.select("query_id", "origin", "chunk_id", F.round(numbers.cosine(F.col("x"), F.col("y")), SCORE_DIGITS).alias("score"), "rank")


def rrf_fuse(dense: DataFrame, keyword: DataFrame) -> DataFrame:
    """W-02: reciprocal-rank fusion for each query and pool; `score` stays the cosine; ties keep the dense order first."""
    cols = ["query_id", "origin", "chunk_id", "score", "rank"]
    both = dense.select(*cols, F.lit(0).alias("leg")).union(keyword.select(*cols, F.lit(1).alias("leg")))
    fused = both.groupBy("query_id", "origin", "chunk_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("leg", "rank", "score")).alias("f"))
    fused = fused.select("query_id", "origin", "chunk_id", "rrf", F.col("f.score").alias("score"), F.col("f.leg").alias("leg"), F.col("f.rank").alias("leg_rank"))
    return ranked(fused, ["query_id", "origin"], [F.desc("rrf"), F.asc("leg"), F.asc("leg_rank")]).drop("leg", "leg_rank")


def fused_hits(queries: DataFrame, chunks: DataFrame, top_k: int, index: KeywordIndex | None = None) -> DataFrame:
    """Both legs of both pools, fused and written, since floors read it several times; blank queries find nothing."""
    asked = written(queries, "queries").where(texts.strip(F.coalesce("text", F.lit(""))) != "")  # written for the reason given in keyword_join
    k = max(LEG_FACTOR * top_k, LEG_LEAST)
    return written(rrf_fuse(knn_join(asked, chunks, k), keyword_join(asked, chunks, k, index)), "fused")


def cut(fused: DataFrame, top_k: int | Column, floor: float) -> DataFrame:
    """Hits at or above the floor: the bid's first, then as many of the library as are left of top_k; with `pos`."""
    k = F.lit(top_k) if isinstance(top_k, int) else top_k
    kept = ranked(fused.where(F.col("score") >= floor).withColumnRenamed("rank", "fused"), ["query_id", "origin"], [F.asc("fused")])
    n_bid = F.least(F.sum(F.when(F.col("origin") == "bid", 1).otherwise(0)).over(W.partitionBy("query_id")), k)
    pos = F.when(F.col("origin") == "bid", F.col("rank")).otherwise(n_bid + F.col("rank"))
    return kept.withColumn("pos", pos.cast("int")).where(F.when(F.col("origin") == "bid", F.col("rank") <= k).otherwise(F.col("pos") <= k)).drop("rank", "fused")


def search(queries: DataFrame, chunks: DataFrame, top_k: int = 5, min_score: float = 0.0, index: KeywordIndex | None = None) -> DataFrame:
    """W-03: query_id, origin, chunk_id, rrf, score, pos."""
    return cut(fused_hits(queries, chunks, top_k, index), top_k, min_score)


def adaptive_floor(fused: DataFrame, top_k: int | Column = 5) -> DataFrame:
    """W-04: the usual floor; queries that find nothing there are cut again at the weak floor, with `weak` set."""
    strong = cut(fused, top_k, FLOOR).withColumn("weak", F.lit(False))
    rest = fused.join(strong.select("query_id").distinct(), "query_id", "left_anti")
    return strong.unionByName(cut(rest, top_k, WEAK_FLOOR).withColumn("weak", F.lit(True)))


def diversify(hits: DataFrame, top_k: int, cap: int = 2) -> DataFrame:
    """W-06: for each section the best hits, at most `cap` of a source while others are left, in that order (`place`).

    Hits: section_id, source_name, score, order (ties). Hits over a source's cap go behind all others.
    """
    over = F.row_number().over(W.partitionBy("section_id", "source_name").orderBy(F.desc("score"), "order")) > cap
    place = F.row_number().over(W.partitionBy("section_id").orderBy(F.col("_over"), F.desc("score"), F.col("order")))
    return hits.withColumn("_over", over).withColumn("place", place).where(F.col("place") <= top_k).drop("_over")


def section_context(requirements: DataFrame, fused: DataFrame, chunks: DataFrame, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """W-05: (context rows, summary by section).

    requirements: section_id, req_idx, query_id; fused: fused_hits of those queries. Each requirement takes
    max(2, ceil(top_k / requirements)) hits; a chunk that several find keeps its best score and its first place.
    """
    n = F.count("*").over(W.partitionBy("section_id"))
    asked = requirements.select("section_id", "req_idx", "query_id", n.alias("n"), F.greatest(F.lit(2), F.ceil(F.lit(top_k) / n)).cast("int").alias("k"))
    hits = adaptive_floor(fused.join(asked.select("query_id", "k"), "query_id"), F.col("k"))
    own = hits.drop("k").join(asked.drop("k"), "query_id")
    met = own.groupBy("section_id", "chunk_id").agg(F.max("score").alias("score"), F.min(F.struct("req_idx", "pos")).alias("order"))
    context = diversify(met.join(chunks.select("chunk_id", "source_name"), "chunk_id"), top_k)
    grounded = own.groupBy("section_id").agg(F.count_distinct("req_idx").alias("grounded_requirements"), F.bool_or("weak").alias("weak"))
    weak = F.coalesce("weak", F.lit(False))
    totals = asked.select("section_id", "n").distinct().join(grounded, "section_id", "left").select("section_id", F.col("n").alias("requirements"), F.coalesce("grounded_requirements", F.lit(0)).alias("grounded_requirements"), weak.alias("weak"))
    return context.select("section_id", "place", "chunk_id", "source_name", "score", "order"), totals


def grounding_confidence(sections: DataFrame, hits: DataFrame) -> DataFrame:
    """A-14: mean cosine of a section's evidence, 4 digits; 0 without evidence."""
    mean = hits.groupBy("section_id").agg(F.bround(F.avg("score"), 4).alias("confidence"))
    return sections.select("section_id").join(mean, "section_id", "left").select("section_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def reference_tags(hits: DataFrame) -> DataFrame:
    """A-15: a section's distinct sources, best score first, then first appearance (`place`)."""
    clean = hits.withColumn("source", texts.strip(F.col("source_name"))).where("source <> ''")
    best = clean.groupBy("section_id", "source").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "place", "source")))
    return best.groupBy("section_id").agg(F.transform(ordered, lambda s: s.source).alias("reference_tags"))


def _quote_keys(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(words, at + o) for o in range(width)))


def grounded_quotes(quotes: DataFrame, docs: DataFrame, max_broadcast_quotes: int = MAX_BROADCAST_QUOTES) -> DataFrame:
    """F-11 over whole tables: doc_id, item_id, grounded. A row for each document that holds a quote; a quote that no
    document holds has one row without doc_id, not grounded; so has one too short to be judged, grounded in any.

    The inner words of a quote are whole words of every source that holds it, so up to QUOTE_WORDS of them are hashed
    and joined; a quote of one or two words is met by QUOTE_CHARS letters of its longest. Candidates are confirmed.
    Quotes and documents without id are left out.
    """
    q = quotes.where("item_id IS NOT NULL").select("item_id", texts.normalize_ws(F.coalesce("text", F.lit(""))).alias("quote")).distinct()
    short = q.where(F.length("quote") < texts.MIN_QUOTE_CHARS).select("item_id").distinct()
    long = q.where(F.length("quote") >= texts.MIN_QUOTE_CHARS).withColumn("w", F.split("quote", " "))
    long = long.withColumn("width", F.greatest(F.lit(0), F.least(F.size("w") - 2, F.lit(QUOTE_WORDS))))
    widths = sorted(r.width for r in long.select("width").distinct().collect())  # at most QUOTE_WORDS + 1 numbers
    longest = F.element_at(F.array_sort(F.transform("w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1).w
    key = F.xxhash64(F.lit(0), F.substring(longest, 1, QUOTE_CHARS))
    for n in range(1, QUOTE_WORDS + 1):
        key = F.when(F.col("width") == n, _quote_keys(F.transform("w", lambda w: F.xxhash64(w)), F.lit(1), n)).otherwise(key)
    asked = long.select("item_id", "quote", key.alias("key"))
    keys = asked.select("item_id", "key")
    if keys.count() <= max_broadcast_quotes:
        keys = F.broadcast(keys)

    def places(words: Column, n: int) -> Column:
        if n:
            at = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: _quote_keys(h, i, n))
            return F.when(F.size(words) >= n, let(F.transform(words, lambda w: F.xxhash64(w)), at)).otherwise(F.array().cast("array<bigint>"))
        grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (QUOTE_CHARS - 1)), lambda i: F.xxhash64(F.lit(0), F.substring(w, i, F.lit(QUOTE_CHARS))))
        return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= QUOTE_CHARS), grams))

    sources = docs.where("doc_id IS NOT NULL").select("doc_id", texts.normalize_ws(F.coalesce("text", F.lit(""))).alias("source"))
    found = let(F.split("source", " "), lambda w: F.array_distinct(F.concat(*(places(w, n) for n in widths)))) if widths else F.array().cast("array<bigint>")
    pairs = sources.select("doc_id", F.explode(found).alias("key")).join(keys, "key").select("doc_id", "item_id").distinct()
    sure = pairs.join(sources, "doc_id").join(asked.select("item_id", "quote"), "item_id").where(texts.quote_grounded_in(F.col("quote"), F.col("source"))).select("doc_id", "item_id").distinct()
    judged = long.select("item_id").distinct().join(sure, "item_id", "left").select("doc_id", "item_id", F.col("doc_id").isNotNull().alias("grounded"))
    return judged.unionByName(short.select(F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "item_id", F.lit(True).alias("grounded")))
