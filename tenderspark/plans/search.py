"""Retrieval queries: chunks are `embeddings` with the documents of the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.operators import keyword_index, retrieval, rollups
from tenderspark.plans.registry_tools import Registry

R = Registry()

CHUNKS = """SELECT vec_id AS chunk_id, vec_id % 2 AS tenant, CASE WHEN vec_id % 3 = 0 THEN vec_id % 4 END AS proposal_id, concat(CASE WHEN label % 2 = 0 THEN '\t' ELSE '' END, 'source', CAST(label % 6 AS STRING), CASE WHEN label % 3 = 0 THEN ' \n' ELSE '' END) AS source_name, text AS content, embedding,
    concat('i', CAST(vec_id % 3 AS STRING)) AS industry, concat('d', CAST(label % 2 AS STRING)) AS document_type, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'won' END AS outcome FROM embeddings JOIN documents ON doc_id = vec_id"""
#: Every row whose id is divisible by 50 asks, with its whole text.
QUERIES = """SELECT vec_id AS query_id, CAST(floor(vec_id / 50) AS BIGINT) % 2 AS tenant, CASE WHEN vec_id % 100 = 0 THEN vec_id % 4 END AS proposal_id, text, embedding,
    CASE WHEN vec_id % 150 = 0 THEN concat('i', CAST(vec_id % 3 AS STRING)) END AS industry, CAST(NULL AS STRING) AS document_type, CASE WHEN vec_id % 7 = 0 THEN 'won' END AS outcome FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0"""
SECTION = "CAST(floor(query_id / 200) AS BIGINT)"  # a few queries a section, so sections grow with the table


def bound(e: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    sql = lambda q: e.sparkSession.sql(q.replace("FROM embeddings JOIN documents", "FROM {e} JOIN {d}"), e=e, d=d)
    return sql(QUERIES), sql(CHUNKS)


STOP = ", ".join(f"'{w}'" for w in keyword_index.STOP_WORDS)
TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND w NOT IN (STOP))".replace("STOP", STOP)
BASE = f"""WITH chunks AS ({CHUNKS}), queries AS ({QUERIES}),
    asked AS (SELECT *, 'library' AS origin, '' AS pool FROM queries UNION ALL SELECT *, 'bid', CAST(proposal_id AS VARCHAR) FROM queries WHERE proposal_id IS NOT NULL),
    pairs AS (SELECT query_id, origin, chunk_id, q.text, content, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM asked q JOIN chunks c ON q.tenant = c.tenant AND q.pool = coalesce(CAST(c.proposal_id AS VARCHAR), '')
        WHERE (q.industry IS NULL OR q.industry = c.industry) AND (q.outcome IS NULL OR q.outcome = c.outcome)),
    dense_all AS (SELECT query_id, origin, chunk_id, score, row_number() OVER (PARTITION BY query_id, origin ORDER BY score DESC, chunk_id) AS rank FROM pairs),
    qt AS (SELECT DISTINCT query_id, unnest(list_distinct({TERMS.format("text")})) AS term, len(list_distinct({TERMS.format("text")})) AS n FROM queries),
    ct AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TERMS.format("content")}) AS term FROM chunks) x GROUP BY ALL),
    kw AS (SELECT p.query_id, p.origin, p.chunk_id, p.score, round(sum(ln(1 + tf)), 6) AS weight FROM pairs p JOIN qt ON qt.query_id = p.query_id JOIN ct ON ct.chunk_id = p.chunk_id AND ct.term = qt.term GROUP BY ALL HAVING count(*) = any_value(n)),
    kw_all AS (SELECT query_id, origin, chunk_id, score, row_number() OVER (PARTITION BY query_id, origin ORDER BY weight DESC, chunk_id) AS rank FROM kw)"""
FUSED = (
    BASE
    + """, legs AS (SELECT *, 0 AS leg FROM dense_all WHERE rank <= 15 AND query_id IN (SELECT query_id FROM queries WHERE regexp_matches(text, '\\S')) UNION ALL SELECT *, 1 FROM kw_all WHERE rank <= 15),
    f AS (SELECT query_id, origin, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, arg_min(score, (leg, rank)) AS score, min((leg, rank)) AS o FROM legs GROUP BY ALL),
    fused AS (SELECT query_id, origin, chunk_id, rrf, score, row_number() OVER (PARTITION BY query_id, origin ORDER BY rrf DESC, o) AS rank FROM f)"""
)


def cut(name: str, source: str, floor: float, k: str = "5") -> str:
    return f""", {name}_r AS (SELECT query_id, origin, chunk_id, rrf, score, row_number() OVER (PARTITION BY query_id, origin ORDER BY rank) AS r, {k} AS k FROM {source} WHERE score >= {floor}),
    {name}_p AS (SELECT *, CASE WHEN origin = 'bid' THEN r ELSE r + least(count(*) FILTER (WHERE origin = 'bid') OVER (PARTITION BY query_id), k) END AS pos FROM {name}_r),
    {name} AS (SELECT query_id, origin, chunk_id, rrf, score, CAST(pos AS INT) AS pos FROM {name}_p WHERE pos <= k)"""


ADAPTIVE = FUSED + cut("strong", "fused", 0.35) + ", left_over AS (SELECT * FROM fused WHERE query_id NOT IN (SELECT query_id FROM strong))" + cut("faint", "left_over", 0.2)
BOTH = ["embeddings", "documents"]


def _add(name, fn, sql=None):
    R.add(name, BOTH, lambda e, d: fn(*bound(e, d)), sql and sql.replace("SECTION", SECTION))


_add("j01_knn_join", lambda q, c: retrieval.knn_join(q, c, 10), BASE + " SELECT * FROM dense_all WHERE rank <= 10")
_add("j02_keyword_join", lambda q, c: retrieval.keyword_join(q, c, 10), BASE + " SELECT * FROM kw_all WHERE rank <= 10")
_add("j02_index_terms", lambda q, c: keyword_index.build(c).terms, f"""SELECT tenant, pool, term, count(DISTINCT chunk_id) AS often
    FROM (SELECT chunk_id, tenant, coalesce(CAST(proposal_id AS VARCHAR), '') AS pool, unnest({TERMS.format("content")}) AS term FROM ({CHUNKS}) c) x GROUP BY ALL""")
_add("w02_rrf_fuse", lambda q, c: retrieval.fused_hits(q, c, 5), FUSED + " SELECT * FROM fused")
_add("w03_search", lambda q, c: retrieval.search(q, c, 5, 0.3), FUSED + cut("hits", "fused", 0.3) + " SELECT * FROM hits")
_add("w04_adaptive_floor", lambda q, c: retrieval.adaptive_floor(retrieval.fused_hits(q, c, 5)), ADAPTIVE + " SELECT *, false AS weak FROM strong UNION ALL SELECT *, true FROM faint")
_add("j12_ann_candidates", lambda q, c: retrieval.ann_candidates(q, c, 10))
_add("j12_ann_recall", lambda q, c: retrieval.ann_recall(q, c, 10).select("asked", "hits", (F.col("found") >= 0.9 * F.col("hits")).alias("recall_reached"), (F.col("read") <= 0.25 * F.col("reach")).alias("reads_a_quarter")),
    BASE + " SELECT count(DISTINCT (query_id, origin)) AS asked, count(*) AS hits, true AS recall_reached, true AS reads_a_quarter FROM dense_all WHERE rank <= 10")


def diversified(q, c):
    hits = retrieval.fused_hits(q, c, 5).join(c.select("chunk_id", "source_name"), "chunk_id")
    return retrieval.diversify(hits.select(F.expr(SECTION).alias("section_id"), "source_name", "score", F.struct("chunk_id", "query_id", "origin").alias("order")), 6).select("section_id", "source_name", "score", "place")


_add("w06_diversify", diversified, FUSED + """, h AS (SELECT SECTION AS section_id, source_name, score, chunk_id, query_id, origin FROM fused JOIN chunks USING (chunk_id)),
    d1 AS (SELECT *, row_number() OVER (PARTITION BY section_id, source_name ORDER BY score DESC, chunk_id, query_id, origin) > 2 AS over_cap FROM h),
    d2 AS (SELECT section_id, source_name, score, row_number() OVER (PARTITION BY section_id ORDER BY over_cap, score DESC, chunk_id, query_id, origin) AS place FROM d1) SELECT * FROM d2 WHERE place <= 6""")  # fmt: skip


def contexts(q, c):
    reqs = q.select(F.expr(SECTION).alias("section_id"), F.col("query_id").alias("req_idx"), "query_id")
    return retrieval.section_context(reqs, retrieval.fused_hits(q, c, 5), c, 5)


CONTEXT = (
    FUSED
    + """, n AS (SELECT query_id, SECTION AS section_id, count(*) OVER (PARTITION BY SECTION) AS n FROM queries), kq AS (SELECT fused.*, n.section_id, CAST(greatest(2, ceil(5 / n.n)) AS INT) AS per FROM fused JOIN n USING (query_id))"""
    + cut("strong", "kq", 0.35, "per")
    + ", left_over AS (SELECT * FROM kq WHERE query_id NOT IN (SELECT query_id FROM strong))"
    + cut("faint", "left_over", 0.2, "per")
    + """, own AS (SELECT *, SECTION AS section_id FROM (SELECT *, false AS weak FROM strong UNION ALL SELECT *, true FROM faint) u),
    met AS (SELECT section_id, chunk_id, max(score) AS score, min((query_id, pos)) AS o FROM own GROUP BY ALL), src AS (SELECT met.*, source_name FROM met JOIN chunks USING (chunk_id)),
    c1 AS (SELECT *, row_number() OVER (PARTITION BY section_id, source_name ORDER BY score DESC, o) > 2 AS over_cap FROM src), c2 AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY over_cap, score DESC, o) AS place FROM c1),
    ctx AS (SELECT section_id, place, chunk_id, source_name, score FROM c2 WHERE place <= 5)"""
)
_add("w05_section_context", lambda q, c: contexts(q, c)[0].drop("order"), CONTEXT + " SELECT * FROM ctx")
_add("w05_section_grounding", lambda q, c: contexts(q, c)[1], CONTEXT + " SELECT n.section_id, any_value(n.n) AS requirements, count(DISTINCT own.query_id) AS grounded_requirements, coalesce(bool_or(weak), false) AS weak FROM n LEFT JOIN own ON own.query_id = n.query_id GROUP BY 1")
_add("a14_grounding_confidence", lambda q, c: retrieval.grounding_confidence(q.select(F.expr(SECTION).alias("section_id")).distinct(), contexts(q, c)[0]), CONTEXT + ", s AS (SELECT DISTINCT SECTION AS section_id FROM queries) SELECT s.section_id, coalesce(round_even(avg(score), 4), 0) AS confidence FROM s LEFT JOIN ctx ON ctx.section_id = s.section_id GROUP BY 1")
_add("a15_reference_tags", lambda q, c: retrieval.reference_tags(contexts(q, c)[0]), CONTEXT + ", t AS (SELECT section_id, regexp_replace(source_name, '^\\s+|\\s+$', '', 'g') AS source_name, max(score) AS m, min(place) AS p FROM ctx GROUP BY ALL) SELECT section_id, list(source_name ORDER BY m DESC, p) AS reference_tags FROM t GROUP BY 1")
_add("a08_list_sources", lambda q, c: rollups.list_sources(c.withColumn("created_at", F.col("chunk_id"))), f"SELECT tenant, proposal_id, source_name, count(*) AS n_chunks, max(chunk_id) AS created_at, max(industry) AS industry, max(document_type) AS document_type, max(outcome) AS outcome FROM ({CHUNKS}) c GROUP BY ALL")
_add("a09_history_count", lambda q, c: rollups.history_count(c), f"SELECT tenant, count(embedding) AS n, count(embedding) > 0 AS grounded FROM ({CHUNKS}) c GROUP BY 1")
_add("p04_metadata_filter", lambda q, c: retrieval.pool_filter(retrieval.metadata_filter(c, industry="i1", outcome="won")).select("chunk_id", "source_name"), f"SELECT chunk_id, source_name FROM ({CHUNKS}) c WHERE industry = 'i1' AND outcome = 'won' AND proposal_id IS NULL")
