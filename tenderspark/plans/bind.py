"""Model tables bound to the star-schema tables: one portable SELECT each, used by Spark and by the oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "requirements": """
        SELECT o_orderkey AS requirement_id, o_custkey AS rfp_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('C.', CAST(o_orderkey % 7 AS STRING), '.', CAST(o_orderkey % 3 AS STRING)) END AS section_number,
               concat(CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE '' END, o_orderpriority, ' shall ', CAST(o_orderkey % 40 AS STRING), CASE WHEN o_orderkey % 9 = 0 THEN ' X ' ELSE ' x' END) AS raw_text_content,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Technical' WHEN '2-HIGH' THEN 'Security' WHEN '3-MEDIUM' THEN 'Past Performance' WHEN '4-NOT SPECIFIED' THEN 'Instruction' ELSE 'Evaluation Criteria' END AS category,
               CASE WHEN o_orderkey % 11 = 0 THEN 'na' WHEN o_orderkey % 19 = 0 THEN 'ADDRESSED' WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'compliant' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'Exception' END AS compliance_status,
               CAST(o_orderkey % 10 AS INT) AS extraction_order, CASE WHEN o_orderkey % 5 = 0 THEN 'optional' ELSE 'mandatory' END AS type, o_orderdate AS created_at
        FROM orders""",
    "proposals": """
        SELECT c_custkey AS proposal_id, c_nationkey AS tenant, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey - c_custkey % 2 END AS rfp_id, c_name AS title,
               c_mktsegment AS agency, concat('SOL-', CAST(c_custkey % 50 AS STRING)) AS solicitation_number,
               CASE c_custkey % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'submitted' WHEN 2 THEN 'review_needed' ELSE 'draft' END AS status, c_acctbal AS updated_at, c_custkey % 5 AS created_at
        FROM customer""",
    "rfps": """
        SELECT c_custkey AS rfp_id, CASE WHEN c_custkey % 6 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS uploaded_by,
               CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'extracting' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'draft_failed' END AS processing_status, concat('reason ', CAST(c_custkey AS STRING)) AS failure_reason
        FROM customer""",
    "sections": """
        SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS section_id, l_partkey AS proposal_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey END AS requirement_id,
               concat('Section ', CAST(l_linenumber AS STRING)) AS section_title,
               CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN '  ' ELSE concat(l_returnflag, ' draft  of ', CAST(l_quantity AS INT), ' words') END AS content,
               CASE WHEN l_linestatus = 'F' THEN 'approved' WHEN l_linenumber = 7 THEN NULL ELSE 'needs_review' END AS status, l_linenumber AS sort_order,
               l_shipdate AS created_at, l_discount AS ai_confidence_score
        FROM lineitem""",
    "calls": """
        SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'gemini-2.5-flash' WHEN 'view' THEN 'gemini-2.0-flash' WHEN 'error' THEN 'text-embedding-004' ELSE 'other-model' END AS model,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 1000 + 1 AS tokens_in, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 10 AS tokens_out, value AS latency_ms, event_type <> 'error' AS ok, user_id
        FROM events""",
    "trajectories": """
        SELECT conv_id AS run_id, conv_id % 40 AS proposal_id, CAST(turn AS INT) AS outline_index, CASE WHEN turn % 3 = 0 THEN 'saved' WHEN turn % 3 = 1 THEN 'guardrail_rejected' ELSE 'draft_failed' END AS final_status,
               CAST(turn % 3 + 1 AS INT) AS attempt_count, turn % 4 = 0 AS stalled, conv_id % 7 AS created_at
        FROM conversations""",
    "tokens": """
        SELECT event_id AS token_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id + 1 END AS replaced_by, ts AS created_at FROM events""",
    "requests": """
        SELECT event_id AS request_id, user_id, event_type AS operation, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 62 = 0 THEN chr(9) WHEN event_id % 31 = 0 THEN ' ' ELSE concat('k', CAST(event_id % 50 AS STRING)) END AS idempotency_key,
               CAST(event_id % 3 AS STRING) AS request_hash, ts FROM events""",
}
BASE = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, read: Callable[[SparkSession, str, str], DataFrame] = base) -> DataFrame:
    """A model table, or a base table, read by `read`."""
    if name in BASE:
        return read(spark, sf_dir, name)
    sql, used = VIEWS[name], set()
    for t in BASE:
        if re.search(rf"\bFROM {t}\b", sql):
            sql, used = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql), used | {t}
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """`sql` with the SELECTs of the model tables that it names as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({VIEWS[n]})" for n in used]
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE" if recursive else "WITH") :]
        return f"WITH {recursive}{', '.join(ctes)}{', ' if ctes else ''}{body}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
