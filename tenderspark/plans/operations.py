"""Queries over telemetry, windows, requests, sessions and critic records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderspark.functions import drafts, numbers
from tenderspark.operators import backfill, ops, revisions, rollups
from tenderspark.plans.registry_tools import Registry
from tenderspark.sources import tables
from tenderspark.sources.shared import new_path

R = Registry()

PRICES = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in numbers.PRICES.items())
USAGE = f"""WITH prices AS (SELECT * FROM (VALUES {PRICES}) v(model, price_in, price_out)),
    m AS (SELECT model, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS errors, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round_even(sum(latency_ms) / count(*), 1) AS avg_latency_ms FROM calls GROUP BY model),
    p AS (SELECT m.*, coalesce(round_even(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 4), 0) AS est_cost, price_in IS NOT NULL AS priced FROM m LEFT JOIN prices USING (model))"""
R.add(
    "a13_llm_usage_rollup", ["calls"], lambda c: ops.llm_usage_rollup(c, ops.price_table(c.sparkSession)),
    USAGE + " SELECT * FROM p UNION ALL SELECT NULL, sum(calls), sum(errors), sum(tokens_in), sum(tokens_out), NULL, round_even(sum(est_cost), 4), NULL FROM p",
)
R.add("j11_price_join", ["calls"], lambda c: ops.price_join(c.select("event_id", "model", "tokens_in", "tokens_out"), ops.price_table(c.sparkSession)),
    f"WITH prices AS (SELECT * FROM (VALUES {PRICES}) v(model, price_in, price_out)) SELECT event_id, model, tokens_in, tokens_out, coalesce(round_even(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 4), 0) AS est_cost, price_in IS NOT NULL AS priced FROM calls LEFT JOIN prices USING (model)")
LOGS = "SELECT CAST(event_id AS STRING) AS request_id, ts AS timestamp, CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 404 ELSE 200 END AS status, value AS duration_ms FROM events"
R.add("a19_http_status_rollup", ["events"], lambda e: ops.http_status_rollup(e.selectExpr("CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 404 ELSE 200 END status", "value duration_ms")),
    f"SELECT CASE WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARNING' ELSE 'INFO' END AS level, count(*) AS n, round_even(avg(duration_ms), 2) AS mean_ms, max(duration_ms) AS max_ms FROM ({LOGS}) l GROUP BY 1")
R.add("a20_trace", ["events"], lambda e: ops.trace(e.selectExpr("CAST(user_id AS STRING) request_id", "ts timestamp", "event_type message"), "7"), "SELECT CAST(user_id AS VARCHAR) AS request_id, ts AS timestamp, event_type AS message FROM events WHERE user_id = 7")
STATUS = "CASE event_type WHEN 'click' THEN 'parsing' WHEN 'view' THEN 'extracting' WHEN 'error' THEN 'failed' ELSE 'completed' END"


def progress(e):
    return ops.progress_changes(e.selectExpr("user_id doc_id", "ts", f"{STATUS} status", "event_id % 2 n_requirements"))


R.add("w13_progress_changes", ["events"], lambda e: progress(e)[0],
    f"""WITH l AS (SELECT user_id AS doc_id, ts, {STATUS} AS status, event_id % 2 AS n_requirements FROM events), b AS (SELECT *, lag(status) OVER w AS s, lag(n_requirements) OVER w AS n, row_number() OVER w AS i FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ts, status))
        SELECT doc_id, ts, status, n_requirements FROM b WHERE i = 1 OR s <> status OR n <> n_requirements""")  # fmt: skip
R.add("w13_step_times", ["events"], lambda e: progress(e)[1],
    f"""WITH l AS (SELECT user_id AS doc_id, ts, {STATUS} AS status FROM events), d AS (SELECT doc_id, ts, unnest(['upload', 'parse', 'extract', 'classify', 'ready'][1:CASE status WHEN 'parsing' THEN 1 WHEN 'completed' THEN 5 ELSE 2 END]) AS step FROM l) SELECT doc_id, step, min(ts) AS completed_at FROM d GROUP BY ALL""")
WINDOWS = """WITH RECURSIVE e AS (SELECT user_id AS key, ts FROM events), w AS (SELECT key, min(ts) AS s FROM e GROUP BY key UNION ALL SELECT w.key, (SELECT min(ts) FROM e WHERE e.key = w.key AND e.ts >= w.s + INTERVAL 6 HOUR) FROM w WHERE w.s IS NOT NULL),
    n AS (SELECT w.key, w.s, count(*) AS n FROM w JOIN e ON e.key = w.key AND e.ts >= w.s AND e.ts < w.s + INTERVAL 6 HOUR WHERE w.s IS NOT NULL GROUP BY ALL)"""
R.add("w14_anchored_windows", ["events"], lambda e: ops.anchored_windows(e.selectExpr("user_id key", "ts", "event_id"), 6 * 3600, 3), WINDOWS + " SELECT key, s AS window_start, n, n > 3 AS over_limit FROM n")
R.add("w15_suppressed_warnings", ["events"], lambda e: ops.suppressed_warnings(e.selectExpr("user_id key", "ts", "event_id"), 6 * 3600), WINDOWS + " SELECT key, s AS ts, coalesce(lag(n) OVER (PARTITION BY key ORDER BY s) - 1, 0) AS suppressed FROM n")
D11 = r"""SELECT *, CASE WHEN idempotency_key IS NULL THEN 'new' WHEN NOT regexp_matches(idempotency_key, '\S') THEN 'invalid' WHEN row_number() OVER w = 1 THEN 'new' WHEN first_value(request_hash) OVER w = request_hash THEN 'replay' ELSE 'conflict' END AS outcome
        FROM requests WINDOW w AS (PARTITION BY user_id, operation, idempotency_key ORDER BY ts, request_id)"""
R.add("d11_idempotent_requests", ["requests"], revisions.idempotent_requests, D11)
R.add("d12_single_use_tickets", ["events"],
    lambda e: revisions.single_use_tickets(e.where("event_type = 'view'").selectExpr("event_id % 1000 ticket", "user_id % 3 proposal_id", "ts").groupBy("ticket").agg(F.min("ts").alias("ts"), F.min("proposal_id").alias("proposal_id")),
        e.where("event_type <> 'view'").selectExpr("event_id redemption_id", "event_id % 1000 ticket", "user_id % 3 proposal_id", "ts"), 40_000_000),
    """WITH i AS (SELECT event_id % 1000 AS ticket, min(ts) AS issued, min(user_id % 3) AS fr FROM events WHERE event_type = 'view' GROUP BY 1), r AS (SELECT event_id AS redemption_id, event_id % 1000 AS ticket, user_id % 3 AS proposal_id, ts FROM events WHERE event_type <> 'view'),
        x AS (SELECT r.*, fr, coalesce(ts >= issued AND ts < issued + INTERVAL 40000000 SECOND, false) AS alive FROM r LEFT JOIN i USING (ticket)), y AS (SELECT *, row_number() OVER (PARTITION BY ticket, alive ORDER BY ts, redemption_id) AS n FROM x)
        SELECT redemption_id, ticket, proposal_id, ts, CASE WHEN NOT alive THEN 'unknown_or_expired' WHEN n > 1 THEN 'already_used' WHEN fr = proposal_id THEN 'ok' ELSE 'wrong_proposal' END AS outcome FROM y""")  # fmt: skip
R.add("j09_session_origin", ["tokens"], backfill.session_origin,
    """WITH RECURSIVE up AS (SELECT token_id, token_id AS at, created_at AS origin FROM tokens UNION ALL SELECT up.token_id, t.token_id, least(up.origin, t.created_at) FROM up JOIN tokens t ON t.replaced_by = up.at)
        SELECT token_id, min(origin) AS origin FROM up GROUP BY token_id""")  # fmt: skip
R.add("o04_due_jobs", ["events"], lambda e: rollups.due_jobs(e.selectExpr("event_id job_id", "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' ELSE 'done' END status", "ts next_dispatch_at"), F.lit("2024-01-10").cast("timestamp")),
    "SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'queued' ELSE 'running' END AS status, ts AS next_dispatch_at FROM events WHERE event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 20")
R.add("p11_active_sessions", ["events"],
    lambda e: rollups.active_sessions(e.selectExpr("event_id token_id", "user_id session_id", "ts created_at", "CASE WHEN event_id % 3 = 0 THEN ts END revoked_at", "ts + INTERVAL 5 DAYS expires_at", "ts + INTERVAL 3 DAYS session_expires_at"), F.lit("2024-01-10").cast("timestamp"), F.lit(7)),
    "SELECT event_id AS token_id, user_id AS session_id, ts AS created_at, NULL::TIMESTAMP AS revoked_at, ts + INTERVAL 5 DAY AS expires_at, ts + INTERVAL 3 DAY AS session_expires_at, user_id = 7 AS current FROM events WHERE event_id % 3 <> 0 AND ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-10'")
R.add("f38_days_until", ["events"], lambda e: e.select("event_id", numbers.days_until(F.col("ts"), F.lit("2024-01-10 12:00:00").cast("timestamp")).alias("days")),
    "SELECT event_id, CAST(ceil((floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-10 12:00:00')) / 86400) AS BIGINT) AS days FROM events")



def attempts(c):
    none = F.array().cast("array<string>")
    x = c.selectExpr("conv_id % 200 run_id", "CAST(floor(conv_id / 200) AS INT) outline_index", "CAST(turn + 1 AS INT) attempt", "turn", "conv_id", "text")
    claim = F.when((F.col("turn") == 0) | (F.col("conv_id") % 3 == 0), "claim").otherwise(F.col("text"))
    critic = F.struct(
        (F.col("turn") % 5 != 1).alias("addressed"), (F.col("turn") % 7 != 3).alias("evaluation_alignment"), F.lit(True).alias("benefit_mapped"), F.when(F.col("turn") % 4 != 2, F.array(claim)).otherwise(none).alias("unsupported_claims"),
        none.alias("filler_found"), none.alias("cited_sources"), F.when(F.col("turn") % 2 == 0, F.lit("fix")).alias("feedback"),
    )
    return x.select("run_id", "outline_index", "attempt", F.when(F.col("conv_id") % 11 != F.col("turn"), critic).alias("critic"))


JUDGED = """WITH a AS (SELECT conv_id % 200 AS run_id, CAST(floor(conv_id / 200) AS INT) AS outline_index, CAST(turn + 1 AS INT) AS attempt, turn, conv_id % 11 <> turn AS has, CASE WHEN turn = 0 OR conv_id % 3 = 0 THEN 'claim' ELSE text END AS claim FROM conversations),
    b AS (SELECT *, has AND turn % 5 <> 1 AND turn % 7 <> 3 AND turn % 4 = 2 AS passes FROM a), c AS (SELECT *, CASE WHEN has AND NOT passes THEN CASE WHEN turn % 4 <> 2 THEN claim ELSE '' END END AS found FROM b),
    d AS (SELECT *, last_value(found IGNORE NULLS) OVER (PARTITION BY run_id, outline_index ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
    j AS (SELECT run_id, outline_index, attempt, turn, has, claim, passes, coalesce(found <> '' AND found = before, false) AS stalled FROM d)"""
R.add("w11_critic_stall", ["conversations"], lambda c: revisions.critic_stall(attempts(c)).drop("critic"), JUDGED + " SELECT run_id, outline_index, attempt, passes, stalled FROM j")
R.add("w12_revise_or_save", ["conversations"], lambda c: revisions.revise_or_save(revisions.critic_stall(attempts(c))).select("run_id", "outline_index", "attempt", "next"),
    JUDGED + " SELECT run_id, outline_index, attempt, CASE WHEN stalled THEN 'save' WHEN has AND NOT passes AND attempt < 3 THEN 'revise' ELSE 'save' END AS next FROM j")
R.add("f30_critic_feedback", ["conversations"], lambda c: attempts(c).select("run_id", "outline_index", "attempt", drafts.critic_feedback(F.col("critic")).alias("feedback")),
    JUDGED + """ SELECT run_id, outline_index, attempt, CASE WHEN NOT has THEN '' ELSE concat_ws(chr(10), CASE WHEN turn % 2 = 0 THEN 'fix' END, CASE WHEN turn % 4 <> 2 THEN concat('Remove or substantiate these unsupported claims: ', claim) END,
        CASE WHEN turn % 7 = 3 THEN 'Speak directly to the stated evaluation criteria.' END) END AS feedback FROM j""")  # fmt: skip
R.add("f31_combine_feedback", ["conversations"], lambda c: c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s.role).alias("h")).select("conv_id", drafts.combine_feedback(F.col("h")).alias("feedback")),
    """WITH h AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
        SELECT conv_id, CASE WHEN any_value(n) = 1 THEN any_value(role) ELSE string_agg(concat('[Revision ', i, ' feedback]', chr(10), role), concat(chr(10), chr(10)) ORDER BY i) END AS feedback FROM h GROUP BY conv_id""")  # fmt: skip


def logged(events):
    """The events as lines of JSON, every tenth cut short, every seventh with a field that the schema does not know."""
    spark, path = events.sparkSession, new_path(events.sparkSession, "logs")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_id").cast("string").alias("request_id"), (F.col("event_id") % 5 * 100 + 100).alias("status"), F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("shard")))
    events.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 60)).otherwise(line).alias("value")).write.text(path)
    log = tables.read_json_logs(spark, path)
    return log.select("request_id", "status", F.expr("try_variant_get(fields, '$.shard', 'string')").alias("shard"), F.length("damaged").alias("damaged"))


R.add("s06_read_json_logs", ["events"], logged, "SELECT CASE WHEN event_id % 10 <> 0 THEN CAST(event_id AS VARCHAR) END AS request_id, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 5 * 100 + 100 AS INT) END AS status, CASE WHEN event_id % 7 = 0 AND event_id % 10 <> 0 THEN event_type END AS shard, CASE WHEN event_id % 10 = 0 THEN 60 END AS damaged FROM events")


def exported(r):
    """The matrix as CSV, read again; texts get quotes, commas and line breaks."""
    path = new_path(r.sparkSession, "csv")
    text = F.concat(F.lit(' "'), F.col("raw_text_content"), F.when(F.col("requirement_id") % 2 == 0, '\n, "").').otherwise(" "))
    tables.write_matrix_csv(r.select(F.col("rfp_id").alias("proposal_id"), F.col("requirement_id").alias("number"), F.col("section_number").alias("section"), F.col("compliance_status").alias("status"), text.alias("text")), path)
    return tables.read_matrix_csv(r.sparkSession, path)


R.add("s08_matrix_csv", ["requirements"], exported, """SELECT CAST(rfp_id AS VARCHAR) AS proposal_id, requirement_id AS number, section_number AS section, compliance_status AS status, concat(' "', raw_text_content, CASE WHEN requirement_id % 2 = 0 THEN concat(chr(10), ', "").') ELSE ' ' END) AS text FROM requirements""")
