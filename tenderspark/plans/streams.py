"""The streaming jobs over the files of the tables as they are now; their SQL is that of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.plans import bind, operations
from tenderspark.plans.registry_tools import Registry
from tenderspark.sources import tables
from tenderspark.sources.shared import new_path
from tenderspark.streaming import jobs

R = Registry()
HOURS, LIMIT, SLICES = 6, 3, 3
FOREVER = 10 * 365 * 86_400


def landed(spark: SparkSession, sf_dir: str, table: str, view: str, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows that `job` yields for a view of a base table that comes in slices of its times, oldest first.

    Each slice is appended to the source folder, and the query starts again from its checkpoint: so state is carried over
    restarts and watermarks, and no more is in a micro-batch than a slice.
    """
    path, rows = new_path(spark, name), bind.base(spark, sf_dir, table)
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / SLICES if low is not None else None
    cuts = [F.lit(low + step * i) for i in range(1, SLICES)] if step is not None else []
    for lower, upper in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if lower is None else rows.where(F.col("ts") >= lower)
        part = part if upper is None else part.where((F.col("ts") < upper) | (F.col("ts").isNull() & F.lit(lower is None)))
        part.write.mode("append").parquet(f"{path}/source")
        source = bind.view(spark, sf_dir, view, lambda s, *_: s.readStream.schema(rows.schema).parquet(f"{path}/source"))
        out = job(source)
        with jobs.rocksdb_state(spark):
            query = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    kind = rows.schema["ts"].dataType
    found = spark.read.schema(out.schema).parquet(f"{path}/rows")
    return found.select(*(F.col(c).cast(kind) if t.startswith("timestamp") else F.col(c) for c, t in out.dtypes))


def add(name: str, view: str, job: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A job over a stream of the events; its times come back in the type that the table has."""
    R.queries[name] = lambda spark, sf_dir: landed(spark, sf_dir, "events", view, job, name)
    R.oracles[name] = bind.oracle(sql)


add("t01_usage_windows", "calls", lambda c: jobs.stream_llm_usage_windows(c).selectExpr("window.start window_start", "model", "calls", "tokens_in", "tokens_out"),
    """WITH w AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM calls)
        SELECT window_start, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM w
        WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM calls) - INTERVAL 10 MINUTE GROUP BY ALL""")  # fmt: skip
keyed = lambda e: e.selectExpr("user_id key", "ts", "event_id")
add("t02_attempt_windows", "events", lambda e: jobs.stream_attempt_windows(keyed(e), HOURS * 3600, LIMIT),
    operations.WINDOWS + f""" SELECT e.key, w.s AS window_start, e.ts, row_number() OVER o AS n, row_number() OVER o > {LIMIT} AS over_limit, greatest(1, CAST(ceil((epoch_us(w.s) + {HOURS * 3_600_000_000} - epoch_us(e.ts)) / 1e6) AS BIGINT)) AS seconds_left
        FROM w JOIN e ON e.key = w.key AND e.ts >= w.s AND e.ts < w.s + INTERVAL {HOURS} HOUR WINDOW o AS (PARTITION BY e.key, w.s ORDER BY e.ts)""")  # fmt: skip
add("t03_progress", "events", lambda e: jobs.stream_progress(e.selectExpr("user_id doc_id", "ts", f"{operations.STATUS} status", "event_id % 2 n_requirements"), FOREVER).drop("view", "timed_out"),
    f"""WITH l AS (SELECT user_id AS doc_id, ts, {operations.STATUS} AS status, event_id % 2 AS n_requirements FROM events),
        b AS (SELECT *, lag(status) OVER w AS s, lag(n_requirements) OVER w AS n, row_number() OVER w AS i, count(*) FILTER (WHERE status IN ('completed', 'failed')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ts, status))
        SELECT doc_id, ts, status, n_requirements FROM b WHERE ended = 0 AND (i = 1 OR s <> status OR n <> n_requirements)""")  # fmt: skip
add("t04_idempotent", "requests", lambda r: jobs.stream_idempotent(r, FOREVER), f"SELECT request_id, outcome FROM ({operations.D11}) x")
add("t06_suppressed_warnings", "events", lambda e: jobs.stream_suppressed_warnings(keyed(e), HOURS * 3600, FOREVER), operations.R.oracles["w15_suppressed_warnings"])


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in which every third document has one old row, then replaced by the stream of the extracted rows, a half of
    the documents a micro-batch; the last batch comes twice."""
    path, state, source = (new_path(spark, n) for n in ("requirements", "state", "source"))
    rows = bind.view(spark, sf_dir, "requirements")
    old = rows.where("rfp_id % 3 = 0").groupBy("rfp_id").agg(F.min("requirement_id").alias("requirement_id"), F.lit("old").alias("raw_text_content"))
    tables.replace_requirements(old, old.select("rfp_id"), path)
    coming = rows.select("rfp_id", "requirement_id", "raw_text_content")
    put = lambda df, ids, number: tables.replace_requirements(df.select(old.columns), ids, path, ("stream", number))
    for half in (0, 1):
        coming.where(f"rfp_id % 2 = {half}").write.mode("append").parquet(source)
        jobs.stream_requirements(spark.readStream.schema(coming.schema).parquet(source), put, state).awaitTermination()
    put(coming.limit(0), rows.select("rfp_id"), 1)
    return tables.read_requirements(spark, path).select("requirement_id", "rfp_id", "raw_text_content")


R.queries["t05_stream_requirements"] = replaced
R.oracles["t05_stream_requirements"] = bind.oracle("SELECT requirement_id, rfp_id, raw_text_content FROM requirements")
