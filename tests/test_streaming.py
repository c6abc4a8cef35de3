"""Streams give what the batch jobs give on the same events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tenderspark.operators import ops, revisions
from tenderspark.sources import tables
from tenderspark.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Write rows in several files, oldest first, and read them back as a stream of one file a micro-batch."""

    def make(name, rows, schema, parts=3):
        df = spark.createDataFrame(rows, schema)
        size = -(-len(rows) // parts)
        for k in range(parts):
            spark.createDataFrame(rows[k * size : (k + 1) * size] or rows[:0], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    return make


def run(spark, stream, name, tmp_path, mode="append"):
    with jobs.rocksdb_state(spark):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(90) and q.exception() is None
    return spark.table(name)


def events(n=120):
    r = random.Random(4)
    times = sorted(r.randint(0, 600) for _ in range(n))
    return [(r.randint(0, 3), i, T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)]


def test_windows_and_warnings(spark, feed, tmp_path):
    batch, stream = feed("events", events(), "key int, event_id int, ts timestamp")
    out = run(spark, jobs.stream_attempt_windows(stream, 60, 3), "windows", tmp_path)
    got = out.groupBy("key", "window_start").agg(F.max("n").alias("n"), F.max("over_limit").alias("over_limit"), F.min("seconds_left").alias("s"))
    assert {tuple(x)[:4] for x in got.collect()} == {tuple(x) for x in ops.anchored_windows(batch, 60, 3).select("key", "window_start", "n", "over_limit").collect()}
    assert all(x.s >= 1 for x in got.collect())
    warned = run(spark, jobs.stream_suppressed_warnings(stream, 60), "warnings", tmp_path)
    assert {tuple(x) for x in warned.collect()} == {tuple(x) for x in ops.suppressed_warnings(batch, 60).collect()}


def test_usage(spark, feed, tmp_path):
    rows = [("m" + str(k % 2), T0 + dt.timedelta(minutes=i), i, 1, 2.0, k != 3) for i, (k, _, _) in enumerate(events(60))]
    batch, stream = feed("calls", rows, "model string, ts timestamp, tokens_in long, tokens_out long, latency_ms double, ok boolean")
    out = run(spark, jobs.stream_llm_usage(stream), "usage", tmp_path, "complete")
    own = batch.groupBy("model").agg(F.count("*"), F.count_if(~F.col("ok")), F.sum("tokens_in"), F.sum("tokens_out"), F.sum("latency_ms"))
    assert {tuple(x) for x in out.collect()} == {tuple(x) for x in own.collect()}
    timed = run(spark, jobs.stream_llm_usage_windows(stream), "usage_windows", tmp_path)
    closed = {(x.window.start, x.model): x.calls for x in timed.collect()}
    whole = {(x.window.start, x.model): x.n for x in batch.groupBy(F.window("ts", "5 minutes"), "model").agg(F.count("*").alias("n")).collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def test_progress_and_requests(spark, feed, tmp_path):
    steps = ["pending", "pending", "parsing", "extracting", "extracting", "completed", "failed"]
    rows = [("d", T0 + dt.timedelta(seconds=i), s, 0) for i, s in enumerate(steps)]
    batch, stream = feed("log", rows, "doc_id string, ts timestamp, status string, n_requirements long")
    out = run(spark, jobs.stream_progress(stream), "progress", tmp_path)
    assert [x.status for x in out.orderBy("ts").collect()] == ["pending", "parsing", "extracting", "completed"]
    assert [x.status for x in ops.progress_changes(batch)[0].orderBy("ts").collect()] == ["pending", "parsing", "extracting", "completed", "failed"]
    r = random.Random(7)
    log = [(i, "u", "op", r.choice(["a", "b", "c", None, " ", "\t", "x" * 200]), r.choice(["x", "y", None]), T0 + dt.timedelta(seconds=i // 2)) for i in range(80)]
    batch, stream = feed("requests", log, "request_id int, user_id string, operation string, idempotency_key string, request_hash string, ts timestamp")
    got = run(spark, jobs.stream_idempotent(stream), "idempotent", tmp_path)
    wanted = {(x.request_id, x.outcome) for x in revisions.idempotent_requests(batch).collect()}
    assert {tuple(x) for x in got.collect()} == wanted and {o for _, o in wanted} == {"new", "replay", "conflict", "invalid"}


def test_progress_over_batches_is_the_batch_job(spark, feed, tmp_path):
    r = random.Random(3)
    rows = [(r.randint(0, 4), T0 + dt.timedelta(seconds=i), r.choice(["pending", "parsing", "extracting"]), r.choice([0, 1, None])) for i in range(150)]
    batch, stream = feed("log", rows, "doc_id int, ts timestamp, status string, n_requirements long", parts=5)
    out = run(spark, jobs.stream_progress(stream), "progress_many", tmp_path).where("not timed_out").select("doc_id", "ts", "status", "n_requirements")
    assert {tuple(x) for x in out.collect()} == {tuple(x) for x in ops.progress_changes(batch.fillna(-1, ["n_requirements"]))[0].collect()}


def test_progress_note_after_the_poll_budget(spark, feed, tmp_path):
    rows = [("quiet", T0, "pending", 0), ("ended", T0, "failed", 0), ("busy", T0 + dt.timedelta(minutes=5), "pending", 0), ("busy", T0 + dt.timedelta(minutes=40), "parsing", 0)]
    _, stream = feed("log", rows, "doc_id string, ts timestamp, status string, n_requirements long", parts=4)
    out = run(spark, jobs.stream_progress(stream, 600, "1 minute"), "notes", tmp_path)
    assert [(x.doc_id, x.status) for x in out.where("timed_out").collect()] == [("quiet", "pending")]


@pytest.mark.parametrize("gap", [0, 3600])
def test_window_state_lives_to_the_end_of_its_window(spark, feed, tmp_path, gap):
    """Three events of a window in three micro-batches, other keys' events far ahead within the lateness: still one window."""
    hours = [0, 2, 5, 6]
    rows = [("a", i, T0 + dt.timedelta(hours=h)) for i, h in enumerate(hours)]
    rows = [x for row in rows for x in (row, ("b", row[1], row[2] + dt.timedelta(seconds=gap)))]
    batch, stream = feed("events", rows, "key string, event_id int, ts timestamp", parts=4)
    out = run(spark, jobs.stream_attempt_windows(stream, 6 * 3600, 2, "2 hours"), f"pause{gap}", tmp_path)
    own = sorted((x.ts, x.n, x.over_limit) for x in out.where("key = 'a'").collect())
    assert [(n, over) for _, n, over in own] == [(1, False), (2, False), (3, True), (1, False)]
    whole = {tuple(x) for x in ops.anchored_windows(batch, 6 * 3600, 2).select("key", "window_start", "n").collect()}
    assert {tuple(x) for x in out.groupBy("key", "window_start").agg(F.max("n")).collect()} == whole


def test_late_events(spark, feed, tmp_path):
    """Within the lateness an older event counts into the open window; behind it, it is dropped."""
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", 1, minute(10)), ("a", 2, minute(8)), ("b", 3, minute(60)), ("b", 3, minute(61)), ("a", 4, minute(20)), ("a", 5, minute(61))]
    _, stream = feed("events", rows, "key string, event_id int, ts timestamp", parts=6)
    out = run(spark, jobs.stream_attempt_windows(stream, 3600, 9, "5 minutes"), "late", tmp_path)
    assert sorted((x.window_start, x.ts, x.n) for x in out.where("key = 'a'").collect()) == [(minute(10), minute(8), 2), (minute(10), minute(10), 1), (minute(10), minute(61), 3)]


def test_counts_of_a_warning_outlive_its_interval(spark, feed, tmp_path):
    rows = [("a", i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 4000, 4010, 90_000, 400_000])]
    batch, stream = feed("events", rows, "key string, event_id int, ts timestamp", parts=7)
    out = run(spark, jobs.stream_suppressed_warnings(stream, 60, 200_000, "1 second"), "outlive", tmp_path)
    assert [x.suppressed for x in out.orderBy("ts").collect()] == [0, 2, 1, 0]
    assert {tuple(x) for x in out.collect()} == {tuple(x) for x in ops.suppressed_warnings(batch, 60).collect()}


def test_hot_key(spark, tmp_path):
    """One key with many rows in a batch: several frames, judged and counted as the batch jobs do."""
    n = 60_000
    spark.range(n).selectExpr("id AS request_id", "'u' AS user_id", "'o' AS operation", "'k' AS idempotency_key", "cast(id % 3 AS string) AS request_hash", "timestamp_seconds(1700000000 + (id * 7919) % 50000) AS ts").coalesce(1).write.parquet(f"{tmp_path}/requests")
    schema = spark.read.parquet(f"{tmp_path}/requests").schema
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/requests")
    got = run(spark, jobs.stream_idempotent(stream), "hot_requests", tmp_path)
    wanted = revisions.idempotent_requests(spark.read.parquet(f"{tmp_path}/requests"))
    assert got.count() == n and got.select("request_id", "outcome").exceptAll(wanted.select("request_id", "outcome")).count() == 0
    keyed = lambda d: d.selectExpr("user_id key", "ts", "request_id event_id")
    out = run(spark, jobs.stream_attempt_windows(keyed(stream), 600, 5), "hot_events", tmp_path)
    whole = ops.anchored_windows(keyed(spark.read.parquet(f"{tmp_path}/requests")), 600, 5).select("window_start", "n")
    assert out.count() == n and {tuple(x) for x in out.groupBy("window_start").agg(F.max("n")).collect()} == {tuple(x) for x in whole.collect()}


def test_requirements(spark, feed, tmp_path):
    rows = [("a", "first"), ("b", "other"), ("a", "again"), ("b", None)]
    _, stream = feed("matrix", rows, "rfp_id string, raw_text_content string", parts=2)
    path = f"{tmp_path}/table"
    q = jobs.stream_requirements(stream, lambda df, ids, number: tables.replace_requirements(df, ids, path, ('stream', number)), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert q.exception() is None
    assert [tuple(x) for x in tables.read_requirements(spark, path).select("rfp_id", "raw_text_content").collect()] == [("a", "again")]


def stored(spark, stream, tmp_path):
    """The query's output, and the rows in its state store after each micro-batch."""
    with jobs.rocksdb_state(spark):
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(90) and q.exception() is None
    return spark.read.parquet(f"{tmp_path}/out"), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]


def test_many_keys_of_requests(spark, feed, tmp_path):
    """Keys share the values of the state store: there are no more of these than buckets, however many keys there are."""
    r = random.Random(8)
    log = [(i, r.choice(["u", "v", None]), r.choice(["op", None]), f"k{r.randint(0, 2500)}", r.choice(["x", "y", None]), T0 + dt.timedelta(seconds=i // 3)) for i in range(9000)]
    batch, stream = feed("requests", log, "request_id int, user_id string, operation string, idempotency_key string, request_hash string, ts timestamp")
    got, rows = stored(spark, jobs.stream_idempotent(stream), tmp_path)
    assert max(rows) <= jobs.BUCKETS < batch.select("user_id", "operation", "idempotency_key").distinct().count()
    assert {tuple(x) for x in got.collect()} == {(x.request_id, x.outcome) for x in revisions.idempotent_requests(batch).collect()}


def test_each_key_of_a_bucket_is_kept_for_its_own_time(spark, feed, tmp_path):
    """One bucket: 'a' is cleared at the end of the third batch, 'b' at that of the fifth; the timer goes from the one to the other."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "a", at(0)), (2, "b", at(50)), (3, "a", at(70)), (4, "z", at(80)), (5, "a", at(90)), (6, "b", at(91)), (7, "b", at(140)), (8, "y", at(141)), (9, "b", at(142)), (10, "a", at(143)), (11, "b", at(144)), (12, "a", at(145))]
    log = [(i, "u", "op", k, "h", t) for i, k, t in rows]
    _, stream = feed("requests", log, "request_id int, user_id string, operation string, idempotency_key string, request_hash string, ts timestamp", parts=6)
    got, _ = stored(spark, jobs.stream_idempotent(stream, 60, "1 second", buckets=1), tmp_path)
    assert {x.request_id for x in got.where("outcome = 'new'").collect()} == {1, 2, 4, 8, 10, 11}


def test_many_keys_of_windows(spark, feed, tmp_path):
    """Keys share the values of the state store, null and empty ones too, and each has its own windows."""
    r = random.Random(9)
    keys = [None, "", "=", *(f"k{i}" for i in range(2500))]
    rows = [(r.choice(keys), i, T0 + dt.timedelta(seconds=i // 2)) for i in range(12_000)]
    batch, stream = feed("events", rows, "key string, event_id int, ts timestamp")
    got, values = stored(spark, jobs.stream_attempt_windows(stream, 1800, 3), tmp_path)
    assert max(values) <= jobs.BUCKETS < len(keys)
    wanted, open_ = [], {}
    for k, _, t in rows:
        start, n = open_.get(k, (None, 0))
        if start is None or t >= start + dt.timedelta(seconds=1800):
            start, n = t, 0
        open_[k] = start, n + 1
        wanted.append((k, start, t, n + 1, n + 1 > 3, 1800 - int((t - start).total_seconds())))
    plain = lambda xs: sorted(map(repr, xs))
    assert plain(tuple(x) for x in got.collect()) == plain(wanted)
    warned = run(spark, jobs.stream_suppressed_warnings(stream, 1800, 7200, buckets=2), "many_warnings", tmp_path)
    assert plain(tuple(x) for x in warned.where("key <> ''").collect()) == plain(tuple(x) for x in ops.suppressed_warnings(batch.where("key <> ''"), 1800).collect())
