"""Windows of hot keys, cut into segments, against a plain walk."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tenderspark.operators import ops

T0 = dt.datetime(2024, 1, 1)


def plain(rows, seconds):
    out = {}
    for key in {r[0] for r in rows}:
        start, n = None, 0
        for _, at, _, reset in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if start is not None and (reset or at >= start + dt.timedelta(seconds=seconds)):
                start = None
            if not reset:
                start = at if start is None else start
                out[key, start] = out.get((key, start), 0) + 1
    return out


def result(df):
    rows = df.collect()
    out = {(r.key, r.window_start): r.n for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_segments_against_a_plain_walk(spark, seed):
    r = random.Random(seed)
    density, resets = r.choice([0.2, 1, 5]), r.choice([0, 0.02, 0.2])
    rows = [(r.choice("aab"), T0 + dt.timedelta(seconds=r.randint(0, int(1500 / density))), i, r.random() < resets) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id int, reset boolean")
    wanted = plain(rows, 60)
    for size in (10, 100, 10_000):
        assert result(ops.anchored_windows(df, 60, 3, size)) == wanted


def test_quiet_stretches_and_resets_alone(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", at(s), i, False) for i, s in enumerate([0, 1, 2, 59, 60, 61, 3000, 3001, 9000, 9059, 9060])] + [("a", at(9030), 50, True), ("a", at(5000), 51, True), ("a", at(0), 52, True)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id int, reset boolean")
    for size in (1, 2, 3, 5):
        assert result(ops.anchored_windows(df, 60, 3, size)) == plain(rows, 60)


def test_numbers_as_keys_and_null_keys(spark):
    rows = [(k, T0 + dt.timedelta(seconds=i), i) for i in range(300) for k in (1, None)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, event_id int")
    for size in (50, 10_000):
        found = ops.anchored_windows(df, 7, 3, size).where("key = 1").collect()
        assert len(found) == 43 and sum(x.n for x in found) == 300 and all(x.over_limit for x in found)


def test_one_key_is_dealt_over_tasks(spark):
    """All events have one key: segments hold like numbers of rows, whatever the task."""
    df = spark.range(40_000).select(F.lit("k").alias("key"), F.timestamp_micros(F.col("id") * 750_000).alias("ts"), F.col("id").alias("event_id"))
    sizes = []
    inside = ops._in_segments

    def watched(rows):
        sizes.append([x["count"] for x in rows.groupBy("key", "segment").count().collect()])
        return inside(rows)

    ops._in_segments = watched
    try:
        many = result(ops.anchored_windows(df, 60, 3, 1000))
    finally:
        ops._in_segments = inside
    assert many == result(ops.anchored_windows(df, 60, 3, 1_000_000)) and sum(many.values()) == 40_000
    for found in sizes:
        assert len(found) >= 30 and max(found) <= 2 * statistics.median(found)
