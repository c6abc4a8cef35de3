"""Telemetry, logs, windows and progress in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions import numbers, vocab
from tenderspark.sources.shared import written

SEGMENT_ROWS, MAX_BROADCAST_KEYS = 200_000, 100_000
LAST = (1 << 63) - 1


def price_table(spark: SparkSession) -> DataFrame:
    """The fixed price list; a handful of rows."""
    return spark.createDataFrame([(m, *p) for m, p in numbers.PRICES.items()], "model string, price_in double, price_out double")


def price_join(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """J-11: usage with its cost; a model that is not listed costs 0 and is not `priced`."""
    x = usage.join(F.broadcast(prices), "model", "left")
    cost = numbers.est_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))
    return x.withColumns({"est_cost": cost, "priced": F.col("price_in").isNotNull()}).drop("price_in", "price_out")


def llm_usage_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """A-13: a row a model and one of totals (model null), whose cost sums the models' rounded costs."""
    own = calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.bround(F.sum("latency_ms") / F.count("*"), 1).alias("avg_latency_ms"),
    )
    models = price_join(own, prices)
    total = models.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "errors", "tokens_in", "tokens_out")), F.bround(F.coalesce(F.sum("est_cost"), F.lit(0.0)), 4).alias("est_cost"))
    return models.unionByName(total, allowMissingColumns=True)


def http_status_rollup(logs: DataFrame) -> DataFrame:
    """A-19."""
    level = F.when(F.col("status") >= 500, "ERROR").when(F.col("status") >= 400, "WARNING").otherwise("INFO")
    return logs.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.bround(F.avg("duration_ms"), 2).alias("mean_ms"), F.max("duration_ms").alias("max_ms"))


def trace(logs: DataFrame, request_id: str) -> DataFrame:
    """A-20: all lines of one request in time order."""
    return logs.where(F.col("request_id") == request_id).orderBy("timestamp")


def progress_changes(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W-13: (status rows that differ from the one before, first completion time of each step)."""
    w = W.partitionBy("doc_id").orderBy("ts", "status")
    snap = F.struct("status", "n_requirements")
    before = F.lag(snap).over(w)
    changed = log.withColumn("_b", before).where(~F.col("_b").eqNullSafe(snap)).drop("_b")
    done = vocab.pipeline_view(F.col("status")).steps
    steps = log.select("doc_id", "ts", F.explode(done).alias("s")).where("s.state = 'completed'").groupBy("doc_id", F.col("s.id").alias("step")).agg(F.min("ts").alias("completed_at"))
    return changed, steps


def anchored_windows(events: DataFrame, seconds: int, limit: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """W-14: key, window_start, n, over_limit. A window begins with a key's first event and does not grow; the next
    event at or after its end begins another. An event with `reset` ends the window and is not counted.

    A key with more than `segment_rows` events is cut into segments of time that tasks walk side by side: each is walked
    from every state in which it may be entered (`walk_all`), the segments' maps are then followed in order, a few
    numbers each (`follow`), and with its entry known each segment counts its windows; those that span segments add up.
    """
    kind, span = dict(events.dtypes)["key"], seconds * 1_000_000
    reset = F.coalesce("reset", F.lit(False)) if "reset" in events.columns else F.lit(False)
    rows = events.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", reset.alias("reset"))
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).where(F.col("n") > segment_rows)
    spans = F.floor((F.col("high") - F.col("low")) / span) + 1
    hot = written(size.select("key", "low", (F.greatest(F.lit(2), F.ceil(spans * segment_rows / F.col("n"))) * span).cast("long").alias("length")), "hot")
    if n_hot := hot.count():
        rows = rows.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot, "key", "left")
        place = F.coalesce(F.expr("(at - low) div length"), F.lit(0)).cast("long")
        rows = rows.withColumn("segment", place).withColumn("begin", F.col("low") + F.col("segment") * F.col("length")).drop("low", "length")
        maps = _in_segments(rows.where("begin IS NOT NULL").select("key", "segment", "begin", "at", "event_id", "reset")).mapInPandas(lambda b: walk_all(b, span), f"key {kind}, segment long, upto long, leaves long, passes boolean")
        entries = maps.repartition("key").sortWithinPartitions("key", "segment", "upto").mapInPandas(lambda b: follow(b, span), f"key {kind}, segment long, entry long")
        rows = rows.drop("begin").join(entries, ["key", "segment"], "left")
    else:
        rows = rows.withColumns({"segment": F.lit(0).cast("long"), "entry": F.lit(None).cast("long")})
    counted = _in_segments(rows.select("key", "segment", "entry", "at", "event_id", "reset")).mapInPandas(lambda b: count_windows(b, span), f"key {kind}, start long, n long")
    windows = counted.groupBy("key", "start").agg(F.sum("n").alias("n"))
    return windows.select("key", F.timestamp_micros("start").cast(events.schema["ts"].dataType).alias("window_start"), "n", (F.col("n") > limit).alias("over_limit"))


def _in_segments(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "at", "event_id")


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, dict[str, np.ndarray]]]:
    """(key, segment) and the columns of its rows, one segment at a time, from frames that are ordered by segment."""
    held: list[pd.DataFrame] = []
    now = None
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.flatnonzero((pdf["segment"].to_numpy()[1:] != pdf["segment"].to_numpy()[:-1]) | (pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1])) + 1
        cuts = [0, *new.tolist(), len(pdf)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[i:j]
            its = [part["key"].iloc[0], int(part["segment"].iloc[0])]
            if held and its != now:
                yield now, _columns(held)
                held = []
            now = its
            held.append(part[[c for c in ("begin", "at", "reset") if c in part]])
    if held:
        yield now, _columns(held)


def _columns(held: list[pd.DataFrame]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([h[c].to_numpy() for h in held]) for c in held[0]}


def walk_all(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """The map of each segment: a window that ends at or before `upto` (and after the row before) when the segment is
    entered `leaves` it with a window of that start open, or none; or it `passes` as it is.

    Where a window that begins with event i is followed by another is one jump, so all walks are one pass backwards.
    """
    for (key, segment), c in _segments(batches):
        at, reset, n = c["at"], c["reset"].astype(bool), len(c["at"])
        resets, counted = np.append(np.flatnonzero(reset), n), np.flatnonzero(~reset)
        ends = np.searchsorted(at, at[counted] + span, "left")
        stops = resets[np.searchsorted(resets, counted, "left")]
        by_reset = stops < ends
        jump = np.searchsorted(counted, np.where(by_reset, stops, ends), "left")  # places in `counted`
        leaves: list[int | None] = [None] * (len(counted) + 1)
        for i in range(len(counted) - 1, -1, -1):
            leaves[i] = leaves[jump[i]] if jump[i] < len(counted) else None if by_reset[i] else int(at[counted[i]])
        first_reset = int(resets[0])
        before = int(np.searchsorted(counted, first_reset, "left"))  # events that a window can begin with before a reset
        possible = int(np.searchsorted(at[counted[:before]], int(c["begin"][0]) + span, "left"))
        rows = [(int(at[counted[i]]), leaves[i], False) for i in range(possible)]
        rows.append((LAST, leaves[possible], False) if possible < before or first_reset < n else (LAST, None, True))
        kept = [r for r, after in zip(rows, [*rows[1:], None], strict=True) if after is None or r[1:] != after[1:]]
        yield pd.DataFrame(
            {"key": pd.Series([key] * len(kept), dtype=object), "segment": segment, "upto": [r[0] for r in kept], "leaves": pd.array([r[1] for r in kept], "Int64"), "passes": [r[2] for r in kept]}
        )


def follow(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """The start of the window that is open when each segment is entered, or null; rows come in order, one is held."""
    key = segment = start = None
    done = True
    for pdf in batches:
        out = []
        for k, s, upto, leaves, passes in zip(pdf["key"].tolist(), pdf["segment"].tolist(), pdf["upto"].tolist(), pdf["leaves"].astype("Int64").tolist(), pdf["passes"].tolist(), strict=True):
            if k != key or key is None:
                key, segment, start = k, None, None
            if s != segment:
                segment, done = s, False
                out.append((k, s, start))
            if not done and (start is None or start + span <= upto):
                done = True
                if not passes:
                    start = None if leaves is pd.NA else int(leaves)
        yield pd.DataFrame({"key": pd.Series([o[0] for o in out], dtype=object), "segment": [o[1] for o in out], "entry": pd.array([o[2] for o in out], "Int64")})


def count_windows(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """Windows of each segment and how many of its events they hold; only the open window is held."""
    columns = ["key", "start", "n"]
    place, start, n = None, None, 0
    for pdf in batches:
        out = []
        entries = pdf["entry"].astype("Int64").tolist()
        for key, segment, entry, at, is_reset in zip(pdf["key"].tolist(), pdf["segment"].tolist(), entries, pdf["at"].tolist(), pdf["reset"].tolist(), strict=True):
            if place is None or place != (key, segment):
                if n:
                    out.append((place[0], start, n))
                place, start, n = (key, segment), None if entry is pd.NA else int(entry), 0
            if start is not None and (is_reset or at >= start + span):
                if n:
                    out.append((key, start, n))
                start, n = None, 0
            if not is_reset:
                start = at if start is None else start
                n += 1
        yield pd.DataFrame(out, columns=columns)
    if n:
        yield pd.DataFrame([(place[0], start, n)], columns=columns)


def suppressed_warnings(events: DataFrame, seconds: int = 60) -> DataFrame:
    """W-15: the first event of each interval, with how many were suppressed since the emission before it."""
    windows = anchored_windows(events, seconds, 0)
    before = F.lag("n").over(W.partitionBy("key").orderBy("window_start"))
    return windows.select("key", F.col("window_start").alias("ts"), F.coalesce(before - 1, F.lit(0)).alias("suppressed"))
