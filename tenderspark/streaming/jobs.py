"""Structured Streaming twins of the batch jobs in `operators.ops` and `operators.revisions`.

Sources are streaming DataFrames of the caller. Keyed state is small (a window's start and count, a hash, the last
status) and is cleared by event-time timers, when the watermark passes the time up to which it can matter: never by the
clock of the machines, so a pause of any length between micro-batches changes nothing.

Late rows: the engine drops rows older than the watermark (`late` behind the newest row) that held in the micro-batch
before. A row that is older than its key's newest but not late takes part as if it came now.

T-02, T-04 and T-06 deal their keys over `buckets`, and the state of a bucket is one value: a call to the state store for each
key, of which most have a row or two in a micro-batch, was nearly all of their time. A micro-batch reads and writes the
buckets that it touches, so more buckets suit more keys and smaller micro-batches. Their number is part of a checkpoint.

The keyed jobs need a state store with column families: run their queries within `rocksdb_state(spark)`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tenderspark.functions import text, vocab
from tenderspark.operators.revisions import KEY_CHARS

TERMINAL = ("completed", "failed")
POLL_SECONDS = 600
KEEP_SECONDS = 86_400
OUT_ROWS = 10_000  # rows of a frame that a keyed job yields at once
BUCKETS = 1024
HELD_ROWS = 50_000  # rows of a bucket that wait in memory for their keys' first ones; more wait in the state store
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stream_llm_usage(calls: DataFrame) -> DataFrame:
    """T-01: running counters a model (complete or update mode)."""
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), F.sum("latency_ms").alias("latency_ms"),
    )


def stream_llm_usage_windows(calls: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """T-01 by event time: counters a model and tumbling window, final once the watermark has passed (append mode)."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("window"), "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


class _Timed(StatefulProcessor):
    """State that one event-time timer clears. `state` is the schema of its value."""

    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.state)

    def until(self, micros: int, before: int | None = None) -> None:
        """Keep the state until the watermark passes `micros`; `before` is the time set earlier."""
        if before is not None:
            self.handle.deleteTimer(-(-before // 1000))
        self.handle.registerTimer(-(-micros // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.value.clear()
        return iter([])

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, keys: list[str], late: str, processor: StatefulProcessor, out: str) -> DataFrame:
    """Rows with `at`, the microseconds of ts, to the processor of their key."""
    timed = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


class _Bucket(StatefulProcessor):
    """State of the keys of a bucket: a row a key, with its `id` and `until`, the milliseconds that the watermark must pass
    to clear it. The bucket's timer is set to the earliest, `due`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", "rows binary, due long")

    def load(self) -> tuple[pa.Table | None, int | None]:
        if not self.value.exists():
            return None, None
        rows, due = self.value.get()
        return _unpacked(rows), due

    def save(self, rows: pa.Table, before: int | None) -> None:
        """`before` is the time to which the timer is set."""
        due = pc.min(rows["until"]).as_py()
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        self.value.update((_packed(rows), due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        rows, _ = self.load()
        kept = rows.filter(pc.greater(rows["until"], max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())))
        if len(kept):
            self.save(kept, None)
        else:
            self.value.clear()
        return iter([])

    def close(self) -> None:
        pass


def _bucketed(df: DataFrame, late: str, buckets: int, processor: _Bucket, out: str) -> DataFrame:
    """Rows with an `id`, and `at`, the microseconds of ts, to the processor of their bucket."""
    timed = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).groupBy("bucket").transformWithStateInPandas(processor, out, "Append", "EventTime")


class _Windows(_Bucket):
    """State: start and count of a key's last window, for `lives` from its start."""

    def __init__(self, micros: int, lives: int | None = None):
        self.micros, self.lives = micros, lives or micros

    def windows(self, frames: Iterator[pd.DataFrame]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bucket's ids, and its rows in order of id and time: numbers of the ids, times, the windows that the rows fall
        into (four rows of an array: their first row, their start, events counted before, and the count of the window before
        or -1 where the window was open), the number of each row's window and its count there. Two numbers a row are held,
        not the rows."""
        known, due = self.load()
        ids = known["id"].to_pylist() if known else []
        numbers, held = {x: i for i, x in enumerate(ids)}, []
        for f in frames:
            own, found = pd.factorize(f["id"])
            held.append((np.array([numbers.setdefault(x, len(numbers)) for x in found])[own], f["at"].to_numpy()))
        code, at = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.lexsort((at, code))
        code, at = code[order], at[order]
        old, ids = len(ids), list(numbers)
        starts, counts = ([*known[c].to_pylist()] if known else [] for c in ("start", "n"))
        firsts = np.flatnonzero(np.diff(code, prepend=-1))
        found = []
        for a, b, c in zip(firsts.tolist(), [*firsts[1:].tolist(), len(at)], code[firsts].tolist(), strict=True):
            mine, i, last = at[a:b], 0, 0
            if c < old:
                last = counts[c]
                if i := int(np.searchsorted(mine, starts[c] + self.micros)):
                    found.append((a, starts[c], last, -1))
                    last += i
            after = np.searchsorted(mine, mine + self.micros).tolist() if i < len(mine) else []  # where the window of a row that opens one ends
            while i < len(mine):
                found.append((a + i, int(mine[i]), 0, last))
                i, last = after[i], after[i] - i
        windows = np.array(found, np.int64).T
        place, opened, before, _ = windows
        of = np.repeat(np.arange(len(place)), np.diff(place, append=len(at)))
        n = before[of] + np.arange(len(at)) - place[of] + 1
        ends = np.append(firsts[1:], len(at)) - 1
        start, count = (np.concatenate([np.array(x, np.int64), np.zeros(len(ids) - old, np.int64)]) for x in (starts, counts))
        start[code[ends]], count[code[ends]] = opened[of[ends]], n[ends]
        self.save(pa.table({"id": pa.array(ids, pa.string()), "start": start, "n": count, "until": -(-(start + self.lives) // 1000)}), due)
        return ids, code, at, windows, of, n


class _Attempts(_Windows):
    def __init__(self, micros: int, limit: int):
        super().__init__(micros)
        self.limit = limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        ids, code, at, windows, of, n = self.windows(rows)
        names, start = np.array(ids, object), windows[1][of]
        left = np.maximum(1, -((at - start - self.micros) // 1_000_000))
        for k in range(0, len(at), OUT_ROWS):
            part = slice(k, k + OUT_ROWS)
            yield pd.DataFrame({"id": names[code[part]], "start": start[part], "at": at[part], "n": n[part], "over_limit": n[part] > self.limit, "seconds_left": left[part]})


class _Warnings(_Windows):
    """The count of a window is reported by the next one, so it outlives its window."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        ids, code, _, windows, _, _ = self.windows(rows)
        place, start, _, last = windows[:, windows[3] >= 0]
        yield pd.DataFrame({"id": np.array(ids, object)[code[place]], "at": start, "suppressed": np.maximum(last - 1, 0)})


def _named(key: Column) -> Column:
    """The id of a key, never null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def _key(kind: str) -> Column:
    return F.when(F.col("id") != "", F.expr("substring(id, 2)")).cast(kind).alias("key")


def stream_attempt_windows(events: DataFrame, seconds: int, limit: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """T-02: each event (key, ts) with the count of its key's window, which begins with its first event, does not grow, and
    ends after `seconds` of event time; equal to W-14 when micro-batches bring events in time order. An event older than
    the open window's start counts into that window."""
    out = _bucketed(events.select(_named(F.col("key")).alias("id"), "ts"), late, buckets, _Attempts(seconds * 1_000_000, limit), "id string, start long, at long, n long, over_limit boolean, seconds_left long")
    return out.select(_key(dict(events.dtypes)["key"]), F.timestamp_micros("start").alias("window_start"), F.timestamp_micros("at").alias("ts"), "n", "over_limit", "seconds_left")


def stream_suppressed_warnings(events: DataFrame, seconds: int = 60, keep_seconds: int = KEEP_SECONDS, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """T-06: the first event of each interval with the count suppressed since the emission before it; a count waits up to
    `keep_seconds` of event time for the emission that reports it, then it is dropped."""
    lives = max(keep_seconds, seconds) * 1_000_000
    out = _bucketed(events.select(_named(F.col("key")).alias("id"), "ts"), late, buckets, _Warnings(seconds * 1_000_000, lives), "id string, at long, suppressed long")
    return out.select(_key(dict(events.dtypes)["key"]), F.timestamp_micros("at").alias("ts"), "suppressed")


class _Progress(_Timed):
    state = "status string, n long, done boolean, seen long"

    def __init__(self, micros: int):
        self.micros = micros

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        names: list[str] = []
        codes: dict[str | None, int] = {}
        held = []
        for f in rows:  # times, codes of states and numbers: three numbers a row
            for s in f["status"].unique():
                if s not in codes:
                    codes[s] = len(names)
                    names.append(s)
            held.append((f["at"].to_numpy(), f["status"].map(codes).to_numpy(), f["n_requirements"].fillna(-1).to_numpy(np.int64)))
        at, status, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        rank = np.argsort(np.argsort(np.array([x or "" for x in names])))
        order = np.lexsort((rank[status], at))
        at, status, n = at[order], status[order], n[order]
        last = self.value.get() if self.value.exists() else None
        changed = np.concatenate([[True], (status[1:] != status[:-1]) | (n[1:] != n[:-1])])
        if last is not None:
            changed[0] = (names[status[0]], int(n[0])) != (last[0], last[1])
        ends = np.flatnonzero(changed & np.isin(status, [codes[s] for s in TERMINAL if s in codes]))
        closed = last is not None and last[2]
        if closed or len(ends):
            changed[0 if closed else ends[0] + 1 :] = False  # nothing follows the first terminal state
        hits = np.flatnonzero(changed)
        for k in range(0, len(hits), OUT_ROWS):
            part = hits[k : k + OUT_ROWS]
            yield pd.DataFrame({"doc_id": [key[0]] * len(part), "at": at[part], "status": [names[c] for c in status[part]], "n_requirements": pd.array(n[part]).astype("Int64"), "timed_out": False})
        final = (names[status[hits[-1]]], int(n[hits[-1]]), closed or bool(len(ends))) if len(hits) else tuple(last[:3])
        seen = max(int(at[-1]), last[3] if last else int(at[-1]))
        self.value.update((*final, seen))
        if last is None or seen != last[3]:
            self.until(seen + self.micros, None if last is None else last[3] + self.micros)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        status, n, done, _ = self.value.get()
        self.value.clear()
        if not done:
            yield pd.DataFrame({"doc_id": [key[0]], "at": pd.array([None], "Int64"), "status": [status], "n_requirements": pd.array([n], "Int64"), "timed_out": True})


def stream_progress(log: DataFrame, poll_seconds: int = POLL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """T-03: a document's view when it changes, up to a terminal state; a note when the watermark is `poll_seconds` past
    its newest row and it has not ended. After either the document is forgotten, and a later row begins anew. A null number
    of requirements reads as -1."""
    kind = dict(log.dtypes)["doc_id"]
    out = _keyed(log.select("doc_id", "ts", "status", "n_requirements"), ["doc_id"], late, _Progress(poll_seconds * 1_000_000), f"doc_id {kind}, at long, status string, n_requirements long, timed_out boolean")
    return out.select("doc_id", F.timestamp_micros("at").alias("ts"), "status", "n_requirements", "timed_out").withColumn("view", vocab.pipeline_view(F.col("status")))


class _Requests(_Bucket):
    """State: the first hash of a key."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "rows binary")

    @staticmethod
    def judged(f: pd.DataFrame, hashes: np.ndarray, new: np.ndarray | bool = False) -> pd.DataFrame:
        same = f["request_hash"].notna().to_numpy() & (f["request_hash"].to_numpy(object) == hashes)
        return pd.DataFrame({"request_id": f["request_id"].to_numpy(), "outcome": np.where(new, "new", np.where(same, "replay", "conflict"))})

    @staticmethod
    def earliest(f: pd.DataFrame) -> pd.DataFrame:
        return f.sort_values(["at", "request_id"]).drop_duplicates("id")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        known, due = self.load()
        ids = pd.Index(known["id"].to_pylist() if known else [], dtype=object)
        hashes = np.array(known["hash"].to_pylist() if known else [], object)
        # Keys that are new in this batch: their earliest rows are known at its end, so their other rows wait.
        first, held, n, stored = None, [], 0, False
        for f in rows:
            f = f[["id", "at", "request_id", "request_hash"]]
            at = ids.get_indexer(f["id"])
            if (at >= 0).any():
                yield self.judged(f[at >= 0], hashes[at[at >= 0]])
                f = f[at < 0]
            if len(f):
                first = self.earliest(f if first is None else pd.concat([first, f]))
                held.append(f)
                n += len(f)
            if n > HELD_ROWS:
                self.waiting.appendList([(_packed(pa.Table.from_pandas(x, preserve_index=False)),) for x in held])
                held, n, stored = [], 0, True
        if first is None:
            return
        index, best, chosen = pd.Index(first["id"], dtype=object), first["request_hash"].to_numpy(object), first["request_id"].to_numpy()
        until = first["at"].fillna(timerValues.getCurrentWatermarkInMs() * 1000).to_numpy(np.int64) + self.keep
        added = pa.table({"id": pa.array(first["id"], pa.string()), "hash": pa.array(best, pa.string(), from_pandas=True), "until": -(-until // 1000)})
        self.save(pa.concat_tables([known, added]) if known else added, due)
        if stored:
            for (x,) in self.waiting.get():
                yield from self.firsts(_unpacked(x).to_pandas(), index, best, chosen)
            self.waiting.clear()
        for f in held:
            yield from self.firsts(f, index, best, chosen)

    def firsts(self, f: pd.DataFrame, index: pd.Index, hashes: np.ndarray, chosen: np.ndarray) -> Iterator[pd.DataFrame]:
        at = index.get_indexer(f["id"])
        yield self.judged(f, hashes[at], f["request_id"].to_numpy() == chosen[at])


def stream_idempotent(requests: DataFrame, keep_seconds: int = KEEP_SECONDS, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """T-04: outcome of each request, as D-11 has it: new, replay, conflict or invalid. The first hash of a key is kept
    for `keep_seconds` of event time. Requests without a key, or with a blank or overlong one, need no state and so make
    no hot group. request_id identifies a request."""
    kind, key = dict(requests.dtypes)["request_id"], F.col("idempotency_key")
    bad = F.coalesce((text.strip(key) == "") | (F.length(key) > KEY_CHARS), F.lit(False))
    stateless = requests.where(key.isNull() | bad).select("request_id", F.when(bad, "invalid").otherwise("new").alias("outcome"))
    whole = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in ("user_id", "operation", "idempotency_key"))), {"ignoreNullFields": "false"})
    keyed = requests.where(key.isNotNull() & ~bad).select(whole.alias("id"), "ts", "request_id", F.col("request_hash").cast("string").alias("request_hash"))
    judged = _bucketed(keyed, late, buckets, _Requests(keep_seconds * 1_000_000), f"request_id {kind}, outcome string")
    return judged.unionByName(stateless)


def stream_requirements(matrices: DataFrame, replace: Callable[[DataFrame, DataFrame, int], object], checkpoint: str) -> StreamingQuery:
    """T-05: each micro-batch of extracted rows replaces the matrices of its documents. `replace` takes the rows, the touched
    ids and the number of the batch, so that a batch that is run again after a failure can be told."""

    def batch(df: DataFrame, number: int) -> None:
        replace(df.where("raw_text_content IS NOT NULL"), df.select("rfp_id"), number)

    return matrices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
