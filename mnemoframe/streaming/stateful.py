"""Stateful processors: flushes by count or idle time, and a ledger of inputs that may be retried.

State is kept per session, or per (tenant, input hash), in the RocksDB state store; timers
are in event time.  A micro-batch that is repeated starts from the state before it, so
its output is the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemoframe.functions import fixed_values as fv

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """For queries started within: the state store that timers and typed state need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Flusher(StatefulProcessor):
    """Messages of a session wait until the watermark has passed them, then join the open flush in order.

    State: messages that wait, in the key's list; the open flush (fewer than ``size``
    messages), its last time and number.  One timer is set, for the earliest thing that can
    happen: a waiting message passes, or the open flush becomes idle.
    """

    def __init__(self, size: int, idle_ms: int):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, turn_number long, line string")
        self.open = handle.getValueState("open", "lines array<string>, last long, number long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self.waiting.appendList([(r["at"], r["turn_number"], r["line"]) for r in rows])
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key: Any, watermark: int, fired: int | None = None) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else ([], 0, 0, None)
        lines, last, number, timer = list(held[0]), held[1], held[2], held[3]
        waiting = sorted(tuple(m) for m in self.waiting.get())
        passed = [m for m in waiting if m[0] <= watermark]
        later = waiting[len(passed):]
        out = []

        def flush(cause: str) -> None:
            nonlocal lines, number
            out.append(Row(session_id=key[0], batch=number, messages=len(lines), cause=cause, text="\n".join(lines)))
            lines, number = [], number + 1

        for at, _, line in passed:
            if lines and at - last >= self.idle_ms:
                flush("idle")
            lines.append(line)
            last = at
            if len(lines) >= self.size:
                flush("count")
        if lines and last + self.idle_ms <= watermark:
            flush("idle")
        if passed:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        ahead = [later[0][0]] if later else []
        if lines:
            ahead.append(last + self.idle_ms)
        wanted = min(ahead) if ahead else None
        if timer is not None and timer != wanted and timer != fired:
            self.handle.deleteTimer(timer)
        if wanted is not None and (wanted != timer or wanted == fired):
            self.handle.registerTimer(wanted)
        self.open.update((lines, last, number, wanted))
        return iter(out)

    def close(self) -> None:
        pass


def flushes(stream: DataFrame, ts: str = "created_at", size: int = fv.FLUSH_MESSAGES,
            idle_seconds: int = fv.FLUSH_IDLE_SECONDS, delay: str = "1 hour") -> DataFrame:
    """``session_id, batch, messages, cause, text``: a flush for every ``size`` messages since the last one,
    or earlier when no message has come for ``idle_seconds``.

    Times are event times: messages are taken in their order (then by turn) once the watermark
    has passed them, so the result does not depend on how they arrive within ``delay``; later ones are dropped.
    A session's open flush holds fewer than ``size`` messages; what waits is what came within
    ``delay``.  Start the query within ``state_store``.
    """
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).select(
        "session_id", ts, F.unix_millis(ts).alias("at"), F.col("turn_number").cast("long").alias("turn_number"),
        F.concat("role", F.lit(": "), "content").alias("line"))
    kind = stream.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").transformWithState(
        statefulProcessor=_Flusher(size, idle_seconds * 1000),
        outputStructType=f"session_id {kind}, batch long, messages long, cause string, text string",
        outputMode="Append", timeMode="EventTime")


class _Ledger(StatefulProcessor):
    """Status of an input: free, processing or completed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string, attempt long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        if initialState["status"] != "failed":
            self.status.update((initialState["status"], 0))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, attempt = self.status.get() if self.status.exists() else ("free", 0)
        out = []
        for row in sorted(rows, key=lambda r: (r["ts"], r["kind"] == "input")):
            if row["kind"] == "input":
                if status == "free":
                    status, attempt = "processing", attempt + 1
                    out.append(Row(tenant_id=key[0], input_hash=key[1], ts=row["ts"], attempt=attempt))
            elif status == "processing" and row["kind"] in ("failed", "completed"):
                status = "free" if row["kind"] == "failed" else "completed"
        self.status.update((status, attempt))
        return iter(out)

    def close(self) -> None:
        pass


def accepted_inputs(stream: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``tenant_id, input_hash, ts, attempt``: inputs to process, in a stream of inputs and outcomes.

    ``stream`` holds ``tenant_id, input_hash, ts, kind``: ``input``, or the outcome of processing,
    ``failed`` or ``completed``.  An input is taken if its hash is free; it is taken back by a failure, closed by
    a success, and repeats in between are dropped, in one micro-batch or across many.  At
    equal times an outcome comes before an input.  ``ledger`` (``tenant_id, input_hash, status``) is the
    state to start from: its failed inputs are free.  Start the query within ``state_store``.
    """
    keys = ["tenant_id", "input_hash"]
    start = None if ledger is None else ledger.select(*keys, "status").dropDuplicates(keys).groupBy(*keys)
    return stream.select(*keys, F.col("ts").cast("timestamp").alias("ts"), "kind").groupBy(*keys).transformWithState(
        statefulProcessor=_Ledger(), outputStructType="tenant_id string, input_hash string, ts timestamp, attempt long",
        outputMode="Append", timeMode="None", initialState=start)
