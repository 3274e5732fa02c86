"""The ingest state machine, leases and event logs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from marginalia.operators.ingest import is_legal

LEAST_MINUTES, KEEP_MS = 10, 7 * 86_400_000
STATE, OUT = "status string", "job string, seq bigint, before string, after string, legal boolean"


def state_machine(events: DataFrame) -> DataFrame:
    """job, seq, before, after, legal for a stream of (job, seq, status): an illegal change is told and not taken."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            fine = status is None or is_legal(status, r.status)
            rows.append((key[0], r.seq, status, r.status, fine))
            status = r.status if fine else status
        state.update((status,))
        yield pd.DataFrame(rows, columns=["job", "seq", "before", "after", "legal"])

    return events.select("job", "seq", "status").groupBy("job").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def heartbeat_seconds(minutes: int = 120, wanted: int = 30) -> int:
    """How often a holder renews: at most a third of the lease, and no oftener than every five seconds."""
    return max(5, min(wanted, max(minutes, LEAST_MINUTES) * 60 // 3))


class Leases(StatefulProcessor):
    """One holder a job, until it releases or its time is up; then a timer tells so."""

    def __init__(self, lease_ms: int) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the timer clears a lease that ran out; state outlives it by KEEP_MS, so that a stream that stood still for long can still tell
        self.held = handle.getValueState("held", "holder string, until bigint", self.lease_ms + KEEP_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        holder, until = before = self.held.get() if self.held.exists() else (None, 0)
        out = []
        for pdf in rows:
            for worker, action in zip(pdf["worker"], pdf["action"]):
                if holder is not None and until <= now:
                    out.append((key[0], holder, "expire", True))
                    holder, until = None, 0
                fine = holder in (None, worker) if action == "acquire" else holder == worker
                if fine:
                    holder, until = (None, 0) if action == "release" else (worker, now + self.lease_ms)
                out.append((key[0], worker, action, bool(fine)))
        self._hold(before, (holder, until))
        yield pd.DataFrame(out, columns=LEASE_COLUMNS)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.held.exists() and self.held.get()[1] <= at:
            holder = self.held.get()[0]
            self.held.clear()
            yield pd.DataFrame([(key[0], holder, "expire", True)], columns=LEASE_COLUMNS)
        else:
            yield pd.DataFrame([], columns=LEASE_COLUMNS)

    def _hold(self, before: tuple, after: tuple) -> None:
        if after == tuple(before):
            return
        if before[1]:
            self.handle.deleteTimer(before[1])
        if after[0] is None:
            self.held.clear()
        else:
            self.held.update(after)
            self.handle.registerTimer(after[1])


LEASE_COLUMNS = ["job", "worker", "action", "granted"]
SESSION_COLUMNS = ["session_id", "step", "type", "content"]


def leases(requests: DataFrame, minutes: int = 120, lease_ms: int | None = None) -> DataFrame:
    """job, worker, action, granted for a stream of (job, worker, action: acquire, renew or release), and a row of action expire where a lease ran out.

    lease_ms: the lease exactly, where minutes (LEAST_MINUTES at least) do not say it. Needs the RocksDB state store.
    """
    ms = max(minutes, LEAST_MINUTES) * 60_000 if lease_ms is None else lease_ms
    return requests.select("job", "worker", "action").groupBy("job").transformWithStateInPandas(Leases(ms), "job string, worker string, action string, granted boolean", "Append", "ProcessingTime")


class Sessions(StatefulProcessor):
    """Passes a session's events in order of step, each step once, until its time is up."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, until bigint, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.seen.exists():
            last, until, ended = self.seen.get()
        else:
            last, until, ended = -1, now + self.limit_ms, False
            self.handle.registerTimer(until)
        events = pd.concat(list(rows)).sort_values("step")
        out = []
        for step, kind, content in zip(events["step"], events["type"], events["content"]):
            if not ended and until > now and step > last:
                out.append((key[0], int(step), kind, content))
                last, ended = int(step), kind == FINAL
        self.seen.update((last, until, ended))
        yield pd.DataFrame(out, columns=SESSION_COLUMNS)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.seen.exists():
            last, until, ended = self.seen.get()
            if not ended:
                out.append((key[0], last + 1, TIMEOUT, None))
            self.seen.update((last, until, True))
        yield pd.DataFrame(out, columns=SESSION_COLUMNS)


#: The event that ends a session, and the one that says that its time was up.
FINAL, TIMEOUT, SESSION_SECONDS = "FINAL", "TIMEOUT", 600


def sessions(events: DataFrame, limit_ms: int = SESSION_SECONDS * 1000) -> DataFrame:
    """A stream of (session_id, step, type, content): each session's events in order within a batch, none told twice, none after FINAL, and a TIMEOUT row when the session
    has lasted limit_ms without FINAL. Needs the RocksDB state store."""
    told = events.select("session_id", F.col("step").cast("long").alias("step"), "type", "content")
    return told.groupBy("session_id").transformWithStateInPandas(Sessions(limit_ms), "session_id string, step bigint, type string, content string", "Append", "ProcessingTime")


def push(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Sends micro-batches of (session_id, step, type, content), in order within a session, to a sink."""
    writer = events.writeStream.foreachBatch(lambda df, n: sink(df.sortWithinPartitions("session_id", "step"), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def embed_missing(rows: DataFrame, embed) -> DataFrame:
    """Rows of a stream that have no vector yet, with one."""
    return rows.filter(F.col("embedding").isNull()).withColumn("embedding", embed)


def recovery_sweep(jobs_reader: Callable[[], DataFrame], dispatch: Callable[[DataFrame], None], rate: DataFrame, checkpoint: str):
    """Reads the jobs table at each tick of a rate stream, and dispatches what can be recovered."""
    return rate.writeStream.foreachBatch(lambda _, n: dispatch(jobs_reader())).trigger(processingTime="60 seconds").option("checkpointLocation", checkpoint).start()
