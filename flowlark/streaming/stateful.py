"""Keyed state and timers: ack timeouts, delayed release, credit, dedup and workflows.

Processors keep their state in the RocksDB store, so a lost executor resumes
from the last committed batch.  Timers fire at or after their deadline.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.workflow import ACTIONS, Instance

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"

OFFERS = "consumer_id long, seq long, at_ms long, reason string"


class AckTimeouts(StatefulProcessor):
    """Rows of ``consumer_id, seq, kind, at_ms, wait_ms, delay_ms``: delivered, ack, nack, term.

    Emits an offer when a delivery is not acked in time (timeout), or when
    a nack's delay is over (nack).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "seq long", "due long, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for part in rows:
            for r in part.sort_values("at_ms").itertuples():
                seq = (int(r.seq),)
                if r.kind == "delivered":
                    if not self.pending.containsKey(seq):
                        self._arm(seq, int(r.at_ms + r.wait_ms), "timeout")
                elif r.kind in ("ack", "term"):
                    if self.pending.containsKey(seq):
                        self.pending.removeKey(seq)
                elif r.kind == "nack" and self.pending.containsKey(seq):
                    due = int(r.at_ms + (0 if pd.isna(r.delay_ms) else r.delay_ms))
                    if due <= now:
                        self.pending.removeKey(seq)
                        out.append((key[0], seq[0], now, "nack"))
                    else:
                        self._arm(seq, due, "nack")
        yield _offers(out)

    def _arm(self, seq: tuple[int], due: int, reason: str) -> None:
        self.pending.updateValue(seq, (due, reason))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        ripe = [(seq, value) for seq, value in self.pending.iterator() if value[0] <= now]
        for seq, (_, reason) in ripe:
            self.pending.removeKey(seq)
            out.append((key[0], seq[0], now, reason))
        yield _offers(out)

    def close(self) -> None:
        pass


def _offers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["consumer_id", "seq", "at_ms", "reason"]).astype({"consumer_id": "int64", "seq": "int64", "at_ms": "int64"})


def ack_timeouts(events: DataFrame) -> DataFrame:
    """Redeliveries that a stream of deliveries and acks asks for."""
    return events.groupBy("consumer_id").transformWithStateInPandas(AckTimeouts(), OFFERS, "append", "processingTime")


class DelayedRelease(StatefulProcessor):
    """Holds rows of ``stream, offset, deliver_at, payload`` until they are due, in order of (deliver_at, offset)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "due long, position long", "payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for part in rows:
            for r in part.itertuples():
                self.held.updateValue((int(r.deliver_at), int(r.offset)), (r.payload,))
                if r.deliver_at > now:
                    self.handle.registerTimer(int(r.deliver_at))
        yield self._due(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._due(key, expiredTimerInfo.getExpiryTimeInMs())

    def _due(self, key, now: int) -> pd.DataFrame:
        ripe = sorted((k, v[0]) for k, v in self.held.iterator() if k[0] <= now)
        for k, _ in ripe:
            self.held.removeKey(k)
        rows = [(key[0], k[1], k[0], v) for k, v in ripe]
        return pd.DataFrame(rows, columns=["stream", "offset", "deliver_at", "payload"]).astype({"offset": "int64", "deliver_at": "int64"})

    def close(self) -> None:
        pass


def delayed_release(rows: DataFrame) -> DataFrame:
    """Delayed messages as they fall due."""
    return rows.groupBy("stream").transformWithStateInPandas(
        DelayedRelease(), "stream string, offset long, deliver_at long, payload string", "append", "processingTime"
    )


class FirstSight(StatefulProcessor):
    """Accepts the first row of an id, and then the first at least a window after the last accepted."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.sort_values(["ts_ms", "seq"])
            keep = []
            for at in part["ts_ms"]:
                last = self.last.get() if self.last.exists() else None
                fresh = not key[1] or last is None or at >= last[0] + self.window_ms
                if fresh:
                    self.last.update((int(at),))
                keep.append(fresh)
            yield part.loc[keep, ["stream", "msg_id", "seq", "ts_ms"]]

    def close(self) -> None:
        pass


def first_sight(rows: DataFrame, window_ms: int) -> DataFrame:
    """Accepted rows of ``stream, msg_id, seq, ts_ms`` by the window that does not slide."""
    return rows.groupBy("stream", "msg_id").transformWithStateInPandas(
        FirstSight(window_ms), "stream string, msg_id string, seq long, ts_ms long", "append", "none"
    )


class Credit(StatefulProcessor):
    """A consumer's deliveries under its credit, from rows of offers and acks.

    Rows are ``consumer_id, seq, kind, subject, limit, max_inflight, at_ms``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "seq long", "subject string, cap long")
        self.pending = handle.getMapState("pending", "seq long", "subject string, cap long")
        self.most = handle.getValueState("most", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for part in rows:
            for r in part.sort_values("at_ms").itertuples():
                seq = (int(r.seq),)
                if r.kind == "offer":
                    if not pd.isna(r.max_inflight):
                        self.most.update((int(r.max_inflight),))
                    if not self.pending.containsKey(seq):
                        self.waiting.updateValue(seq, (r.subject, -1 if pd.isna(r.limit) else int(r.limit)))
                elif self.pending.containsKey(seq):
                    if r.kind == "nack":
                        self.waiting.updateValue(seq, self.pending.getValue(seq))
                    self.pending.removeKey(seq)
                out += [(key[0], s, int(r.at_ms)) for s in self._deliver()]
        yield pd.DataFrame(out, columns=["consumer_id", "seq", "at_ms"]).astype("int64")

    def _deliver(self) -> list[int]:
        most = self.most.get()[0] if self.most.exists() else 0
        held: dict[str, int] = {}
        for _, (subject, _cap) in self.pending.iterator():
            held[subject] = held.get(subject, 0) + 1
        total, out = sum(held.values()), []
        for seq, (subject, cap) in sorted(self.waiting.iterator()):
            if most and total >= most:
                break
            if cap >= 0 and held.get(subject, 0) >= cap:
                continue
            self.waiting.removeKey(seq)
            self.pending.updateValue(seq, (subject, cap))
            held[subject], total = held.get(subject, 0) + 1, total + 1
            out.append(seq[0])
        return out

    def close(self) -> None:
        pass


def credit(events: DataFrame) -> DataFrame:
    """Deliveries under credit."""
    return events.groupBy("consumer_id").transformWithStateInPandas(Credit(), "consumer_id long, seq long, at_ms long", "append", "none")


class Workflow(StatefulProcessor):
    """The workflow machine over a stream of events; its state is one JSON value for each instance."""

    def __init__(self, steps: int, max_retries: int = 3):
        self.steps, self.max_retries = steps, max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        one = Instance(key[0], self.steps, self.max_retries)
        if self.state.exists():
            held = json.loads(self.state.get()[0])
            one.parked, one.finished, one.seen = held["parked"], held["finished"], set(held["seen"])
        out = []
        for part in rows:
            for r in part.sort_values("position").itertuples():
                step = 0 if pd.isna(r.step) else int(r.step)
                attempt = 0 if pd.isna(r.attempt) else int(r.attempt)
                out += [(key[0], int(r.position), *a) for a in one.on(r.kind, step, attempt, r.context)]
        self.state.update((json.dumps({"parked": one.parked, "finished": one.finished, "seen": sorted(one.seen)}),))
        yield pd.DataFrame(out, columns=["instance_id", "position", "kind", "step", "attempt", "message_id", "context"]).astype(
            {"position": "int64", "step": "int32", "attempt": "int32"}
        )

    def close(self) -> None:
        pass


def workflow(events: DataFrame, steps: int, max_retries: int = 3) -> DataFrame:
    """Actions of workflows as their events arrive."""
    return events.groupBy("instance_id").transformWithStateInPandas(Workflow(steps, max_retries), ACTIONS, "append", "none")


class StalledConnections(StatefulProcessor):
    """Retires a connection that has shown no progress for ``limit_ms``."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = max(int(part["at_ms"].max()) for part in rows)
        if self.last.exists():
            latest = max(latest, self.last.get()[0])
        self.last.update((latest,))
        self.handle.registerTimer(latest + self.limit_ms)
        yield pd.DataFrame({"connection_id": [], "at_ms": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists() and self.last.get()[0] + self.limit_ms <= now:
            self.last.clear()
            yield pd.DataFrame({"connection_id": [key[0]], "at_ms": [now]}).astype("int64")

    def close(self) -> None:
        pass


def stalled_connections(progress: DataFrame, limit_ms: int) -> DataFrame:
    """Connections to retire, from a stream of ``connection_id, at_ms``."""
    return progress.groupBy("connection_id").transformWithStateInPandas(
        StalledConnections(limit_ms), "connection_id long, at_ms long", "append", "processingTime"
    )
