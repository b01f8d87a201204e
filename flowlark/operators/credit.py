"""Flow control: how much a consumer may hold.

Without acks, credit is two chained rank limits, which Spark prunes before the
shuffle; with acks in between it is a fold over each consumer's events.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, unused
from .retention import _kept


#: A cap known to the plan is applied before the shuffle up to this many rows a key.
PLAN_CAP = 1000


def _first(owed: DataFrame, key: list[str], cap: Column, highest: int) -> DataFrame:
    """The first ``cap`` rows of each key, of rows that all have a cap of at most ``highest``."""
    if highest <= PLAN_CAP:
        (rank,) = unused(owed, "__rank")
        w = Window.partitionBy(*key).orderBy("seq")
        # the literal prunes each task's rows before the shuffle, the column decides
        return owed.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= highest).where(F.col(rank) <= cap).drop(rank)
    # beyond that the boundary is found from sums over ranges of seq, so a key of any size is many tasks
    (limit,) = unused(owed, "__limit")
    return _kept(owed.withColumn(limit, cap), [*key, limit], F.lit(1), F.col(limit), False).drop(limit)


def _under_cap(owed: DataFrame, key: list[str], name: str, free: Column) -> DataFrame:
    """Rows without a cap as they are, and of the others the first of each key."""
    if getattr(owed, "_flowlark_path", None) is None:
        owed = materialize(owed, "owed")  # read three times, and costly to make
    highest = owed.agg(F.max(F.when(~free, F.col(name)))).first()[0]  # one number
    if highest is None:
        return owed
    return owed.where(free).unionByName(_first(owed.where(~free), key, F.col(name), int(highest)))


def subject_credit(owed: DataFrame, limit: str = "limit") -> DataFrame:
    """The first ``limit`` rows of each consumer and subject; a null limit is none."""
    return _under_cap(owed, ["consumer_id", "subject"], limit, F.col(limit).isNull())


def consumer_credit(owed: DataFrame, most: str = "max_inflight") -> DataFrame:
    """The first ``max_inflight`` rows of each consumer; 0 or null is no limit, and takes no window."""
    return _under_cap(owed, ["consumer_id"], most, F.coalesce(F.col(most), F.lit(0)) == 0)


def capped(owed: DataFrame, key: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, for a limit known to the plan: each task keeps ``most`` a key before the shuffle."""
    w = Window.partitionBy(*key).orderBy("seq")
    return owed.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def credit(owed: DataFrame) -> DataFrame:
    """Both limits: what a subject's limit holds back takes none of the consumer's credit.

    What is owed is written once, since matching and routing made it.
    """
    return consumer_credit(subject_credit(materialize(owed, "owed")))


def cursor_pin(owed: DataFrame, sent: DataFrame) -> DataFrame:
    """``consumer_id, cursor``: before the first row held back, else the last row."""
    held = owed.select("consumer_id", "seq").join(sent.select("consumer_id", "seq"), ["consumer_id", "seq"], "left_anti")
    first = held.groupBy("consumer_id").agg((F.min("seq") - 1).alias("pin"))
    last = owed.groupBy("consumer_id").agg(F.max("seq").alias("last"))
    return last.join(first, "consumer_id", "left").select("consumer_id", F.coalesce("pin", "last").alias("cursor"))


def inflight(pendings: DataFrame, *by: str) -> DataFrame:
    """Pendings of each consumer, queue, or consumer and subject."""
    return pendings.groupBy(*(by or ("consumer_id",))).agg(F.count("*").alias("inflight"))


def with_capacity(consumers: DataFrame, pendings: DataFrame) -> DataFrame:
    """Consumers with ``inflight`` and whether one more fits."""
    held = inflight(pendings)
    return (
        consumers.join(held, "consumer_id", "left")
        .withColumn("inflight", F.coalesce("inflight", F.lit(0)))
        .withColumn("has_capacity", (F.col("max_inflight") == 0) | (F.col("inflight") < F.col("max_inflight")))
    )


def paused(consumers: DataFrame, names: list[str], value: bool = True) -> DataFrame:
    """Consumers with some paused or resumed."""
    return consumers.withColumn("paused", F.when(F.col("name").isin(names), F.lit(value)).otherwise(F.col("paused")))


def stalled_connections(progress: DataFrame, now_ms: int, limit_ms: int) -> DataFrame:
    """Connections that have owed rows and no progress for too long."""
    return (
        progress.groupBy("connection_id")
        .agg(F.max("progress_ms").alias("last_progress_ms"), F.max("owed").alias("owed"))
        .where((F.col("owed") > 0) & (F.col("last_progress_ms") + limit_ms <= now_ms))
    )


def over_quota(owned: DataFrame, most: int) -> DataFrame:
    """``connection_id, kind, n`` beyond a connection's quota of streams, consumers or crons."""
    return owned.groupBy("connection_id", "kind").agg(F.count("*").alias("n")).where(F.col("n") > most)


def rate_limited(frames: DataFrame, per_second: int) -> DataFrame:
    """Frames with ``accepted``: the first ``per_second`` of a connection in each second."""
    w = Window.partitionBy("connection_id", F.floor(F.col("ts_ms") / 1000)).orderBy("ts_ms", "frame_id")
    return frames.withColumn("accepted", F.row_number().over(w) <= per_second)


# ---- with acks


class Ledger:
    """One consumer's credit: pendings, and rows that wait in order."""

    def __init__(self, max_inflight: int = 0):
        self.max_inflight = max_inflight
        self.pending: dict[int, str] = {}
        self.by_subject: Counter = Counter()
        self.limits: dict[str, int | None] = {}
        self.waiting: dict[str, list[int]] = defaultdict(list)
        self.done: set[int] = set()

    def offer(self, seq: int, subject: str, limit: int | None) -> None:
        if seq not in self.pending and seq not in self.done:
            self.limits[subject] = limit
            self.waiting[subject].append(seq)

    def release(self, seq: int, again: bool) -> bool:
        """An ack or nack; False if the row is not pending."""
        subject = self.pending.pop(seq, None)
        if subject is None:
            return False
        self.by_subject[subject] -= 1
        if again:
            self.waiting[subject] = sorted([seq, *self.waiting[subject]])
        else:
            self.done.add(seq)
        return True

    def deliver(self) -> Iterator[int]:
        """What may go now, in order of seq."""
        while not self.max_inflight or len(self.pending) < self.max_inflight:
            ready = [
                (rows[0], s) for s, rows in self.waiting.items()
                if rows and (self.limits[s] is None or self.by_subject[s] < self.limits[s])
            ]
            if not ready:
                return
            seq, subject = min(ready)
            self.waiting[subject].pop(0)
            self.pending[seq] = subject
            self.by_subject[subject] += 1
            yield seq


LEDGER = "consumer_id long, seq long, at_ms long, attempt int"


def credit_with_acks(events: DataFrame) -> DataFrame:
    """Deliveries of a time-ordered history: ``consumer_id, seq, at_ms, attempt``.

    Events are ``consumer_id, at_ms, position, kind, seq, subject, limit,
    max_inflight`` with kinds offer, ack, nack and term.  Credit with acks in
    between is sequential for each consumer; consumers run in parallel.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at_ms", "position"])
        ledger, attempts, out = Ledger(int(rows["max_inflight"].fillna(0).max())), Counter(), []
        for r in rows.itertuples():
            if r.kind == "offer":
                ledger.offer(int(r.seq), r.subject, None if pd.isna(r.limit) else int(r.limit))
            else:
                ledger.release(int(r.seq), r.kind == "nack")
            for seq in ledger.deliver():
                attempts[seq] += 1
                out.append((key[0], seq, int(r.at_ms), attempts[seq]))
        return pd.DataFrame(out, columns=["consumer_id", "seq", "at_ms", "attempt"])

    return events.groupBy("consumer_id").applyInPandas(run, LEDGER)
