"""Listings, counters and gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .retention import page


def list_streams(streams: DataFrame, offset: int = 0, limit: int = 1000) -> DataFrame:
    return page(streams, "name", offset, limit)


def list_consumers(consumers: DataFrame, stream: str | None = None, offset: int = 0, limit: int = 1000) -> DataFrame:
    """All consumers, or a stream's (an unknown stream has none)."""
    return page(consumers if stream is None else consumers.where(F.col("stream") == stream), "consumer_id", offset, limit)


def get(rows: DataFrame, name: str) -> DataFrame:
    """The entry of a name, or none."""
    return rows.where(F.col("name") == name)


def pending_count(pendings: DataFrame, consumer_id: int) -> DataFrame:
    return pendings.where(F.col("consumer_id") == consumer_id).agg(F.count("*").alias("pending"))


def consumer_states(consumers: DataFrame, pendings: DataFrame, floors: DataFrame) -> DataFrame:
    """``consumer_id, paused, pending, oldest, floor`` of every consumer."""
    held = pendings.groupBy("consumer_id").agg(F.count("*").alias("pending"), F.min("seq").alias("oldest"))
    return (
        consumers.select("consumer_id", "paused")
        .join(held, "consumer_id", "left")
        .join(floors, "consumer_id", "left")
        .select("consumer_id", "paused", F.coalesce("pending", F.lit(0)).alias("pending"), "oldest", F.coalesce("floor", F.lit(0)).alias("floor"))
    )


def counters(events: DataFrame, kinds: list[str]) -> DataFrame:
    """One row with the number of events of each kind."""
    return events.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])


def deltas(ticks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Counters of each tick with what they gained since the last; a counter that was reset gained nothing."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(at)), F.lit(0))
    return ticks.withColumn("delta", F.greatest(F.col(value) - before, F.lit(0)))


def stream_totals(log: DataFrame) -> DataFrame:
    """``stream, messages, bytes``."""
    return log.groupBy("stream").agg(F.count("*").alias("messages"), F.sum("nbytes").alias("bytes"))


def high_watermarks(log: DataFrame) -> DataFrame:
    """``stream, high``: the last seq."""
    return log.groupBy("stream").agg(F.max("seq").alias("high"))


def prometheus(values: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """``line``: a metric in text form for each row."""
    parts = [F.concat(F.lit(f'{k}="'), F.regexp_replace(F.col(k).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for k in labels]
    return values.select(
        F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line")
    )


def oldest_pending(pendings: DataFrame, now_ms: int, hot_ms: int) -> DataFrame:
    """``oldest_ms, hot``: the age of the oldest pending, and how many are older than ``hot_ms``."""
    age = F.lit(now_ms) - F.col("delivered_ms")
    return pendings.agg(F.max(age).alias("oldest_ms"), F.count(F.when(age > hot_ms, 1)).alias("hot"))


def observed_drops(rows: DataFrame, reasons: dict[str, Column], name: str = "drops") -> tuple[DataFrame, Observation]:
    """Rows that no reason drops, and an observation that counts those of each reason as a job runs."""
    seen = Observation(name)
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in reasons.items()}
    counted = rows.observe(seen, *[F.sum(v.cast("long")).alias(k) for k, v in flags.items()])
    for v in flags.values():
        counted = counted.where(~v)
    return counted, seen
