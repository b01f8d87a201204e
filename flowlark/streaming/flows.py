"""Streaming forms that Structured Streaming's own operators express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.payload import message_flags, message_id
from ..functions.subjects import valid_subject
from ..operators import routing
from ..schema import MESSAGES
from ..sources.log import row_checksum


def read_log(spark: SparkSession, path: str, schema: T.StructType = MESSAGES, files_per_trigger: int = 64) -> DataFrame:
    """A log's segments as they appear; the trigger's limit is the feed window."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(log: DataFrame) -> DataFrame:
    """With ``ts``, the event time."""
    return log.withColumn("ts", F.timestamp_millis("ts_ms"))


def dedup(log: DataFrame, window_ms: int) -> DataFrame:
    """Rows whose (stream, msg_id) was not seen within the window; rows without an id all pass.

    Driven by the watermark, so a duplicate is refused for at least the window
    of event time: the batch form's exact rule needs all rows of an id in order.
    """
    late = f"{window_ms} milliseconds"
    # an id of its own, so that rows without one share no state
    key = F.coalesce(F.nullif("msg_id", F.lit("")), F.concat(F.lit("\x00"), F.col("seq").cast("string")))
    marked = timed(log).withColumn("dedup_id", key).withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(["stream", "dedup_id"]).drop("dedup_id")


def accepted(rows: DataFrame) -> DataFrame:
    """Messages that pass the grammar, as they are stored."""
    return rows.where(valid_subject("subject")).withColumns(
        {
            "msg_id": message_id(F.col("headers")),
            "flags": message_flags(F.col("headers"), F.col("reply_to")),
            "nbytes": F.octet_length(F.coalesce("payload", F.lit(""))).cast("long"),
        }
    )


def routed(log: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each micro-batch's rows with their subscriptions; subscriptions are a small static table.

    A stream has no distinct subjects beforehand, so rows are matched one by
    one against the filters of their stream.
    """
    filters = routing.subscription_filters(subscriptions).withColumnRenamed("stream", "f_stream")
    hit = F.when(F.col("kind") == "catch_all", True).otherwise(routing.S.matches("filter", "subject"))
    found = log.join(filters, log["stream"] == F.col("f_stream")).where(hit)
    return found.drop("f_stream", "filter", "kind", "head", "depth")


def windowed_counts(log: DataFrame, by: list[str], window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Rows per window and key, with late rows up to ``lateness``."""
    return timed(log).withWatermark("ts", lateness).groupBy(F.window("ts", window), *by).agg(F.count("*").alias("n"))


def correlated(requests: DataFrame, replies: DataFrame, timeout_ms: int, lateness: str = "1 minute") -> DataFrame:
    """Requests and their replies within the timeout; without one after it, a null reply."""
    a = timed(requests).withWatermark("ts", lateness).select("correlation_id", F.col("ts").alias("asked"), F.col("payload").alias("request"))
    b = timed(replies).withWatermark("ts", lateness).select(F.col("correlation_id").alias("r_id"), F.col("ts").alias("answered"), F.col("payload").alias("reply"))
    until = F.col("asked") + F.expr(f"INTERVAL {timeout_ms / 1000} SECONDS")
    return a.join(b, (F.col("correlation_id") == F.col("r_id")) & F.col("answered").between(F.col("asked"), until), "leftOuter").drop("r_id")


def append_sink(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append accepted rows with checksums; the file sink commits each batch once."""
    return (
        rows.withColumn("crc", row_checksum())
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def deliver(rows: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to a handler; offsets are committed once it returns, so delivery is at least once."""
    return rows.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(log: DataFrame, max_age_ms: Column) -> DataFrame:
    """Rows that have not expired as they are processed."""
    now = F.unix_millis(F.current_timestamp())
    return log.where(~((max_age_ms > 0) & (F.col("ts_ms") > 0) & (F.col("ts_ms") + max_age_ms <= now)))
