"""Scans of a log, and its recovery.

A log is a folder of Parquet segments; row groups carry the bounds of ``seq``,
which is what a lower-bound search of an index would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULT_FEED, MESSAGES, MSG_ID

META = ("seq", "stream", "subject", "ts_ms", "nbytes", "flags")


def open_log(spark: SparkSession, path: str, schema: T.StructType = MESSAGES) -> DataFrame:
    """All segments under a path, with the declared schema."""
    return spark.read.schema(schema).parquet(path)


def segments(log: DataFrame) -> DataFrame:
    """``path, first_seq, last_seq, messages`` of each segment, oldest first."""
    return (
        log.groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("messages"))
        .orderBy("first_seq")
    )


def range_scan(log: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with ``start <= seq < end`` in order, tombstones too."""
    return log.where((F.col("seq") >= start) & (F.col("seq") < end)).orderBy("seq")


def view_scan(log: DataFrame, start: int, end: int, payload: bool = False) -> DataFrame:
    """The same without the payload unless asked for: the scan then never reads it."""
    names = [c for c in (*META, *(("payload",) if payload else ())) if c in log.columns]
    return range_scan(log, start, end).select(*names)


def lookup(log: DataFrame, seq: int) -> DataFrame:
    """The row of a seq, or none."""
    return log.where(F.col("seq") == seq)


def lower_bound(log: DataFrame, seq: int) -> DataFrame:
    """``seq`` of the first row at or after one; null behind the end."""
    return log.where(F.col("seq") >= seq).agg(F.min("seq").alias("seq"))


def row_checksum(*columns: str) -> Column:
    """CRC-32 over a row's identifying bytes."""
    names = columns or ("seq", "stream", "subject", "payload")
    return F.crc32(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names]).cast("binary"))


def verified(log: DataFrame, checksum: str = "crc") -> DataFrame:
    """Rows whose stored checksum holds."""
    return log.where(row_checksum() == F.col(checksum))


def corrupt(log: DataFrame, checksum: str = "crc") -> DataFrame:
    """Rows whose stored checksum fails or lacks."""
    return log.where(~F.coalesce(row_checksum() == F.col(checksum), F.lit(False)))


def recovered(log: DataFrame, checksum: str = "crc") -> DataFrame:
    """A segment up to its first bad record: what follows a torn write is not trusted."""
    first_bad = corrupt(log, checksum).agg(F.min("seq").alias("bad"))
    return log.join(F.broadcast(first_bad), F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).drop("bad")


def store_info(log: DataFrame, *by: str) -> DataFrame:
    """``messages, bytes, first_seq, last_seq``; tombstoned rows count."""
    return log.groupBy(*by).agg(
        F.count("*").alias("messages"),
        F.sum("nbytes").alias("bytes"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def feed(log: DataFrame, cursor: int, most: int = DEFAULT_FEED) -> DataFrame:
    """At most ``most`` rows after a cursor, in order."""
    return log.where(F.col("seq") > cursor).orderBy("seq").limit(most)


def delayed_recovery(delayed: DataFrame, matured: DataFrame, now_ms: int) -> DataFrame:
    """Each entry of the delayed journal with ``state``: matured, due or pending."""
    done = matured.select("offset").distinct().withColumn("done", F.lit(True))
    state = F.when(F.col("done"), "matured").when(F.col("deliver_at") <= now_ms, "due").otherwise("pending")
    return delayed.join(done, "offset", "left").withColumn("state", state).drop("done")


def replayed_catalog(changes: DataFrame, checksum: str | None = None) -> DataFrame:
    """The catalog that a log of ``position, command, kind, name, body`` leaves.

    Commands are create and delete of streams and consumers, and cursor.  Each
    name holds its last create after its last delete; a record of a bad
    checksum is passed over.
    """
    if checksum:
        changes = changes.where(row_checksum("position", "command", "kind", "name", "body") == F.col(checksum))
    last = lambda command, value: F.max_by(value, F.when(F.col("command") == command, F.col("position")))
    at = lambda command: F.max(F.when(F.col("command") == command, F.col("position")))
    return (
        changes.groupBy("kind", "name")
        .agg(
            at("create").alias("created"), at("delete").alias("deleted"), at("cursor").alias("moved"),
            last("create", "body").alias("body"), last("cursor", "body").alias("cursor"),
        )
        .where(F.col("created").isNotNull() & (F.coalesce("deleted", F.lit(-1)) < F.col("created")))
        .select(
            "kind", "name", "body", F.when(F.col("moved") > F.col("created"), F.col("cursor")).alias("cursor")
        )
    )


def idempotency_rebuild(log: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    """``stream, msg_id, remaining_ms`` of the ids that a restart must still refuse."""
    msg_id = F.nullif(F.element_at("headers", MSG_ID), F.lit("")) if "msg_id" not in log.columns else F.nullif("msg_id", F.lit(""))
    return (
        log.where((F.col("ts_ms") > now_ms - window_ms) & msg_id.isNotNull())
        .groupBy("stream", msg_id.alias("msg_id"))
        .agg((F.lit(window_ms) - (F.lit(now_ms) - F.max("ts_ms"))).alias("remaining_ms"))
    )


def continues(batch: DataFrame, last_seq: int) -> bool:
    """Whether a replicated batch starts right behind the last local row."""
    first = batch.agg(F.min("seq")).first()[0]
    return first == last_seq + 1
