"""Appending to logs and delivering from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payload import message_flags, message_id
from ..functions.subjects import subject_error
from ..schema import MAX_DELAY_MS, MAX_DELAYED
from ..storage import materialize, unused
from .log import row_checksum

SEGMENT_ROWS = 1_000_000


def numbered(rows: DataFrame, next_seq: int, *order: str) -> DataFrame:
    """Consecutive ``seq`` from ``next_seq`` in a given order, without one task that sorts all rows.

    Rows are ranged over partitions, sorted there and written once with their
    partition and place: range bounds are sampled, so a second plan of the same
    ranging would deal rows otherwise.  What was written is then numbered by
    sums over the partitions' sizes (one number each), without a shuffle.
    """
    at, part, start = unused(rows, "__at", "__part", "__start")
    ranged = materialize(
        rows.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn(at, F.monotonically_increasing_id()),
        "numbered",
    )
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn(part, F.shiftright(at, 33))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part).agg(F.count("*").alias(start))
    starts = sizes.select(part, F.coalesce(F.sum(start).over(ahead), F.lit(0)).alias(start))
    return (
        ranged.join(F.broadcast(starts), part)  # a row for each partition
        .withColumn("seq", F.lit(next_seq) + F.col(start) + place)
        .drop(at, part, start)
    )


def append(rows: DataFrame, path: str, segment_rows: int = SEGMENT_ROWS) -> None:
    """Add rows with their seqs and checksums as new segments; a commit is all or nothing."""
    (
        rows.withColumn("crc", row_checksum())
        .sortWithinPartitions("seq")
        .write.mode("append")
        .option("maxRecordsPerFile", segment_rows)
        .parquet(path)
    )


def publishable(rows: DataFrame) -> DataFrame:
    """Messages as they are stored, with ``error`` where one is refused."""
    return rows.withColumns(
        {
            "msg_id": message_id(F.col("headers")),
            "flags": message_flags(F.col("headers"), F.col("reply_to")),
            "nbytes": F.octet_length(F.coalesce("payload", F.lit(""))).cast("long"),
            "error": subject_error("subject"),
        }
    )


def delayed(rows: DataFrame, already: int = 0) -> DataFrame:
    """Messages with ``deliver_at``, and ``error`` beyond the delay or the number that may be pending.

    No delay is a plain publish.  Only the boundary of the quota needs an order:
    rows are admitted by publish time and seq.
    """
    late = rows.where(F.col("delay_ms") > 0)
    held = late.where(F.col("delay_ms") <= MAX_DELAY_MS)
    if held.count() > MAX_DELAYED - already:
        # a top-k, which Spark merges from partial top-ks
        kept = held.orderBy("ts_ms", "seq").limit(max(0, MAX_DELAYED - already)).select("seq", F.lit(True).alias("__kept"))
        out = rows.join(kept, "seq", "left")
    else:
        out = rows.withColumn("__kept", F.lit(True))
    error = F.when(F.col("delay_ms") > MAX_DELAY_MS, "delay_too_long").when(
        (F.col("delay_ms") > 0) & F.col("__kept").isNull(), "too_many_delayed"
    )
    return out.withColumns({"deliver_at": F.col("ts_ms") + F.col("delay_ms"), "error": error}).drop("__kept")


def changed_cursors(before: DataFrame, after: DataFrame) -> DataFrame:
    """``consumer_id, cursor`` of the consumers whose cursor moved."""
    old = before.select("consumer_id", F.col("cursor").alias("was"))
    return after.join(old, "consumer_id", "left").where(~F.col("cursor").eqNullSafe(F.col("was"))).drop("was")


def frames(deliveries: DataFrame, most: int = 1024) -> DataFrame:
    """Delivered rows as frames of one connection and stream: ``connection_id, stream, is_fanout, frame, seqs``.

    A frame holds ``most`` consecutive rows at most, so none grows with the
    backlog of a connection.
    """
    key = ("connection_id", "stream", "is_fanout")
    at = F.row_number().over(Window.partitionBy(*key).orderBy("seq")) - 1
    return (
        deliveries.withColumn("frame", F.floor(at / most).cast("long"))
        .groupBy(*key, "frame")
        .agg(F.sort_array(F.collect_list("seq")).alias("seqs"))
    )


def delivered(offers: DataFrame, connections: DataFrame) -> DataFrame:
    """Offers with ``outcome``: ok, backpressured beyond a connection's room, or writer_gone."""
    rank = F.row_number().over(Window.partitionBy("connection_id").orderBy("seq"))
    return (
        offers.withColumn("__r", rank)
        .join(connections.select("connection_id", "room", "alive"), "connection_id", "left")
        .withColumn(
            "outcome",
            F.when(~F.coalesce("alive", F.lit(False)), "writer_gone").when(F.col("__r") > F.col("room"), "backpressured").otherwise("ok"),
        )
        .drop("__r", "room", "alive")
    )
