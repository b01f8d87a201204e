"""Message logs made of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.subjects import slug


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    """Milliseconds since 1970 of a timestamp without a time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: seq, stream, subject, ts_ms, payload, nbytes, flags and the event's type and user.

    seq comes from the key, so no global numbering is needed; a query reads
    only the columns that it names.
    """
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.lit("events").alias("stream"),
        F.concat(F.lit("events."), F.col("event_type"), F.lit(".u"), F.col("user_id").cast("string")).alias("subject"),
        millis("ts").alias("ts_ms"),
        F.col("props").alias("payload"),
        F.octet_length("props").cast("long").alias("nbytes"),
        F.lit(0).alias("flags"),
        "event_type",
        "user_id",
        "value",
    )


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a second stream."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.lit("orders").alias("stream"),
        F.concat(F.lit("orders."), slug("o_orderpriority"), F.lit(".c"), F.col("o_custkey").cast("string")).alias("subject"),
        millis("o_orderdate").alias("ts_ms"),
        F.col("o_orderstatus").alias("payload"),
        F.octet_length("o_orderstatus").cast("long").alias("nbytes"),
        F.lit(0).alias("flags"),
    )
