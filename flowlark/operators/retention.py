"""Retention, quotas and deletes.

"Newest N" and "newest B bytes" have one boundary row.  It is found from sums
over coarse ranges of seq, and only the range that holds it is ranked, so no
window sorts a whole stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.subjects import subject_matches
from ..schema import TOMBSTONE

RANGES = 4096


def _ranges(rows: DataFrame, by: list[str], weight: Column, newest: bool, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their range of seq and weight, and per range its sum and what lies before it."""
    bounds = rows.groupBy(*by).agg(F.min("seq").alias("__lo"), F.max("seq").alias("__hi"))
    weighed = rows.withColumn("__w", weight.cast("long"))
    # without groups the bounds are one row
    keyed = weighed.join(bounds, by) if by else weighed.join(F.broadcast(bounds))
    width = F.greatest(F.floor((F.col("__hi") - F.col("__lo")) / F.lit(ranges)) + 1, F.lit(1))
    keyed = keyed.withColumn("__range", F.floor((F.col("seq") - F.col("__lo")) / width)).drop("__lo", "__hi")
    end = F.desc("__range") if newest else F.asc("__range")
    upto = Window.partitionBy(*by).orderBy(end).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*by, "__range").agg(F.sum("__w").alias("__sum"))  # at most `ranges` rows a group
    return keyed, sums.withColumn("__before", F.coalesce(F.sum("__sum").over(upto), F.lit(0)))


def _kept(rows: DataFrame, by: list[str], weight: Column, limit: Column | int, newest: bool, ranges: int = RANGES) -> DataFrame:
    keyed, sums = _ranges(rows, by, weight, newest, ranges)
    on = [*by, "__range"]
    whole = sums.where(F.col("__before") + F.col("__sum") <= limit).select(*on)
    split = sums.where((F.col("__before") < limit) & (F.col("__before") + F.col("__sum") > limit)).select(*on, "__before")
    order = F.desc("seq") if newest else F.asc("seq")
    inside = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    edge = keyed.join(F.broadcast(split) if not by else split, on).withColumn("__upto", F.col("__before") + F.sum("__w").over(inside))
    names = rows.columns
    return keyed.join(whole, on, "left_semi").select(*names).unionByName(edge.where(F.col("__upto") <= limit).select(*names))


def newest_messages(rows: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The newest ``most`` rows of each group: a ring buffer by number."""
    return _kept(rows, by or [], F.lit(1), most, True)


def newest_bytes(rows: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The longest run of newest rows of at most so many bytes."""
    return _kept(rows, by or [], F.col("nbytes"), most, True)


def admitted_messages(rows: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The first ``most`` rows of each group: those behind are refused."""
    return _kept(rows, by or [], F.lit(1), most, False)


def admitted_bytes(rows: DataFrame, most: int, by: list[str], used: int = 0) -> DataFrame:
    """Rows with ``accepted`` under a quota of bytes: a small row may fit after a large one was refused.

    That is a fold over each store's rows in order; they stream through a task
    sorted, and only the bytes used are held.
    """
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "seq")
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, used
        for part in parts:
            out = np.zeros(len(part), dtype=bool)
            for i, (key, size) in enumerate(zip(zip(*[part[k] for k in by], strict=True), part["nbytes"], strict=True)):
                if key != last:
                    last, held = key, used
                if held + size <= most:
                    held, out[i] = held + size, True
            yield part.assign(accepted=out)

    return dealt.mapInPandas(run, schema)


def admitted_batches(batches: DataFrame, free_messages: int, free_bytes: int) -> DataFrame:
    """``batch_id, accepted``: a batch fits whole, in turn, or is refused whole.

    Batches are summed first.  Whether one fits depends on all before it, so the
    sums stream through one task in order; it holds two numbers.
    """
    sums = batches.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("nbytes").alias("b"), F.min("seq").alias("seq"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = b = 0
        for part in parts:
            out = np.zeros(len(part), dtype=bool)
            for i, (rows, size) in enumerate(zip(part["n"], part["b"], strict=True)):
                if n + rows <= free_messages and b + size <= free_bytes:
                    n, b, out[i] = n + rows, b + size, True
            yield pd.DataFrame({"batch_id": part["batch_id"], "accepted": out})

    schema = T.StructType([batches.schema["batch_id"], T.StructField("accepted", T.BooleanType())])
    return sums.repartition(1).sortWithinPartitions("seq").mapInPandas(run, schema)


def admitted(rows: DataFrame, streams: DataFrame, used_messages: int = 0, used_bytes: int = 0, shard: str | None = None) -> DataFrame:
    """Rows with ``accepted`` under the quotas of streams that refuse what is new.

    A stream of ``discard`` new refuses a row when its store holds ``max_msgs``
    messages, or would hold more than ``max_bytes`` bytes; 0 or null is no
    quota.  Counts are those of the whole store (``shard``, or all rows), over
    all its streams, so this is a fold over a store's rows in order of ``seq``:
    they stream through a task sorted, and it holds two numbers for each store.
    """
    limits = streams.select(
        F.col("name").alias("stream"),
        *[F.when(F.col("discard") == "new", F.nullif(F.coalesce(c, F.lit(0)), F.lit(0))).cast("long").alias(f"__{c}") for c in ("max_msgs", "max_bytes")],
    )
    by = [shard] if shard else []
    known = rows.join(limits, "stream", "left").select(*rows.columns, "__max_msgs", "__max_bytes")
    dealt = (known.repartition(*by) if by else known.repartition(1)).sortWithinPartitions(*by, "seq")
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, held = None, used_messages, used_bytes
        for part in parts:
            out = np.zeros(len(part), dtype=bool)
            keys = part[shard] if shard else [0] * len(part)
            sizes = zip(keys, part["nbytes"], part["__max_msgs"].fillna(-1), part["__max_bytes"].fillna(-1), strict=True)
            for i, (key, size, msgs, most) in enumerate(sizes):
                if key != last:
                    last, n, held = key, used_messages, used_bytes
                if (msgs < 0 or n < msgs) and (most < 0 or held + size <= most):
                    n, held, out[i] = n + 1, held + size, True
            yield part.drop(columns=["__max_msgs", "__max_bytes"]).assign(accepted=out)

    return dealt.mapInPandas(run, schema)


def truncate_front(rows: DataFrame, seq: int) -> DataFrame:
    """Without the rows before a seq."""
    return rows.where(F.col("seq") >= seq)


def purge(rows: DataFrame) -> DataFrame:
    """No rows; the seqs go on from the last."""
    return rows.where(F.lit(False))


def purge_before(rows: DataFrame, cutoff_ms: int) -> DataFrame:
    """Without all that stands before the first row at or after the cutoff; nothing is left without one.

    Later rows of earlier times stay, so this is no filter on time.
    """
    first = rows.where(F.col("ts_ms") >= cutoff_ms).agg(F.min("seq").alias("__first"))
    return rows.join(F.broadcast(first), F.col("seq") >= F.col("__first")).drop("__first")


def expired_front(rows: DataFrame, max_age_ms: Column, now_ms: int) -> DataFrame:
    """What an age sweep leaves of each stream: from its first row that has not expired."""
    fresh = rows.where(~((max_age_ms > 0) & (F.col("ts_ms") > 0) & (F.col("ts_ms") + max_age_ms <= now_ms)))
    first = fresh.groupBy("stream").agg(F.min("seq").alias("__first"))
    return rows.join(first, "stream").where(F.col("seq") >= F.col("__first")).drop("__first")


def drain(rows: DataFrame, stream: str, pattern: str = "") -> DataFrame:
    """Without a stream's rows whose subject matches; no pattern is the whole stream."""
    hit = F.col("stream") == stream
    if pattern:
        hit &= subject_matches("subject", pattern)
    return rows.where(~hit)


def tombstone(rows: DataFrame, where: Column) -> DataFrame:
    """Rows with the deleted flag where a condition holds."""
    return rows.withColumn("flags", F.when(where, F.col("flags").bitwiseOR(TOMBSTONE)).otherwise(F.col("flags")))


def tombstone_at(rows: DataFrame, seq: int) -> DataFrame:
    return tombstone(rows, F.col("seq") == seq)


def tombstone_stream(rows: DataFrame, stream: str) -> DataFrame:
    return tombstone(rows, F.col("stream") == stream)


def compact(rows: DataFrame) -> DataFrame:
    """Without the deleted rows."""
    return rows.where(F.col("flags").bitwiseAND(TOMBSTONE) == 0)


def rewrite_compacted(rows: DataFrame, path: str) -> None:
    """Write the log without deleted rows to a new path; the old segments stay until they are dropped."""
    compact(rows).sortWithinPartitions("seq").write.mode("errorifexists").parquet(path)


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """One page of a listing."""
    return rows.orderBy(order).offset(offset).limit(limit)


def interest_retained(messages: DataFrame, floors: DataFrame, consumers: DataFrame) -> DataFrame:
    """Rows that some consumer of their stream has yet to ack; rows of streams without consumers go."""
    least = consumers.join(floors, "consumer_id", "left").groupBy("stream").agg(F.min(F.coalesce("floor", F.lit(0))).alias("__least"))
    return messages.join(least, "stream").where(F.col("seq") > F.col("__least")).drop("__least")


def work_queue_retained(messages: DataFrame, acked: DataFrame) -> DataFrame:
    """Rows that nobody acked."""
    return messages.join(acked.select("stream", "seq"), ["stream", "seq"], "left_anti")
