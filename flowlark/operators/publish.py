"""Publishing as one operator: validate, dedup, quota, number, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from ..storage import materialize
from .dedup import accepted_batches, effective_window, first_sight
from .retention import admitted


def verdicts(rows: DataFrame, streams: DataFrame, shard: str | None = None, used_messages: int = 0, used_bytes: int = 0) -> DataFrame:
    """Messages of ``seq`` (their arrival), ``stream, subject, ts_ms, headers, reply_to, payload`` with ``verdict``.

    It is ok, or the first that applies: invalid (the subject's grammar),
    unknown_stream, duplicate, over_quota.  A message is a duplicate within its
    stream's ``idempotency_window_ms`` of the last accepted of its id; ids are
    recorded before the quota is looked at, so one that the quota refuses is
    burnt for the window.  An empty id, or a stream without a window, is never
    a duplicate.
    """
    known = streams.select(F.col("name").alias("stream"), F.coalesce("idempotency_window_ms", F.lit(0)).alias("__window"))
    asked = sinks.publishable(rows).join(known, "stream", "left")
    early = F.when(F.col("error").isNotNull(), "invalid").when(F.col("__window").isNull(), "unknown_stream")
    asked = materialize(asked.withColumn("verdict", early), "published")
    sound = asked.where(F.col("verdict").isNull()).drop("verdict")
    # the windows of a catalog are few: at most five minutes in whole seconds
    windows = sorted({effective_window(r[0]) for r in streams.select(F.coalesce("idempotency_window_ms", F.lit(0))).distinct().collect() if r[0]})
    whole = F.least(F.ceil(F.col("__window") / 1000) * 1000, F.lit(300_000))
    parts = [sound.where(F.col("__window") == 0).withColumn("__fresh", F.lit(True))]
    for window in windows:
        seen = first_sight(sound.where((F.col("__window") > 0) & (whole == window)), ["stream", "msg_id"], window)
        parts.append(seen.withColumnRenamed("accepted", "__fresh"))
    judged = parts[0]
    for part in parts[1:]:
        judged = judged.unionByName(part)
    judged = materialize(judged, "deduplicated")
    fresh = admitted(judged.where("__fresh").drop("__fresh"), streams, used_messages, used_bytes, shard)
    stored = fresh.withColumn("verdict", F.when(F.col("accepted"), "ok").otherwise("over_quota")).drop("accepted")
    twice = judged.where(~F.col("__fresh")).drop("__fresh").withColumn("verdict", F.lit("duplicate"))
    refused = asked.where(F.col("verdict").isNotNull())
    return refused.unionByName(twice).unionByName(stored).drop("__window", "error")


def publish(rows: DataFrame, streams: DataFrame, next_seq: int, path: str | None = None, **options) -> DataFrame:
    """The verdicts of messages, with ``stored_seq`` of those that are accepted, in order of arrival.

    With a path these are appended to the log there, whole or not at all.
    """
    judged = materialize(verdicts(rows, streams, **options), "verdicts")
    stored = sinks.numbered(judged.where("verdict = 'ok'").withColumnRenamed("seq", "arrival"), next_seq, "arrival")
    stored = materialize(stored, "stored")
    if path:
        sinks.append(stored.drop("arrival", "verdict"), path)
    at = stored.select(F.col("arrival").alias("seq"), F.col("seq").alias("stored_seq"))
    return judged.join(at, "seq", "left")


def publish_batches(batches: DataFrame, seen: DataFrame | None, free_messages: int, free_bytes: int) -> DataFrame:
    """``batch_id, verdict``: a batch with a duplicate, or that doesn't fit, is refused whole.

    A batch refused as a duplicate takes no room.
    """
    from .retention import admitted_batches

    checked = accepted_batches(batches, seen)
    unique = checked.where("accepted").drop("accepted")
    fits = admitted_batches(unique, free_messages, free_bytes).select("batch_id", F.when(F.col("accepted"), "ok").otherwise("over_quota").alias("verdict"))
    return checked.where(~F.col("accepted")).select("batch_id", F.lit("duplicate").alias("verdict")).distinct().unionByName(fits)
