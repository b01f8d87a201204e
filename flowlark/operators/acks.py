"""Acknowledgement and redelivery over tables of deliveries and acks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opened(deliveries: DataFrame, consumers: DataFrame) -> DataFrame:
    """Pendings that deliveries open: once for each row, none where acks are not asked for."""
    asked = consumers.where(F.col("ack_policy") != "none").select("consumer_id")
    return (
        deliveries.join(asked, "consumer_id", "left_semi")
        .groupBy("consumer_id", "seq")
        .agg(F.max("attempt").alias("attempt"), F.max("delivered_ms").alias("delivered_ms"))
    )


def settled(pendings: DataFrame, acks: DataFrame) -> DataFrame:
    """Pendings that remain after acks, nacks and terms."""
    return pendings.join(acks.select("consumer_id", "seq"), ["consumer_id", "seq"], "left_anti")


def unknown(acks: DataFrame, pendings: DataFrame) -> DataFrame:
    """Acks of rows that are not pending."""
    return acks.join(pendings.select("consumer_id", "seq"), ["consumer_id", "seq"], "left_anti")


def ack_replies(acks: DataFrame, pendings: DataFrame) -> DataFrame:
    """``kind, accepted, not_found`` of a set of acks."""
    known = acks.join(
        pendings.select("consumer_id", "seq", F.lit(1).alias("known")).distinct(), ["consumer_id", "seq"], "left"
    )
    return known.groupBy("kind").agg(
        F.count("known").alias("accepted"), (F.count("*") - F.count("known")).alias("not_found")
    )


def ack_cursor(acks: DataFrame) -> DataFrame:
    """``consumer_id, cursor``: the largest seq that was acked."""
    return acks.where(F.col("kind") == "ack").groupBy("consumer_id").agg(F.max("seq").alias("cursor"))


def ack_floor(acked: DataFrame, base: Column | None = None, rank: str = "seq") -> DataFrame:
    """``consumer_id, floor``: the end of the unbroken run of acked rows above the base.

    A row ends a run if its successor is not acked; the floor is the first such
    end, found by an anti-join and a minimum, so a consumer with a third of all
    rows needs no window over them.  ``base`` seeds the floor (0 without one).
    ``rank`` may be the row's number among those owed, where seqs have gaps.
    """
    base = F.lit(0) if base is None else base
    rows = acked.select("consumer_id", F.col(rank).cast("long").alias("r"), base.cast("long").alias("base"))
    seed = rows.groupBy("consumer_id").agg(F.max("base").alias("base"))
    above = rows.select("consumer_id", "r").unionByName(seed.select("consumer_id", F.col("base").alias("r")))
    before = rows.select("consumer_id", (F.col("r") - 1).alias("r"))
    ends = above.join(before, ["consumer_id", "r"], "left_anti").join(seed, "consumer_id").where(F.col("r") >= F.col("base"))
    return ends.groupBy("consumer_id").agg(F.min("r").alias("floor"))


def owed_rank(owed: DataFrame) -> DataFrame:
    """Rows numbered among those owed to their consumer."""
    from pyspark.sql import Window

    return owed.withColumn("rank", F.row_number().over(Window.partitionBy("consumer_id").orderBy("seq")))


def suppressed(floor: DataFrame, delivered_or_acked: DataFrame) -> DataFrame:
    """Rows above the floor that must not go out again."""
    return (
        delivered_or_acked.join(floor, "consumer_id", "left")
        .where(F.col("seq") > F.coalesce("floor", F.lit(0)))
        .select("consumer_id", "seq")
        .distinct()
    )


def released(suppression: DataFrame, nacked: DataFrame) -> DataFrame:
    """The suppression without what was nacked or timed out."""
    return suppression.join(nacked.select("consumer_id", "seq"), ["consumer_id", "seq"], "left_anti")


def timeouts(deliveries: DataFrame, acks: DataFrame, ack_wait_ms: Column | int, now_ms: int | None = None) -> DataFrame:
    """Deliveries that no ack answered in time, with ``due_ms``; never before the deadline."""
    wait = F.lit(ack_wait_ms) if isinstance(ack_wait_ms, int) else ack_wait_ms
    due = deliveries.withColumn("due_ms", F.col("delivered_ms") + wait)
    if now_ms is not None:
        due = due.where(F.col("due_ms") <= now_ms)
    answered = acks.select(F.col("consumer_id").alias("a_consumer"), F.col("seq").alias("a_seq"), "acked_ms")
    return due.join(
        answered,
        (F.col("consumer_id") == F.col("a_consumer")) & (F.col("seq") == F.col("a_seq")) & (F.col("acked_ms") < F.col("due_ms")),
        "left_anti",
    )


def redeliveries(acks: DataFrame) -> DataFrame:
    """Nacked rows with ``offer_ms``: at once, or after the delay they ask for."""
    return acks.where(F.col("kind") == "nack").select(
        "consumer_id", "seq", (F.col("acked_ms") + F.coalesce("delay_ms", F.lit(0))).alias("offer_ms")
    )


def terminated(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """Messages with a tombstone where any consumer ended them."""
    gone = acks.where(F.col("kind") == "term").select("seq", F.lit(1).alias("__t")).distinct()
    return messages.join(gone, "seq", "left").withColumn(
        "flags", F.when(F.col("__t").isNotNull(), F.col("flags").bitwiseOR(1)).otherwise(F.col("flags"))
    ).drop("__t")


def classify_batch(seqs: DataFrame, cursor: Column, first_seq: Column) -> DataFrame:
    """``class, n``: ignored up to the cursor, below_retention before the first row, else accepted."""
    kind = F.when(F.col("seq") <= cursor, "ignored").when(F.col("seq") < first_seq, "below_retention").otherwise("accepted")
    return seqs.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def ack_state(messages: DataFrame, cursors: DataFrame, consumers: DataFrame) -> DataFrame:
    """``consumer_id, cursor, generation, first_seq, last_seq`` of each consumer's stream."""
    bounds = messages.groupBy("stream").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return consumers.join(bounds, "stream", "left").join(cursors, "consumer_id", "left").select(
        "consumer_id", F.coalesce("cursor", F.lit(0)).alias("cursor"), F.coalesce("generation", F.lit(0)).alias("generation"),
        "first_seq", "last_seq",
    )


def retire(pendings: DataFrame, bindings: DataFrame) -> DataFrame:
    """Rows of retired bindings, to be offered from the least ``seq`` of each consumer."""
    gone = pendings.join(bindings.select("binding_id"), "binding_id", "left_semi")
    return gone.groupBy("consumer_id").agg(F.min("seq").alias("rewind_to"), F.count("*").alias("released"))


def bindings_of(bindings: DataFrame, **keys: object) -> DataFrame:
    """Bindings of a stream, consumer or connection."""
    out = bindings
    for name, value in keys.items():
        out = out.where(F.col(name) == value)
    return out


def rewound(cursors: DataFrame, signals: DataFrame) -> DataFrame:
    """Cursors moved back before the least seq that a signal names."""
    least = signals.groupBy("consumer_id").agg((F.min("seq") - 1).alias("__to"))
    return cursors.join(least, "consumer_id", "left").withColumn("cursor", F.least("cursor", "__to")).drop("__to")


def dead_letters(acks: DataFrame, max_nack: int) -> DataFrame:
    """``consumer_id, seq, nacks`` refused more than ``max_nack`` times.

    What to do with them is left to the caller: they still are redelivered
    unless the caller ends them.
    """
    return (
        acks.where(F.col("kind") == "nack").groupBy("consumer_id", "seq").agg(F.count("*").alias("nacks")).where(F.col("nacks") > max_nack)
    )


def resume_from(policy: Column, cursor: Column, creation_floor: Column, start_seq: Column) -> Column:
    """Where a new subscription of a consumer starts."""
    return F.when(policy == "new", creation_floor + 1).when(policy == "by_start_seq", start_seq).otherwise(F.coalesce(cursor, F.lit(0)) + 1)


def deferred(acks: DataFrame, generations: DataFrame) -> DataFrame:
    """Acks that waited in a client, without those of an older generation of their consumer."""
    now = generations.select("consumer_id", F.col("generation").alias("__now"))
    return acks.join(now, "consumer_id").where(F.col("generation") == F.col("__now")).drop("__now")


def first_seen(deliveries: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Deliveries that a client takes for the first time, keyed by stream, consumer and seq."""
    key = ["stream", "consumer_id", "seq"]
    one = deliveries.dropDuplicates(key)
    return one if seen is None else one.join(seen.select(*key), key, "left_anti")


def confirmed_up_to(seen: DataFrame, floors: DataFrame) -> DataFrame:
    """The client's records that are still needed once rows up to a floor are confirmed."""
    return seen.join(floors, ["stream", "consumer_id"], "left").where(F.col("seq") > F.coalesce("floor", F.lit(0))).drop("floor")


def replayed_wal(wal: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """The live records that a log of ``stream, consumer_id, seq, op, at_ms`` leaves: recorded last, and not expired."""
    last = wal.groupBy("stream", "consumer_id", "seq").agg(
        F.max_by("op", F.struct("at_ms", "position")).alias("op"), F.max("at_ms").alias("at_ms")
    )
    return last.where((F.col("op") == "record") & (F.col("at_ms") > now_ms - ttl_ms)).drop("op")
