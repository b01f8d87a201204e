"""Streams, consumers, subscriptions and bindings as tables, and the rules they obey.

Commands are tables too: a command table is answered with a verdict for each
row, and the catalog that results is a new DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import subjects as S
from ..schema import MAX_BATCH_SUBSCRIPTIONS

#: What two definitions of one consumer are compared by.
CONSUMER_CONFIG = ("stream", "group_name", "filter", "max_inflight", "ack_policy", "ack_wait_ms")


def _head(filter_: Column) -> Column:
    """The literal first token, or null where it is a wildcard: patterns of different heads never meet."""
    t = S.next_token(filter_)
    return F.when(~t.isin("*", ">"), t)


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of patterns that could meet: equal literal heads, or a wildcard head on either side.

    There are at most MAX_STREAMS streams, so they may be broadcast.
    """
    rows = rows.coalesce(1)
    named = rows.select(F.col(key).alias("k"), F.col("filter").alias("f"), _head(F.col("filter")).alias("h"))
    a = named.select(*[F.col(c).alias(f"a_{c}") for c in named.columns])
    b = named.select(*[F.col(c).alias(f"b_{c}") for c in named.columns])
    meet = (F.col("a_h") == F.col("b_h")) | F.col("a_h").isNull() | F.col("b_h").isNull()
    return a.join(F.broadcast(b), meet & (F.col("a_k") < F.col("b_k")))


def overlapping_streams(streams: DataFrame) -> DataFrame:
    """``a, b`` of streams whose filters some subject matches alike."""
    return _pairs(streams.where(F.coalesce("filter", F.lit("")) != ""), "name").where(S.overlaps("a_f", "b_f")).select(
        F.col("a_k").alias("a"), F.col("b_k").alias("b")
    )


def _nested_filters(filters: DataFrame) -> DataFrame:
    """Pairs of ``stream, inner, outer``, each once, of filters that are strictly nested; with ``lo, hi`` of both.

    ``filters`` has distinct ``stream, filter`` and ``lo, hi``.  Two filters
    that cover each other are equal, so the outer one is another filter that
    covers the inner.  It has wildcards, and a shape: which of its tokens are
    which wildcard.  Only one filter of a shape can cover a given one, and the
    given one's tokens spell it, so it is looked up.  The work is the filters
    of a stream times its shapes, not its pairs.
    """
    t = F.col("t")
    parts = filters.withColumn("t", S.tokens("filter"))
    # behind a > that is not the last token nothing is covered
    wide = parts.where(~S.is_literal("filter") & ~F.array_contains(F.slice(t, 1, F.size(t) - 1), ">"))
    shapes = wide.select("stream", F.transform(t, lambda x: F.when(x.isin("*", ">"), x).otherwise("")).alias("shape")).distinct()
    shape, n = F.col("shape"), F.size("shape")
    long_enough = F.when(F.element_at(shape, -1) == ">", F.size(t) >= n).otherwise(F.size(t) == n)
    fits = lambda m, x: (m == ">") | ((x != ">") & ((m == "*") | (x != "*")))
    spelt = lambda m, x: F.when(m == "", x).otherwise(m)
    under = (
        parts.join(shapes, "stream")
        .where(long_enough & F.forall(F.zip_with(shape, F.slice(t, 1, n), fits), lambda x: x))
        .select(
            "stream", F.col("filter").alias("inner"), F.col("lo").alias("inner_lo"), F.col("hi").alias("inner_hi"),
            F.array_join(F.zip_with(shape, F.slice(t, 1, n), spelt), ".").alias("outer"),
        )
        .where(F.col("inner") != F.col("outer"))
    )
    known = wide.select("stream", F.col("filter").alias("outer"), F.col("lo").alias("outer_lo"), F.col("hi").alias("outer_hi"))
    return under.join(known, ["stream", "outer"])


def _filters_of(consumers: DataFrame) -> DataFrame:
    """Distinct ``stream, filter`` with the least and the greatest name that has it."""
    return consumers.where(F.col("name").isNotNull()).groupBy("stream", "filter").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))


def nested_consumers(consumers: DataFrame) -> DataFrame:
    """``stream, outer, inner`` of consumers one of whose filters strictly holds the other's."""
    of = lambda end: consumers.select("stream", F.col("filter").alias(end), F.col("name").alias(f"{end}_name"))
    p = _nested_filters(_filters_of(consumers)).select("stream", "inner", "outer")
    p = p.join(of("outer"), ["stream", "outer"]).join(of("inner"), ["stream", "inner"])
    return p.where("outer_name <> inner_name").select("stream", F.col("outer_name").alias("outer"), F.col("inner_name").alias("inner"))


def in_nesting(consumers: DataFrame) -> DataFrame:
    """Distinct ``stream, name`` of consumers that :func:`nested_consumers` pairs with any other.

    Of the names on the other side the least and the greatest tell whether one
    is another's, so names that share a filter are not paired.
    """
    p = _nested_filters(_filters_of(consumers))
    side = lambda end, other: F.struct(F.col(end).alias("filter"), F.col(f"{other}_lo").alias("lo"), F.col(f"{other}_hi").alias("hi"))
    kin = (
        p.select("stream", F.explode(F.array(side("inner", "outer"), side("outer", "inner"))).alias("k"))
        .groupBy("stream", F.col("k.filter").alias("filter"))
        .agg(F.min("k.lo").alias("lo"), F.max("k.hi").alias("hi"))
    )
    return consumers.join(kin, ["stream", "filter"]).where("lo <> name OR hi <> name").select("stream", "name").distinct()


def stream_verdicts(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """Create-stream requests with ``verdict``: created, exists, or why not.

    Requests of one table that overlap refuse each other; those that are
    invalid by themselves count for nothing.
    """
    have = streams.select("name", F.col("filter").alias("__have"))
    checked = requests.join(have, "name", "left")
    sound = requests.where(S.valid_name("name") & S.valid_subject("filter") & (F.col("filter") != ">"))
    others = sound.select("name", "filter").withColumn("__new", F.lit(1)).unionByName(
        streams.select("name", "filter").join(sound.select("name"), "name", "left_anti").withColumn("__new", F.lit(0))
    )
    clash = overlapping_streams(others)
    clash = clash.select(F.col("a").alias("name")).union(clash.select(F.col("b").alias("name"))).distinct().withColumn("__clash", F.lit(True))
    verdict = (
        F.when(S.name_error("name").isNotNull(), F.concat(F.lit("name_"), S.name_error("name")))
        .when(F.coalesce("filter", F.lit("")) == "", "filter_missing")
        .when(S.subject_error("filter").isNotNull(), F.concat(F.lit("filter_"), S.subject_error("filter")))
        .when(F.col("filter") == ">", "filter_too_wide")
        .when(F.col("__have").isNotNull() & (F.col("__have") != F.col("filter")), "filter_changed")
        .when(F.col("__have").isNotNull(), "exists")
        .when(F.col("__clash"), "filter_overlaps")
        .otherwise("created")
    )
    return checked.join(clash, "name", "left").withColumn("verdict", verdict).drop("__have", "__clash")


def create_streams(requests: DataFrame, streams: DataFrame, last_seq: int = 0) -> DataFrame:
    """The streams afterwards; a new one is born behind the last seq, so old rows are not its own."""
    new = stream_verdicts(requests, streams).where("verdict = 'created'").withColumn("created_at_seq", F.lit(last_seq + 1).cast("long"))
    return streams.unionByName(new.select(*streams.columns), allowMissingColumns=True)


def delete_streams(names: list[str], streams: DataFrame, consumers: DataFrame, subscriptions: DataFrame, bindings: DataFrame) -> dict[str, DataFrame]:
    """The catalog without some streams and all that hangs on them."""
    gone = consumers.where(F.col("stream").isin(names))
    return {
        "streams": streams.where(~F.col("name").isin(names)),
        **delete_consumers(gone.select("consumer_id"), consumers, subscriptions, bindings),
    }


def with_inherited_filter(consumers: DataFrame, streams: DataFrame) -> DataFrame:
    """Consumers without a filter have their stream's; a group defaults to the name and then the stream."""
    s = streams.select(F.col("name").alias("stream"), F.col("filter").alias("__f"))
    first = F.coalesce(F.nullif("group_name", F.lit("")), F.nullif("name", F.lit("")), F.col("stream"))
    return (
        consumers.join(s, "stream", "left")
        .withColumn("filter", F.coalesce(F.nullif("filter", F.lit("")), "__f"))
        .withColumn("group_name", first)
        .drop("__f")
    )


def consumer_verdicts(requests: DataFrame, streams: DataFrame, consumers: DataFrame) -> DataFrame:
    """Create-consumer requests with ``verdict``: created, same, mismatch, or why not."""
    s = streams.select(F.col("name").alias("stream"), F.col("filter").alias("__stream_filter"))
    grouped = F.coalesce(F.col("group_name"), F.lit("")) != ""
    full = with_inherited_filter(requests.withColumn("__group", grouped), streams).join(s, "stream", "left")
    have = consumers.select("stream", "name", F.struct(*CONSUMER_CONFIG).alias("__have"))
    siblings = full.select("stream", "name", "filter").unionByName(consumers.select("stream", "name", "filter"))
    nested = in_nesting(siblings).withColumn("__nested", F.lit(True))
    explicit = F.col("ack_policy") == "explicit"
    verdict = (
        F.when(F.col("__stream_filter").isNull(), "stream_unknown")
        .when(S.name_error("name").isNotNull(), F.concat(F.lit("name_"), S.name_error("name")))
        .when(~F.col("__group"), "group_missing")
        .when(F.coalesce("ack_policy", F.lit("")) == "", "ack_policy_missing")
        .when(~explicit & ((F.col("max_inflight") > 0) | (F.coalesce("ack_wait_ms", F.lit(0)) > 0)), "needs_explicit_acks")
        .when((F.col("deliver_policy") == "by_start_seq") & (F.coalesce("start_seq", F.lit(0)) <= 0), "start_seq_missing")
        .when(S.subject_error("filter").isNotNull(), F.concat(F.lit("filter_"), S.subject_error("filter")))
        .when(~S.covers("__stream_filter", "filter"), "filter_outside_stream")
        .when(F.col("__have").isNotNull(), F.when(F.col("__have") == F.struct(*CONSUMER_CONFIG), "same").otherwise("mismatch"))
        .when(F.col("__nested"), "filter_nested")
        .otherwise("created")
    )
    return (
        full.join(have, ["stream", "name"], "left")
        .join(nested, ["stream", "name"], "left")
        .withColumn("verdict", verdict)
        .drop("__stream_filter", "__group", "__have", "__nested")
    )


def create_consumers(requests: DataFrame, streams: DataFrame, consumers: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """The consumers afterwards; policy New is stamped with its stream's tail."""
    new = consumer_verdicts(requests, streams, consumers).where("verdict = 'created'").drop("verdict")
    if tails is not None:
        new = new.join(tails.select("stream", F.col("last_seq").alias("__tail")), "stream", "left").withColumn(
            "start_seq", F.when(F.col("deliver_policy") == "new", F.coalesce("__tail", F.lit(0))).otherwise(F.col("start_seq"))
        ).drop("__tail")
    return consumers.unionByName(new.select(*consumers.columns))


def delete_consumers(ids: DataFrame, consumers: DataFrame, subscriptions: DataFrame, bindings: DataFrame) -> dict[str, DataFrame]:
    """The catalog without some consumers, their subscriptions and bindings."""
    gone = ids.select("consumer_id").distinct()
    return {
        "consumers": consumers.join(gone, "consumer_id", "left_anti"),
        "subscriptions": subscriptions.join(gone, "consumer_id", "left_anti"),
        "bindings": bindings.join(gone, "consumer_id", "left_anti"),
    }


def subscription_verdicts(requests: DataFrame, consumers: DataFrame) -> DataFrame:
    """Subscribe requests of ``request_id, consumer_id, filters`` with ``verdict`` for each entry.

    Filters must lie within the consumer's; those of siblings may nest.  A
    batch holds at most so many entries.
    """
    c = consumers.select("consumer_id", F.col("filter").alias("__wide"))
    valid = F.forall("filters", lambda f: f.rlike(S.SUBJECT))
    inside = F.forall("filters", lambda f: S.covers(F.col("__wide"), f))
    verdict = (
        F.when(F.col("__wide").isNull(), "consumer_unknown")
        .when(F.coalesce(F.size("filters"), F.lit(0)) > MAX_BATCH_SUBSCRIPTIONS, "too_many")
        .when(F.coalesce(F.size("filters"), F.lit(0)) <= 0, "subscribed")
        .when(~valid, "filter_invalid")
        .when(~inside, "filter_outside_consumer")
        .otherwise("subscribed")
    )
    return requests.join(c, "consumer_id", "left").withColumn("verdict", verdict).drop("__wide")


def batch_reply(verdicts: DataFrame) -> DataFrame:
    """``batch_id, error, rejected``: one error if all entries fail alike, else how many failed."""
    bad = F.col("verdict") != "subscribed"
    return verdicts.groupBy("batch_id").agg(
        F.when(F.bool_and(bad) & (F.min("verdict") == F.max("verdict")), F.max("verdict")).alias("error"),
        F.sum(bad.cast("long")).alias("rejected"),
    )


def bound(bindings: DataFrame) -> DataFrame:
    """One binding for each subscription: the latest replaces those before it."""
    w = Window.partitionBy("subscription_id").orderBy(F.desc("bound_at"), F.desc("binding_id"))
    return bindings.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def unsubscribe(bindings: DataFrame, consumer_ids: list[int]) -> DataFrame:
    """Without all bindings of some consumers: that is what leaving a subscription does."""
    return bindings.where(~F.col("consumer_id").isin(consumer_ids))


def drop_subscriptions(subscriptions: DataFrame, ids: list[int]) -> DataFrame:
    return subscriptions.where(~F.col("subscription_id").isin(ids))


def drop_connections(connections: list[int], catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalog's tables without what belongs to some connections."""
    keep = lambda t: t.where(~F.col("connection_id").isin(connections)) if "connection_id" in t.columns else t
    return {name: keep(t) for name, t in catalog.items()}


def upsert(requests: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows, and those requests whose key is new."""
    return rows.unionByName(requests.select(*rows.columns).join(rows.select(*key), key, "left_anti"))


def snapshot(streams: DataFrame, consumers: DataFrame, subscriptions: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row for each bound subscription, with what delivery asks of its consumer and stream."""
    s = streams.select(F.col("name").alias("stream"), "max_age_ms", "created_at_seq")
    c = consumers.select("consumer_id", "group_name", "mode", "ack_policy", "max_inflight", "paused")
    b = bound(bindings).select("subscription_id", "binding_id", "connection_id")
    return subscriptions.drop("connection_id").join(b, "subscription_id").join(c, "consumer_id").join(s, "stream")
