"""Who receives what.

Matching is done once for each distinct subject and joined back to the
messages.  A pattern is an equi-join on its literal head: subjects are
exploded to their token prefixes of the lengths that occur in patterns, and
only what the head cannot decide is compared token by token.  So no plan holds
a nested-loop join over messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import subjects as S
from ..storage import unused

#: Order of a subject's matches.
_CLASS = {"exact": 0, "catch_all": 1, "pattern": 2}


def subscription_filters(subscriptions: DataFrame) -> DataFrame:
    """One row for each filter, with its class and literal head; no filters mean every subject."""
    f = F.explode(F.when(F.coalesce(F.size("filters"), F.lit(0)) <= 0, F.array(F.lit(""))).otherwise(F.col("filters")))
    rows = subscriptions.select(*[c for c in subscriptions.columns if c != "filters"], f.alias("filter"))
    rows = rows.withColumn("kind", S.filter_kind("filter"))
    head = F.regexp_extract("filter", r"^((?:[^.*>]+\.)*)(?:[*>].*)?$", 1)
    return rows.withColumn("head", F.when(F.col("kind") == "pattern", F.rtrim(head, F.lit("."))).otherwise("")).withColumn(
        "depth", F.when(F.col("head") == "", 0).otherwise(F.size(S.tokens("head")))
    )


def match_subjects(subjects: DataFrame, filters: DataFrame) -> DataFrame:
    """Distinct ``stream, subject`` with the subscriptions that they match, each once.

    ``subjects`` has stream and subject; ``filters`` comes from
    :func:`subscription_filters`.  The columns of a subscription follow, and
    ``class``, its best way of matching.
    """
    f = filters.withColumnRenamed("stream", "f_stream")
    exact = subjects.join(
        f.where("kind = 'exact'"), (F.col("stream") == F.col("f_stream")) & (F.col("subject") == F.col("filter"))
    )
    every = subjects.join(f.where("kind = 'catch_all'"), F.col("stream") == F.col("f_stream"))
    # patterns have at most as many heads as tokens; the distinct lengths are few
    depths = sorted(r[0] for r in filters.where("kind = 'pattern'").select("depth").distinct().collect())
    heads = F.filter(
        F.transform(
            F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>"),
            lambda d: F.when(
                d < F.size(S.tokens("subject")),
                F.struct(d.alias("depth"), F.array_join(F.slice(S.tokens("subject"), 1, d), ".").alias("head")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    keyed = subjects.select("stream", "subject", F.explode(heads).alias("k"))
    wild = keyed.join(
        f.where("kind = 'pattern'"),
        (F.col("stream") == F.col("f_stream")) & (F.col("k.depth") == F.col("depth")) & (F.col("k.head") == F.col("head")),
    ).where(S.matches("filter", "subject"))
    ids = [c for c in filters.columns if c not in ("stream", "filter", "kind", "head", "depth")]
    names = ["stream", "subject", *ids, "kind"]
    found = exact.select(*names).unionByName(every.select(*names)).unionByName(wild.select(*names))
    rank = F.create_map(*[x for k, v in _CLASS.items() for x in (F.lit(k), F.lit(v))])
    return found.groupBy("stream", "subject", *ids).agg(F.min(F.element_at(rank, F.col("kind"))).alias("class"))


def distinct_subjects(messages: DataFrame) -> DataFrame:
    """What matching needs of a log."""
    return messages.select("stream", "subject").distinct()


def match(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every message with each subscription that it matches, once."""
    found = match_subjects(distinct_subjects(messages), subscription_filters(subscriptions))
    return messages.join(found, ["stream", "subject"])


def recipients(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``subject`` groups as arrays: messages with ``matches``, ordered exact, catch-all, pattern.

    The array is made for each distinct subject, so that a message costs one
    join row whatever the number of its recipients.
    """
    found = match_subjects(distinct_subjects(messages), subscription_filters(subscriptions))
    ids = [c for c in found.columns if c not in ("stream", "subject", "class")]
    each = F.struct("class", "subscription_id", *[c for c in ids if c != "subscription_id"])
    grouped = found.groupBy("stream", "subject").agg(F.sort_array(F.collect_list(each)).alias("matches"))
    return messages.join(grouped, ["stream", "subject"])


def with_demand(messages: DataFrame, bindings: DataFrame) -> DataFrame:
    """Messages of streams that somebody is bound to."""
    return messages.join(bindings.select("stream").distinct(), "stream", "left_semi")


# ---- row filters of a delivery


def live(max_age_ms: Column, now_ms: int, ts_ms: Column | None = None) -> Column:
    """Not yet expired; no age or no time never expires."""
    ts = F.col("ts_ms") if ts_ms is None else ts_ms
    return ~((F.coalesce(max_age_ms, F.lit(0)) > 0) & (ts > 0) & (ts + max_age_ms <= now_ms))


def not_tombstoned(flags: Column | None = None) -> Column:
    return (F.col("flags") if flags is None else flags).bitwiseAND(1) == 0


def of_this_incarnation(created_at_seq: Column) -> Column:
    """Not left behind by a deleted stream of the same id."""
    return F.col("seq") >= created_at_seq


def deliverable(messages: DataFrame, streams: DataFrame, now_ms: int, global_max_age_ms: int = 0) -> DataFrame:
    """Rows that may be delivered at all: live, not deleted, of the stream's present life."""
    dims = streams.select(
        F.col("name").alias("stream"), F.coalesce(F.nullif("max_age_ms", F.lit(0)), F.lit(global_max_age_ms)).alias("__age"), "created_at_seq"
    )
    return (
        messages.join(dims, "stream")
        .where(live(F.col("__age"), now_ms) & not_tombstoned() & of_this_incarnation(F.col("created_at_seq")))
        .drop("__age", "created_at_seq")
    )


def deliver_floor(policy: Column, tail_at_creation: Column, start_seq: Column) -> Column:
    """Rows above it are owed: all, those after creation, or those from a start."""
    return F.when(policy == "new", tail_at_creation).when(policy == "by_start_seq", start_seq - 1).otherwise(F.lit(0))


def unsuppressed(offers: DataFrame, floors: DataFrame, done: DataFrame) -> DataFrame:
    """Offers above a consumer's ack floor that it neither has nor had."""
    return (
        offers.join(floors.select("consumer_id", "floor"), "consumer_id", "left")
        .where(F.col("seq") > F.coalesce("floor", F.lit(0)))
        .drop("floor")
        .join(done.select("consumer_id", "seq"), ["consumer_id", "seq"], "left_anti")
    )


# ---- dispatch


def fanout(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every matching subscription is owed the message."""
    return match(messages, subscriptions)


def wire_rows(owed: DataFrame) -> DataFrame:
    """One copy for each connection and consumer; siblings share it."""
    return owed.dropDuplicates(["stream", "seq", "connection_id", "consumer_id"])


def queue_picks(matched: DataFrame, eligible: object | None = None) -> DataFrame:
    """Of each queue one member for each message of :func:`recipients`.

    Candidates are tried in a circle from ``seq % n`` over all matches of the
    message, whatever their queue; the first that is eligible is served.
    ``eligible`` takes a match and gives a condition (not paused, writer well,
    room left, ...).
    """
    n = F.size("matches")
    placed = F.transform(
        "matches",
        lambda m, pos: F.struct(
            F.pmod(pos - F.pmod(F.col("seq"), n), n).alias("turn"), m["queue"].alias("queue"),
            m["subscription_id"].alias("subscription_id"), m["consumer_id"].alias("consumer_id"),
        ),
    )
    able = F.filter("matches", eligible) if eligible else None
    if able is not None:
        ids = F.transform(able, lambda m: m["subscription_id"])
        placed = F.filter(placed, lambda p: F.array_contains(ids, p["subscription_id"]))
    placed = F.filter(placed, lambda p: p["queue"].isNotNull())
    queues = F.array_distinct(F.transform("__placed", lambda p: p["queue"]))
    first = lambda q: F.array_min(F.filter("__placed", lambda p: p["queue"] == q))
    keep = [c for c in matched.columns if c != "matches"]
    return (
        matched.withColumn("__placed", placed)
        .select(*keep, F.explode(F.transform(queues, first)).alias("__pick"))
        .select(*keep, "__pick.queue", "__pick.subscription_id", "__pick.consumer_id")
    )


def sibling_fanout(deliveries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A consumer's delivery for each of its subscriptions that accepts the subject."""
    filters = subscription_filters(subscriptions).withColumnRenamed("consumer_id", "f_consumer")
    found = match_subjects(distinct_subjects(deliveries), filters)
    return (
        deliveries.join(found, ["stream", "subject"]).where(F.col("consumer_id") == F.col("f_consumer")).drop("f_consumer", "class")
    )


# ---- limits


def resolve_limits(subjects: DataFrame, limits: DataFrame) -> DataFrame:
    """``stream, subject, limit``: the last literal limit, else the least of the patterns that match, else null."""
    last = Window.partitionBy("stream", "pattern").orderBy(F.desc("written"))
    one = limits.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    filters = subscription_filters(
        one.select("stream", F.monotonically_increasing_id().alias("subscription_id"), "limit", F.array("pattern").alias("filters"))
    )
    found = match_subjects(subjects.select("stream", "subject").distinct(), filters)
    literal = F.max(F.when(F.col("class") == _CLASS["exact"], F.col("limit")))
    least = F.min(F.when(F.col("class") != _CLASS["exact"], F.col("limit")))
    resolved = found.groupBy("stream", "subject").agg(F.coalesce(literal, least).alias("limit"))
    return subjects.select("stream", "subject").distinct().join(resolved, ["stream", "subject"], "left")


# ---- acknowledgements and replies


def acked_pendings(acks: DataFrame, pendings: DataFrame) -> DataFrame:
    """The pending that each ack releases: by its binding where it names one, else by consumer and seq."""
    p = pendings.select("consumer_id", "seq", F.col("binding_id").alias("p_binding"))
    named = acks.where(F.col("binding_id").isNotNull()).join(p, ["consumer_id", "seq"]).where(F.col("binding_id") == F.col("p_binding"))
    loose = acks.where(F.col("binding_id").isNull()).join(
        p.groupBy("consumer_id", "seq").agg(F.min("p_binding").alias("p_binding")), ["consumer_id", "seq"]
    )
    return named.unionByName(loose).drop("binding_id").withColumnRenamed("p_binding", "binding_id").distinct()


def owned_batches(acks: DataFrame, owners: DataFrame) -> DataFrame:
    """Acks of the batches in which every consumer belongs to the connection; one foreign entry refuses all."""
    checked = acks.join(owners.select("connection_id", "consumer_id", F.lit(True).alias("__own")), ["connection_id", "consumer_id"], "left")
    whole = checked.groupBy("batch_id").agg(F.bool_and(F.col("__own").isNotNull()).alias("__ok")).where("__ok").select("batch_id")
    return acks.join(whole, "batch_id", "left_semi")


def late_releases(delivered: DataFrame, bindings: DataFrame) -> DataFrame:
    """Deliveries whose binding is gone: they are reversed."""
    return delivered.join(bindings.select("binding_id"), "binding_id", "left_anti")


def correlate(requests: DataFrame, replies: DataFrame, timeout_ms: int) -> DataFrame:
    """Requests with the first reply of their correlation id within the timeout; ``outcome`` is reply or timeout.

    Each row of the requests is a row of the result, repeated ones too: replies
    are reduced to one for each distinct (correlation id, time) that asks, and
    requests then look theirs up.  Of replies of one time that of the least
    payload counts; a null correlation id has no reply.
    """
    rid, asked = unused(requests, "__rid", "__asked")
    r = replies.select(F.col("correlation_id").alias(rid), F.col("ts_ms").alias("reply_ms"), F.col("payload").alias("reply"))
    asks = requests.select(F.col("correlation_id").alias("__id"), F.col("ts_ms").alias(asked)).distinct()
    first = (
        asks.join(r, (F.col("__id") == F.col(rid)) & F.col("reply_ms").between(F.col(asked), F.col(asked) + timeout_ms))
        .groupBy(rid, asked)
        .agg(F.min(F.struct("reply_ms", "reply")).alias("__first"))
        .select(rid, asked, "__first.reply", "__first.reply_ms")
    )
    same = (requests["correlation_id"] == first[rid]) & (requests["ts_ms"] == first[asked])
    return (
        requests.join(first, same, "left")
        .drop(rid, asked)
        .withColumn("outcome", F.when(F.col("reply_ms").isNotNull(), "reply").otherwise("timeout"))
    )
