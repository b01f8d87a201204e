"""Queries that exercise the operators on the input tables, each with equal SQL where SQL can say it.

Dimension tables (subscriptions, consumers, limits) are small literals, the
same on both sides.  "Now" is always a literal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import subjects as S
from ..operators import acks, catalog, credit, dedup, metrics, retention, routing, schedule, workflow
from ..sources import log as L
from ..sources import sinks
from ..sources.tables import event_messages, order_messages, table
from ..storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_MS = 1_705_276_800_000  # 2024-01-15 00:00:00 UTC
DAY_MS = 86_400_000

#: subscription, consumer, connection, queue, filters
SUBSCRIPTIONS = [
    (1, 1, 1, None, ["events.click.u1"]),
    (2, 1, 1, None, ["events.click.>"]),
    (3, 2, 1, "q1", ["events.*.u2"]),
    (4, 3, 2, "q1", ["events.>"]),
    (5, 4, 2, "q1", []),
    (6, 5, 3, "q2", ["events.view.*", "events.view.u3", "events.error.>"]),
    (7, 6, 3, "q2", ["events.*.*"]),
    (8, 7, 3, None, ["orders.>"]),
]
CONSUMERS = [  # consumer, max_inflight, paused
    (1, 50, False), (2, 0, False), (3, 500, False), (4, 1000, True), (5, 200, False), (6, 300, False),
]
LIMITS = [("events.click.>", 5, 1), ("events.*.u1", 3, 2), ("events.click.u1", 7, 3), ("events.click.u1", 9, 4), ("events.error.*", 2, 5)]

_M = """m AS (
  SELECT event_id + 1 AS seq, 'events' AS stream, 'events.' || event_type || '.u' || CAST(user_id AS VARCHAR) AS subject,
    epoch_us(ts) // 1000 AS ts_ms, props AS payload, CAST(strlen(props) AS BIGINT) AS nbytes, event_type, user_id, value
  FROM events)"""
_O = r"""o AS (
  SELECT o_orderkey AS seq, 'orders' AS stream,
    'orders.' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') || '.c' || CAST(o_custkey AS VARCHAR) AS subject,
    epoch_us(o_orderdate) // 1000 AS ts_ms, CAST(strlen(o_orderstatus) AS BIGINT) AS nbytes
  FROM orders)"""


def _filter_rows() -> str:
    rows = []
    for sub, consumer, connection, queue, filters in SUBSCRIPTIONS:
        for f in filters or [""]:
            kind = "catch_all" if not f else "pattern" if "*" in f or f.endswith(">") else "exact"
            regex = "^.*$" if not f else S.pattern_regex(f)
            rank = {"exact": 0, "catch_all": 1, "pattern": 2}[kind]
            stream = "orders" if f.startswith("orders") else "events"
            q = f"'{queue}'" if queue else "NULL"
            rows.append(f"({sub}, {consumer}, {connection}, {q}, '{stream}', {rank}, '{regex}')")
    return ", ".join(rows)


_F = f"""f(sub, consumer, connection, queue, stream, rank, regex) AS (VALUES {_filter_rows()})"""
_MATCH = """x AS (
  SELECT m.seq, m.subject, f.sub, f.consumer, f.connection, f.queue, min(f.rank) AS rank
  FROM m JOIN f ON m.stream = f.stream AND regexp_matches(m.subject, f.regex)
  GROUP BY ALL)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def subscriptions(spark: SparkSession) -> DataFrame:
    rows = [(s, c, n, q, "orders" if f and f[0].startswith("orders") else "events", f) for s, c, n, q, f in SUBSCRIPTIONS]
    return spark.createDataFrame(
        rows, "subscription_id long, consumer_id long, connection_id long, queue string, stream string, filters array<string>"
    )


def consumers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSUMERS, "consumer_id long, max_inflight long, paused boolean")


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("events", *r) for r in LIMITS], "stream string, pattern string, limit long, written long")


# ---- scans and predicates


@query(f"WITH {_M} SELECT seq, subject, ts_ms, nbytes FROM m WHERE seq >= 100 AND seq < 400")
def scan_range(spark, d):
    """A range of seq, without payloads."""
    return L.view_scan(event_messages(spark, d), 100, 400).select("seq", "subject", "ts_ms", "nbytes")


@query(f"WITH {_M} SELECT seq, subject, payload FROM m WHERE seq = 777")
def scan_lookup(spark, d):
    return L.lookup(event_messages(spark, d), 777).select("seq", "subject", "payload")


@query(f"WITH {_M} SELECT min(seq) AS seq FROM m WHERE seq >= 500")
def scan_lower_bound(spark, d):
    return L.lower_bound(event_messages(spark, d), 500)


@query(f"WITH {_M} SELECT seq, subject FROM m WHERE seq > 1000 ORDER BY seq LIMIT 256")
def drain_window(spark, d):
    """The feed window behind a cursor; the limit is the operator."""
    return L.feed(event_messages(spark, d), 1000).select("seq", "subject")


@query(f"WITH {_M}, {_O} SELECT stream, count(*) AS messages, CAST(sum(nbytes) AS BIGINT) AS bytes, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT stream, seq, nbytes FROM m UNION ALL SELECT stream, seq, nbytes FROM o) GROUP BY stream")
def store_info_by_stream(spark, d):
    both = event_messages(spark, d).select("stream", "seq", "nbytes").unionByName(order_messages(spark, d).select("stream", "seq", "nbytes"))
    return L.store_info(both, "stream")


def _subject_query(name: str, pattern: str) -> None:
    def run(spark, d):
        m = event_messages(spark, d)
        return m.where(S.subject_matches("subject", pattern)).select("seq", "subject")

    run.__name__ = name
    query(f"WITH {_M} SELECT seq, subject FROM m WHERE regexp_matches(subject, '{S.pattern_regex(pattern)}')")(run)


for _name, _pattern in (("subject_exact", "events.click.u1"), ("subject_star", "events.*.u1"), ("subject_gt", "events.click.>")):
    _subject_query(_name, _pattern)

_PATTERNS = ["events.*.u1", "events.>", "events.click.u1", "events.click.*", "*.click.>", "orders.>", ">", "events.*", "*.*.*"]


def _covers(a: str, b: str) -> bool:
    x, y = a.split("."), b.split(".")
    for i, t in enumerate(x):
        if t == ">":
            return len(y) > i
        if i >= len(y) or y[i] == ">" or (t != "*" and t != y[i]):
            return False
    return len(x) == len(y)


def _overlap(a: str, b: str) -> bool:
    x, y = a.split("."), b.split(".")
    for i in range(max(len(x), len(y))):
        if i >= len(x) or i >= len(y):
            return False
        if ">" in (x[i], y[i]):
            return True
        if "*" not in (x[i], y[i]) and x[i] != y[i]:
            return False
    return True


_RELATION_ROWS = ", ".join(
    f"('{a}', '{b}', {_covers(a, b)}, {_overlap(a, b)}, {_covers(a, b) and not _covers(b, a)})" for a in _PATTERNS for b in _PATTERNS
)


@query(f"SELECT * FROM (VALUES {_RELATION_ROWS}) AS t(a, b, wider, meets, nested)")
def pattern_relations(spark, d):
    """Covering, overlap and strict nesting of pairs of patterns."""
    pairs = spark.createDataFrame([(a, b) for a in _PATTERNS for b in _PATTERNS], "a string, b string")
    return pairs.select(
        "a", "b", S.covers("a", "b").alias("wider"), S.overlaps("a", "b").alias("meets"), S.strictly_nested("b", "a").alias("nested")
    )


@query(rf"""WITH {_O}, s AS (SELECT subject FROM o UNION ALL SELECT 'orders.' || o_orderpriority FROM orders)
SELECT subject, regexp_matches(subject, '^([A-Za-z0-9_-]+|\*)(\.([A-Za-z0-9_-]+|\*))*(\.>)?$') AS valid, count(*) AS n FROM s GROUP BY ALL""")
def subject_validation(spark, d):
    raw = table(spark, d, "orders").select(F.concat(F.lit("orders."), "o_orderpriority").alias("subject"))
    return order_messages(spark, d).select("subject").unionByName(raw).groupBy("subject").agg(F.count("*").alias("n")).select(
        "subject", S.valid_subject("subject").alias("valid"), "n"
    )


@query(f"WITH {_M} SELECT event_type, count(*) AS live FROM m WHERE NOT (ts_ms > 0 AND ts_ms + CASE event_type WHEN 'click' THEN {7 * DAY_MS} WHEN 'view' THEN 0 ELSE {2 * DAY_MS} END <= {NOW_MS} AND event_type <> 'view') GROUP BY event_type")
def ttl_live(spark, d):
    age = F.when(F.col("event_type") == "click", 7 * DAY_MS).when(F.col("event_type") == "view", 0).otherwise(2 * DAY_MS)
    return event_messages(spark, d).where(routing.live(age, NOW_MS)).groupBy("event_type").agg(F.count("*").alias("live"))


@query(f"WITH {_M} SELECT 'all' AS policy, count(*) AS n, min(seq) AS first_seq FROM m UNION ALL SELECT 'new', count(*), min(seq) FROM m WHERE seq > 5000 UNION ALL SELECT 'by_start_seq', count(*), min(seq) FROM m WHERE seq > 299")
def deliver_floor(spark, d):
    policies = spark.createDataFrame([("all", 5000, 300), ("new", 5000, 300), ("by_start_seq", 5000, 300)], "policy string, tail long, start long")
    floors = policies.select("policy", routing.deliver_floor(F.col("policy"), F.col("tail"), F.col("start")).alias("floor"))
    m = event_messages(spark, d).select("seq")
    return m.join(F.broadcast(floors), F.col("seq") > F.col("floor"), "right").groupBy("policy").agg(
        F.count("seq").alias("n"), F.min("seq").alias("first_seq")
    )


@query(f"WITH {_M} SELECT event_type, count(*) AS n FROM m WHERE seq % 13 <> 0 AND seq >= 2000 AND ts_ms + {20 * DAY_MS} > {NOW_MS + 10 * DAY_MS} GROUP BY event_type")
def deliverable_rows(spark, d):
    """Expiry, tombstones and incarnation together."""
    streams = spark.createDataFrame([("events", 20 * DAY_MS, 2000)], "name string, max_age_ms long, created_at_seq long")
    m = retention.tombstone(event_messages(spark, d), F.col("seq") % 13 == 0)
    return routing.deliverable(m, streams, NOW_MS + 10 * DAY_MS).groupBy("event_type").agg(F.count("*").alias("n"))


# ---- routing


@query(f"WITH {_M}, {_O}, {_F}, a AS (SELECT seq, stream, subject FROM m UNION ALL SELECT seq, stream, subject FROM o), x AS (SELECT DISTINCT a.stream, a.seq, f.sub, f.consumer FROM a JOIN f ON a.stream = f.stream AND regexp_matches(a.subject, f.regex)) SELECT consumer AS consumer_id, count(*) AS owed, count(DISTINCT seq) AS messages FROM x GROUP BY consumer")
def route_fanout_counts(spark, d):
    """Who receives what: messages and owed copies of each consumer."""
    names = ("seq", "stream", "subject")
    m = event_messages(spark, d).select(*names).unionByName(order_messages(spark, d).select(*names))
    return routing.fanout(m, subscriptions(spark)).groupBy("consumer_id").agg(
        F.count("*").alias("owed"), F.countDistinct("seq").alias("messages")
    )


@query(f"WITH {_M}, {_F}, {_MATCH} SELECT sub AS subscription_id, rank AS class, count(*) AS n FROM x GROUP BY ALL")
def route_dedup_overlap(spark, d):
    """A subscription that matches in several ways counts once."""
    m = event_messages(spark, d).select("seq", "stream", "subject")
    return routing.match(m, subscriptions(spark)).groupBy("subscription_id", "class").agg(F.count("*").alias("n"))


@query(f"WITH {_M}, {_F}, {_MATCH} SELECT connection AS connection_id, consumer AS consumer_id, count(DISTINCT seq) AS copies FROM x GROUP BY ALL")
def route_wire_rows(spark, d):
    m = event_messages(spark, d).select("seq", "stream", "subject")
    wire = routing.wire_rows(routing.fanout(m, subscriptions(spark)))
    return wire.groupBy("connection_id", "consumer_id").agg(F.count("*").alias("copies"))


_QUEUE = """p AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY rank, sub) - 1 AS pos, count(*) OVER (PARTITION BY seq) AS n FROM x),
t AS (SELECT *, (pos - seq % n + n) % n AS turn FROM p WHERE queue IS NOT NULL)"""


@query(f"WITH {_M}, {_F}, {_MATCH}, {_QUEUE} SELECT queue, sub AS subscription_id, count(*) AS served FROM (SELECT *, row_number() OVER (PARTITION BY seq, queue ORDER BY turn) AS r FROM t) WHERE r = 1 GROUP BY ALL")
def queue_round_robin(spark, d):
    """One member of each queue for each message, in a circle."""
    m = event_messages(spark, d).select("seq", "stream", "subject")
    picks = routing.queue_picks(routing.recipients(m, subscriptions(spark)))
    return picks.groupBy("queue", "subscription_id").agg(F.count("*").alias("served"))


@query(f"WITH {_M}, {_F}, {_MATCH}, {_QUEUE} SELECT queue, sub AS subscription_id, count(*) AS served FROM (SELECT *, row_number() OVER (PARTITION BY seq, queue ORDER BY turn) AS r FROM t WHERE consumer NOT IN (4, 6)) WHERE r = 1 GROUP BY ALL")
def queue_skips_paused(spark, d):
    """Members that cannot take a message yield to their siblings."""
    m = event_messages(spark, d).select("seq", "stream", "subject")
    able = lambda x: ~x["consumer_id"].isin(4, 6)
    picks = routing.queue_picks(routing.recipients(m, subscriptions(spark)), able)
    return picks.groupBy("queue", "subscription_id").agg(F.count("*").alias("served"))


_LIMIT_ROWS = ", ".join(
    f"('{p}', {lim}, {w}, {'*' not in p and '>' not in p}, '{S.pattern_regex(p)}')" for p, lim, w in LIMITS
)
_LIM = f"""l(pattern, lim, written, literal, regex) AS (VALUES {_LIMIT_ROWS}),
lr AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY written DESC) = 1),
s AS (SELECT DISTINCT subject FROM m),
r AS (SELECT subject, CAST(coalesce(max(lim) FILTER (WHERE literal), min(lim) FILTER (WHERE NOT literal)) AS BIGINT) AS lim
  FROM s LEFT JOIN lr ON regexp_matches(s.subject, lr.regex) GROUP BY subject)"""


@query(f"WITH {_M}, {_LIM} SELECT subject, lim AS \"limit\" FROM r")
def subject_limit_resolve(spark, d):
    """A literal limit wins, else the least that matches."""
    m = event_messages(spark, d)
    return routing.resolve_limits(m, limits(spark)).select("subject", "limit")


@query(f"WITH {_M}, {_F}, {_MATCH} SELECT DISTINCT consumer AS consumer_id, seq, subject FROM x WHERE consumer IN (1, 3)")
def sibling_filters(spark, d):
    """What a client hands to the subscriptions of one consumer, as (consumer, message)."""
    m = event_messages(spark, d).select("seq", "stream", "subject")
    deliveries = m.crossJoin(F.broadcast(spark.createDataFrame([(1,), (3,)], "consumer_id long")))
    return routing.sibling_fanout(deliveries, subscriptions(spark)).select("consumer_id", "seq", "subject").distinct()


# ---- credit


def _owed(spark, d) -> DataFrame:
    m = event_messages(spark, d).select("seq", "stream", "subject")
    owed = routing.fanout(m, subscriptions(spark)).select("consumer_id", "seq", "stream", "subject").distinct()
    lim = routing.resolve_limits(m, limits(spark))
    return owed.join(lim, ["stream", "subject"]).join(F.broadcast(consumers(spark)), "consumer_id")


_CONSUMER_ROWS = ", ".join(f"({c}, {n}, {p})" for c, n, p in CONSUMERS)
_OWED = f"""c(consumer, max_inflight, paused) AS (VALUES {_CONSUMER_ROWS}),
w AS (SELECT DISTINCT x.consumer, x.seq, x.subject, r.lim, c.max_inflight FROM x JOIN r USING (subject) JOIN c ON c.consumer = x.consumer),
ws AS (SELECT *, row_number() OVER (PARTITION BY consumer, subject ORDER BY seq) AS rs FROM w),
wc AS (SELECT *, row_number() OVER (PARTITION BY consumer ORDER BY seq) AS rc FROM ws WHERE lim IS NULL OR rs <= lim)"""


@query(f"WITH {_M}, {_F}, {_MATCH}, {_LIM}, {_OWED} SELECT consumer AS consumer_id, count(*) AS sent, max(seq) AS last_seq FROM ws WHERE lim IS NULL OR rs <= lim GROUP BY consumer")
def credit_subject_cap(spark, d):
    return credit.subject_credit(_owed(spark, d)).groupBy("consumer_id").agg(F.count("*").alias("sent"), F.max("seq").alias("last_seq"))


@query(f"WITH {_M}, {_F}, {_MATCH}, {_LIM}, {_OWED}, a AS (SELECT *, row_number() OVER (PARTITION BY consumer ORDER BY seq) AS rc FROM w) SELECT consumer AS consumer_id, count(*) AS sent, max(seq) AS last_seq FROM a WHERE max_inflight = 0 OR rc <= max_inflight GROUP BY consumer")
def credit_consumer_cap(spark, d):
    return credit.consumer_credit(_owed(spark, d)).groupBy("consumer_id").agg(F.count("*").alias("sent"), F.max("seq").alias("last_seq"))


@query(f"WITH {_M}, {_F}, {_MATCH}, {_LIM}, {_OWED} SELECT consumer AS consumer_id, seq, subject FROM wc WHERE max_inflight = 0 OR rc <= max_inflight")
def credit_both(spark, d):
    """Two chained rank limits: what no ack would ever release."""
    return credit.credit(_owed(spark, d)).select("consumer_id", "seq", "subject")


@query(f"WITH {_M} SELECT subject, seq FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seq) AS r FROM m) WHERE r <= 3")
def credit_known_cap(spark, d):
    """A limit known to the plan is applied before the shuffle."""
    return credit.capped(event_messages(spark, d), ["subject"], 3).select("subject", "seq")


@query(f"WITH {_M}, {_F}, {_MATCH}, {_LIM}, {_OWED}, z AS (SELECT consumer, seq FROM wc WHERE max_inflight = 0 OR rc <= max_inflight) SELECT w.consumer AS consumer_id, coalesce(min(w.seq) FILTER (WHERE z.seq IS NULL) - 1, max(w.seq)) AS cursor FROM w LEFT JOIN z ON z.consumer = w.consumer AND z.seq = w.seq GROUP BY w.consumer")
def cursor_pin(spark, d):
    owed = materialize(_owed(spark, d), "owed")
    return credit.cursor_pin(owed, credit.consumer_credit(credit.subject_credit(owed)))


@query(f"WITH {_M} SELECT user_id AS connection_id, CASE WHEN count(*) > 60 THEN 'over' ELSE 'within' END AS state, count(*) AS n FROM m GROUP BY user_id HAVING count(*) > 60")
def connection_quota(spark, d):
    owned = event_messages(spark, d).select(F.col("user_id").alias("connection_id"), F.lit("streams").alias("kind"))
    return credit.over_quota(owned, 60).select("connection_id", F.lit("over").alias("state"), "n")


# ---- acks

_DELIVERED = """d AS (SELECT CAST(user_id % 20 AS BIGINT) AS consumer, seq, ts_ms FROM m),
k AS (SELECT consumer, seq, ts_ms + (seq % 11) * 7000 AS acked_ms FROM d WHERE seq % 7 <> 0)"""


def _deliveries(spark, d) -> DataFrame:
    return event_messages(spark, d).select(
        (F.col("user_id") % 20).alias("consumer_id"), "seq", F.col("ts_ms").alias("delivered_ms"), F.lit(0).alias("attempt")
    )


def _acks(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.col("seq") % 7 != 0).select(
        "consumer_id", "seq", F.lit("ack").alias("kind"), (F.col("delivered_ms") + F.col("seq") % 11 * 7000).alias("acked_ms"), F.lit(0).cast("long").alias("delay_ms")
    )


@query(f"WITH {_M}, d AS (SELECT user_id % 20 AS consumer, seq, row_number() OVER (PARTITION BY user_id % 20 ORDER BY seq) AS r FROM m), g AS (SELECT consumer, min(r) AS r FROM d WHERE seq % 97 = 0 GROUP BY consumer) SELECT d.consumer AS consumer_id, max(coalesce(g.r - 1, 0 + d.r)) FILTER (WHERE g.r IS NULL OR d.r < g.r OR d.r = 1) AS floor FROM d LEFT JOIN g USING (consumer) GROUP BY d.consumer")
def ack_floor(spark, d):
    """The unbroken run of acked rows, counted among the rows owed."""
    owed = acks.owed_rank(_deliveries(spark, d))
    return acks.ack_floor(owed.where(F.col("seq") % 97 != 0), rank="rank")


@query(f"WITH {_M}, {_DELIVERED} SELECT d.consumer AS consumer_id, d.seq, d.ts_ms + 30000 AS due_ms FROM d LEFT JOIN k ON k.consumer = d.consumer AND k.seq = d.seq AND k.acked_ms < d.ts_ms + 30000 WHERE k.seq IS NULL AND d.ts_ms + 30000 <= {NOW_MS}")
def ack_timeout_redeliver(spark, d):
    """What no ack answered in time."""
    sent = _deliveries(spark, d)
    return acks.timeouts(sent, _acks(sent), 30_000, NOW_MS).select("consumer_id", "seq", "due_ms")


@query(f"WITH {_M} SELECT CASE WHEN seq <= 1500 THEN 'ignored' WHEN seq < 2500 THEN 'below_retention' ELSE 'accepted' END AS class, count(*) AS n FROM m GROUP BY class")
def ack_batch_classify(spark, d):
    return acks.classify_batch(event_messages(spark, d), F.lit(1500), F.lit(2500))


@query(f"WITH {_M}, {_DELIVERED} SELECT d.consumer AS consumer_id, count(*) FILTER (WHERE k.seq IS NULL) AS pending FROM d LEFT JOIN k USING (consumer, seq) GROUP BY d.consumer HAVING count(*) FILTER (WHERE k.seq IS NULL) > 0")
def pending_by_consumer(spark, d):
    sent = _deliveries(spark, d)
    return credit.inflight(acks.settled(sent, _acks(sent))).withColumnRenamed("inflight", "pending")


@query(f"WITH {_M}, {_DELIVERED} SELECT consumer AS consumer_id, max(seq) AS cursor FROM k GROUP BY consumer")
def ack_cursor(spark, d):
    return acks.ack_cursor(_acks(_deliveries(spark, d)))


@query(f"WITH {_M}, {_DELIVERED}, b AS (SELECT consumer, seq FROM k WHERE seq % 3 = 0) SELECT 'ack' AS kind, count(b.seq) AS accepted, count(*) - count(b.seq) AS not_found FROM k LEFT JOIN b USING (consumer, seq)")
def ack_replies(spark, d):
    a = _acks(_deliveries(spark, d))
    return acks.ack_replies(a, a.where(F.col("seq") % 3 == 0))


@query(f"WITH {_M} SELECT user_id % 20 AS consumer_id, min(seq) AS rewind_to, count(*) AS released FROM m WHERE user_id % 5 = 1 GROUP BY user_id % 20")
def retire_bindings(spark, d):
    pendings = event_messages(spark, d).select((F.col("user_id") % 20).alias("consumer_id"), "seq", (F.col("user_id") % 5).alias("binding_id"))
    return acks.retire(pendings, spark.createDataFrame([(1,)], "binding_id long"))


@query(f"WITH {_M} SELECT user_id % 20 AS consumer_id, seq, count(*) AS nacks FROM (SELECT user_id, seq, unnest(range(seq % 6)) AS i FROM m) GROUP BY ALL HAVING count(*) > 3")
def dead_letters(spark, d):
    n = event_messages(spark, d).select(
        (F.col("user_id") % 20).alias("consumer_id"), "seq", F.lit("nack").alias("kind"),
        F.explode(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: i <= F.col("seq") % 6)),
    )
    return acks.dead_letters(n, 3)


@query(f"WITH {_M} SELECT batch AS batch_id, count(*) AS n FROM (SELECT seq // 10 AS batch, seq, user_id % 50 <> 7 AS own FROM m) GROUP BY batch HAVING bool_and(own)")
def ack_ownership(spark, d):
    """One foreign entry refuses a whole batch."""
    a = event_messages(spark, d).select(F.floor(F.col("seq") / 10).alias("batch_id"), F.lit(1).cast("long").alias("connection_id"), (F.col("user_id") % 50).alias("consumer_id"), "seq")
    owners = spark.range(50).where("id <> 7").select(F.lit(1).cast("long").alias("connection_id"), F.col("id").alias("consumer_id"))
    return routing.owned_batches(a, owners).groupBy("batch_id").agg(F.count("*").alias("n"))


# ---- dedup and time


@query(f"WITH RECURSIVE {_M}, t AS (SELECT event_type, ts_ms, min(seq) AS seq FROM m GROUP BY ALL), n AS (SELECT event_type, ts_ms, min(ts_ms) OVER (PARTITION BY event_type ORDER BY ts_ms RANGE BETWEEN 300000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t), r AS (SELECT event_type, min(ts_ms) AS ts_ms FROM t GROUP BY event_type UNION ALL SELECT n.event_type, n.nxt FROM r JOIN n USING (event_type, ts_ms) WHERE nxt IS NOT NULL) SELECT event_type, seq FROM r JOIN t USING (event_type, ts_ms)")
def dedup_window_first(spark, d):
    """The window that does not slide."""
    rows = event_messages(spark, d).select("event_type", "seq", "ts_ms")
    return dedup.first_sight(rows, ["event_type"], 300_000).where("accepted").select("event_type", "seq")


@query(f"WITH {_M}, b AS (SELECT seq // 4 AS batch, subject FROM m), t AS (SELECT batch FROM b GROUP BY batch, subject HAVING count(*) > 1) SELECT batch AS batch_id, batch NOT IN (SELECT batch FROM t) AS accepted, count(*) AS n FROM b GROUP BY batch")
def dedup_batches(spark, d):
    """A duplicate refuses its whole batch."""
    b = event_messages(spark, d).select(F.floor(F.col("seq") / 4).alias("batch_id"), "stream", F.col("subject").alias("msg_id"))
    return dedup.accepted_batches(b).groupBy("batch_id", "accepted").agg(F.count("*").alias("n"))


@query(f"WITH {_M}, x AS (SELECT payload, max(ts_ms) AS t FROM m WHERE ts_ms > {NOW_MS - DAY_MS} GROUP BY payload) SELECT payload AS msg_id, 86400000 - ({NOW_MS} - t) AS remaining_ms FROM x")
def dedup_rebuild(spark, d):
    """What a restart must still refuse."""
    m = event_messages(spark, d).withColumn("msg_id", F.col("payload"))
    return L.idempotency_rebuild(m, NOW_MS, DAY_MS).select("msg_id", "remaining_ms")


@query(f"WITH {_M}, x AS (SELECT seq AS \"offset\", ts_ms + ((seq - 1) % 10) * 60000 AS deliver_at FROM m) SELECT \"offset\", deliver_at, 1000000 + row_number() OVER (ORDER BY deliver_at, \"offset\") - 1 AS seq FROM x WHERE deliver_at <= {NOW_MS}")
def delayed_mature_order(spark, d):
    """Delayed rows are numbered as they fall due."""
    m = event_messages(spark, d)
    held = m.select(F.col("seq").alias("offset"), (F.col("ts_ms") + (F.col("seq") - 1) % 10 * 60000).alias("deliver_at"))
    return schedule.matured(held, NOW_MS, 1_000_000).select("offset", "deliver_at", "seq")


@query(f"WITH {_M}, x AS (SELECT seq, ts_ms + (seq % 10) * 60000 AS deliver_at FROM m) SELECT CASE WHEN seq % 5 = 0 THEN 'matured' WHEN deliver_at <= {NOW_MS} THEN 'due' ELSE 'pending' END AS state, count(*) AS n FROM x GROUP BY state")
def delayed_recovery(spark, d):
    m = event_messages(spark, d)
    held = m.select(F.col("seq").alias("offset"), (F.col("ts_ms") + F.col("seq") % 10 * 60000).alias("deliver_at"))
    done = held.where(F.col("offset") % 5 == 0).select("offset")
    return L.delayed_recovery(held, done, NOW_MS).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {_M} SELECT seq, (ts_ms + 99) // 100 * 100 AS fire_ms FROM m WHERE ts_ms > {NOW_MS} AND ts_ms <= {NOW_MS + DAY_MS}")
def timers_due(spark, d):
    """Timers fire at the end of their tick, never early."""
    t = event_messages(spark, d).select("seq", F.col("ts_ms").alias("expire_at_ms"))
    return schedule.fired(schedule.due_between(t, NOW_MS, NOW_MS + DAY_MS), 100).select("seq", "fire_ms")


@query("SELECT row_number() OVER (ORDER BY t) AS fire, epoch_ms(t) AS fire_ms, CASE (row_number() OVER (ORDER BY t) - 1) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS worker FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-14 23:55:00', INTERVAL 5 MINUTE)) AS t) WHERE hour(t) BETWEEN 9 AND 17 AND isodow(t) <= 5 AND minute(t) % 15 = 0")
def cron_fires(spark, d):
    """A schedule's fires, dealt to its workers in turn."""
    fires = schedule.cron_fires(spark, "job", "*/15 9-17 * * mon-fri", "2024-01-01 00:00:00", "2024-01-15 00:00:00")
    dealt = schedule.round_robin(fires, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return dealt.select("fire", F.unix_millis("fire_ts").alias("fire_ms"), "worker")


@query("""WITH q AS (SELECT conv_id, turn, conv_id * 1000 + turn AS correlation_id, turn * 1000 AS ts_ms FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id * 1000 + turn - 1 AS correlation_id, (turn - 1) * 1000 + length(text) AS ts_ms, length(text) AS reply FROM conversations WHERE role = 'assistant')
SELECT correlation_id, reply_ms, CASE WHEN reply_ms IS NULL THEN 'timeout' ELSE 'reply' END AS outcome
FROM (SELECT q.correlation_id, (SELECT min(p.ts_ms) FROM p WHERE p.correlation_id = q.correlation_id AND p.ts_ms BETWEEN q.ts_ms AND q.ts_ms + 400) AS reply_ms FROM q)""")
def rpc_interval_match(spark, d):
    """Replies within the timeout of their requests."""
    c = table(spark, d, "conversations")
    asks = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("correlation_id"), (F.col("turn") * 1000).alias("ts_ms"))
    answers = c.where("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("correlation_id"),
        ((F.col("turn") - 1) * 1000 + F.char_length("text")).alias("ts_ms"), F.char_length("text").cast("string").alias("payload"),
    )
    return routing.correlate(asks, answers, 400).select("correlation_id", "reply_ms", "outcome")


@query(f"WITH {_M} SELECT user_id AS connection_id, max(ts_ms) AS seen_ms FROM m GROUP BY user_id HAVING max(ts_ms) + {DAY_MS} <= {NOW_MS + 16 * DAY_MS}")
def idle_connections(spark, d):
    seen = event_messages(spark, d).select(F.col("user_id").alias("connection_id"), F.col("ts_ms").alias("seen_ms"))
    return schedule.idle(seen, NOW_MS + 16 * DAY_MS, DAY_MS)


# ---- retention


@query(f"WITH {_M} SELECT seq, subject FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS r FROM m) WHERE r <= 1234")
def retention_max_msgs(spark, d):
    return retention.newest_messages(event_messages(spark, d).select("seq", "subject"), 1234)


@query(f"WITH {_M} SELECT event_type, seq FROM (SELECT *, sum(nbytes) OVER (PARTITION BY event_type ORDER BY seq DESC) AS b FROM m) WHERE b <= 5000")
def retention_max_bytes(spark, d):
    rows = event_messages(spark, d).select("event_type", "seq", "nbytes")
    return retention.newest_bytes(rows, 5000, ["event_type"]).select("event_type", "seq")


@query(f"WITH {_M} SELECT event_type, seq FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS r FROM m) WHERE r <= 300")
def quota_new_msgs(spark, d):
    rows = event_messages(spark, d).select("event_type", "seq")
    return retention.admitted_messages(rows, 300, ["event_type"])


@query(f"WITH RECURSIVE {_M}, x AS (SELECT event_type, seq, nbytes, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS i FROM m), r AS (SELECT event_type, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, FALSE AS ok FROM (SELECT DISTINCT event_type FROM m) UNION ALL SELECT r.event_type, x.i, CASE WHEN used + nbytes <= 4000 THEN used + nbytes ELSE used END, used + nbytes <= 4000 FROM r JOIN x ON x.event_type = r.event_type AND x.i = r.i + 1) SELECT event_type, seq FROM r JOIN x USING (event_type, i) WHERE ok")
def quota_new_bytes(spark, d):
    """Greedy by bytes: a fold."""
    rows = event_messages(spark, d).select("event_type", "seq", "nbytes")
    return retention.admitted_bytes(rows, 4_000, ["event_type"]).where("accepted").select("event_type", "seq")


@query(f"WITH RECURSIVE {_M}, b AS (SELECT seq // 50 AS batch, count(*) AS n, CAST(sum(nbytes) AS BIGINT) AS b, row_number() OVER (ORDER BY min(seq)) AS i FROM m GROUP BY 1), r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, FALSE AS ok UNION ALL SELECT b.i, CASE WHEN r.n + b.n <= 5000 AND r.b + b.b <= 40000 THEN r.n + b.n ELSE r.n END, CASE WHEN r.n + b.n <= 5000 AND r.b + b.b <= 40000 THEN r.b + b.b ELSE r.b END, r.n + b.n <= 5000 AND r.b + b.b <= 40000 FROM r JOIN b ON b.i = r.i + 1) SELECT batch AS batch_id, ok AS accepted FROM r JOIN b USING (i)")
def quota_batches(spark, d):
    """Whole batches, in turn."""
    rows = event_messages(spark, d).select(F.floor(F.col("seq") / 50).alias("batch_id"), "seq", "nbytes")
    return retention.admitted_batches(rows, 5_000, 40_000)


@query(f"WITH {_M}, t AS (SELECT seq, subject, ts_ms + CASE WHEN seq % 500 = 0 THEN {30 * DAY_MS} ELSE 0 END AS ts_ms FROM m) SELECT seq, subject FROM t WHERE seq >= (SELECT min(seq) FROM t WHERE ts_ms >= {NOW_MS})")
def purge_before(spark, d):
    """From the first row at or after the cutoff, whatever the times behind it."""
    late = F.when(F.col("seq") % 500 == 0, 30 * DAY_MS).otherwise(0)
    rows = event_messages(spark, d).select("seq", "subject", (F.col("ts_ms") + late).alias("ts_ms"))
    return retention.purge_before(rows, NOW_MS).select("seq", "subject")


@query(f"WITH {_M} SELECT event_type, count(*) AS n FROM m WHERE NOT regexp_matches(subject, '{S.pattern_regex('events.click.>')}') AND seq % 10 <> 3 GROUP BY event_type")
def drain_subject_compact(spark, d):
    """A drain, then tombstones, then compaction."""
    rows = retention.drain(event_messages(spark, d), "events", "events.click.>")
    return retention.compact(retention.tombstone(rows, F.col("seq") % 10 == 3)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_M}, s AS (SELECT event_type AS stream, seq, ts_ms FROM m), a AS (SELECT stream, seq, CASE stream WHEN 'view' THEN 0 ELSE {5 * DAY_MS} END AS age, ts_ms FROM s), f AS (SELECT stream, min(seq) AS first FROM a WHERE NOT (age > 0 AND ts_ms + age <= {NOW_MS}) GROUP BY stream) SELECT a.stream, count(*) AS n FROM a JOIN f USING (stream) WHERE a.seq >= f.first GROUP BY a.stream")
def age_sweep(spark, d):
    rows = event_messages(spark, d).select(F.col("event_type").alias("stream"), "seq", "ts_ms")
    age = F.when(F.col("stream") == "view", 0).otherwise(5 * DAY_MS)
    return retention.expired_front(rows, age, NOW_MS).groupBy("stream").agg(F.count("*").alias("n"))


@query(f"WITH {_M} SELECT event_type AS stream, count(*) AS n FROM m WHERE seq > CASE event_type WHEN 'click' THEN 400 WHEN 'view' THEN 0 ELSE 999999999 END AND event_type IN ('click', 'view') GROUP BY event_type")
def retention_interest(spark, d):
    """Rows that some consumer has yet to ack."""
    rows = event_messages(spark, d).select(F.col("event_type").alias("stream"), "seq")
    c = spark.createDataFrame([(1, "click"), (2, "click"), (3, "view")], "consumer_id long, stream string")
    floors = spark.createDataFrame([(1, 400), (2, 900)], "consumer_id long, floor long")
    return retention.interest_retained(rows, floors, c).groupBy("stream").agg(F.count("*").alias("n"))


@query("SELECT n_name AS name, n_regionkey FROM nation ORDER BY n_name LIMIT 10 OFFSET 5")
def listing_page(spark, d):
    """One page of a listing; the limit is the operator."""
    return metrics.list_streams(table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), 5, 10)


# ---- catalog and metrics

_STREAM_FILTERS = [("a", "orders.>"), ("b", "orders.new.*"), ("c", "events.click.*"), ("d", "events.*.u1"), ("e", "billing.>"), ("f", "*.paid")]
_OVERLAPS = [(a, b) for a, x in _STREAM_FILTERS for b, y in _STREAM_FILTERS if a < b and _overlap(x, y)]


@query(f"SELECT * FROM (VALUES {', '.join(str(p) for p in _OVERLAPS)}) AS t(a, b)")
def stream_overlap_violations(spark, d):
    return catalog.overlapping_streams(spark.createDataFrame(_STREAM_FILTERS, "name string, filter string"))


_ASKS = [  # requests beside the streams old (old.>) and log (log.*), and their verdicts
    ("new", "new.>", "created"), ("old", "old.>", "exists"), ("log", "log.>", "filter_changed"), ("all", ">", "filter_too_wide"),
    ("none", "", "filter_missing"), ("bad name", "x", "name_invalid_char"), ("clash", "old.a", "filter_overlaps"), ("odd", "a..b", "filter_invalid_char"),
]


@query(f"SELECT * FROM (VALUES {', '.join(str(a) for a in _ASKS)}) AS t(name, filter, verdict)")
def stream_admission(spark, d):
    """A verdict for each request to create a stream."""
    have = spark.createDataFrame([("old", "old.>"), ("log", "log.*")], "name string, filter string")
    return catalog.stream_verdicts(spark.createDataFrame([a[:2] for a in _ASKS], "name string, filter string"), have)


@query(f"WITH {_M}, t AS (SELECT event_type, ts_ms // {DAY_MS} AS day, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS total FROM t) SELECT event_type, day, total, greatest(total - coalesce(lag(total) OVER (PARTITION BY event_type ORDER BY day), 0), 0) AS delta FROM c")
def metrics_delta(spark, d):
    """Counters of each day and what they gained."""
    days = event_messages(spark, d).groupBy("event_type", F.floor(F.col("ts_ms") / DAY_MS).alias("day")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("event_type").orderBy("day"))
    return metrics.deltas(days.withColumn("total", total), ["event_type"], "day", "total").select("event_type", "day", "total", "delta")


@query(f"WITH {_M} SELECT count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM m")
def metrics_counters(spark, d):
    return metrics.counters(event_messages(spark, d).withColumn("kind", F.col("event_type")), ["click", "error"])


@query(f"WITH {_M}, {_O} SELECT stream, max(seq) AS high FROM (SELECT stream, seq FROM m UNION ALL SELECT stream, seq FROM o) GROUP BY stream")
def high_watermarks(spark, d):
    return metrics.high_watermarks(event_messages(spark, d).select("stream", "seq").unionByName(order_messages(spark, d).select("stream", "seq")))


@query(f"""WITH {_M} SELECT 'messages{{type="' || event_type || '"}} ' || CAST(count(*) AS VARCHAR) AS line FROM m GROUP BY event_type""")
def prometheus_text(spark, d):
    n = event_messages(spark, d).groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    return metrics.prometheus(n, "messages", "n", ["type"])


@query(f"WITH {_M}, {_DELIVERED} SELECT CAST(max({NOW_MS} - d.ts_ms) AS BIGINT) AS oldest_ms, count(*) FILTER (WHERE {NOW_MS} - d.ts_ms > {DAY_MS}) AS hot FROM d LEFT JOIN k USING (consumer, seq) WHERE k.seq IS NULL")
def oldest_pending(spark, d):
    sent = _deliveries(spark, d)
    return metrics.oldest_pending(acks.settled(sent, _acks(sent)), NOW_MS, DAY_MS)


@query(f"WITH {_M} SELECT user_id % 3 AS connection_id, stream, (row_number() OVER (PARTITION BY user_id % 3 ORDER BY seq) - 1) // 100 AS frame, seq FROM m")
def delivery_frames(spark, d):
    """Deliveries bucketed to frames, and opened again."""
    rows = event_messages(spark, d).select((F.col("user_id") % 3).alias("connection_id"), "stream", F.lit(True).alias("is_fanout"), "seq")
    return sinks.frames(rows, 100).select("connection_id", "stream", "frame", F.explode("seqs").alias("seq"))


# ---- workflows


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS step FROM lineitem), g AS (SELECT l_orderkey, step, row_number() OVER (PARTITION BY l_orderkey ORDER BY step) - 1 AS r FROM s), n AS (SELECT l_orderkey, count(*) FILTER (WHERE step = r) AS next_step FROM g GROUP BY l_orderkey)
SELECT CAST(l_orderkey AS VARCHAR) AS instance_id, CAST(next_step AS INTEGER) AS next_step, CASE WHEN next_step >= 4 THEN 'done' ELSE 'running' END AS state FROM n""")
def workflow_progress(spark, d):
    """Where each instance stands, orders being instances and lines their steps."""
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("instance_id"), (F.col("l_linenumber") - 1).alias("step"))
    return workflow.linear_progress(done, 4).withColumn("next_step", F.col("next_step").cast("int"))


@query()
def workflow_replay(spark, d):
    """The state machine over conversations: turns are steps, short turns fail."""
    c = table(spark, d, "conversations")
    e = c.select(
        F.col("conv_id").cast("string").alias("instance_id"), F.col("turn").alias("position"),
        F.when(F.col("turn") == 0, "trigger").when(F.char_length("text") % 5 == 0, "error").otherwise("ok").alias("kind"),
        F.greatest(F.col("turn") - 1, F.lit(0)).cast("int").alias("step"), F.lit(3).alias("attempt"), F.lit("{}").alias("context"),
    )
    return workflow.replay(e, 4).select("instance_id", "position", "kind", "step", "attempt", "message_id")


@query()
def credit_with_acks(spark, d):
    """Deliveries where every third is acked a minute after it was offered."""
    m = event_messages(spark, d).select("seq", "subject", "ts_ms", (F.col("user_id") % 20).alias("consumer_id"))
    null = F.lit(None).cast("long")
    offers = m.select("consumer_id", F.col("ts_ms").alias("at_ms"), (2 * F.col("seq")).alias("position"), F.lit("offer").alias("kind"), "seq", "subject", F.lit(2).cast("long").alias("limit"), F.lit(20).cast("long").alias("max_inflight"))
    done = m.where(F.col("seq") % 3 == 0).select("consumer_id", (F.col("ts_ms") + 60_000).alias("at_ms"), (2 * F.col("seq") + 1).alias("position"), F.lit("ack").alias("kind"), "seq", "subject", null.alias("limit"), null.alias("max_inflight"))
    return credit.credit_with_acks(offers.unionByName(done))


@query(f"WITH {_M} SELECT seq, json_extract_string(payload, '$.k') AS k, CASE WHEN seq % 2 = 0 THEN 'click' ELSE NULL END AS kind FROM m")
def json_context(spark, d):
    """Members of a context after a shallow merge."""
    patch = F.when(F.col("seq") % 2 == 0, F.lit('{"kind": "click"}')).otherwise(F.lit("{}"))
    merged = P.json_merge(F.col("payload"), patch)
    return event_messages(spark, d).select(
        "seq", P.json_field(merged, "$.k").alias("k"), P.json_field(merged, "$.kind").alias("kind")
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who receives what."""
    return route_fanout_counts(spark, sf_dir)
