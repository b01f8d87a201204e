"""Queries of deliveries, acks, catalogs and codecs, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import subjects as S
from ..operators import acks, catalog, credit, dedup, metrics, publish, retention, routing, schedule, workflow
from ..schema import MAX_DELAYED
from ..sources import log as L
from ..sources import sinks
from ..sources.tables import event_messages, table
from ..storage import new_path
from .queries import _M, NOW_MS, query

_BIG = 1 << 62


# ---- logs


@query(f"WITH {_M} SELECT seq FROM m WHERE seq % 17 <> 0")
def verified_rows(spark, d):
    """Rows whose stored checksum holds; every 17th was damaged."""
    m = event_messages(spark, d)
    stored = m.withColumn("crc", L.row_checksum() + F.when(F.col("seq") % 17 == 0, 1).otherwise(0))
    return L.verified(stored).select("seq")


@query(f"WITH {_M} SELECT seq, subject FROM m WHERE seq < (SELECT min(seq) FROM m WHERE seq % 4001 = 0)")
def recovered_prefix(spark, d):
    """A segment up to its first damaged row."""
    m = event_messages(spark, d)
    stored = m.withColumn("crc", L.row_checksum() + F.when(F.col("seq") % 4001 == 0, 1).otherwise(0))
    return L.recovered(stored).select("seq", "subject")


@query("SELECT min(event_id) + 1 AS first_seq, max(event_id) + 1 AS last_seq, count(*) AS messages FROM events")
def segment_bounds(spark, d):
    """The segments of a log with their bounds; the input is one file."""
    e = table(spark, d, "events").withColumn("seq", F.col("event_id") + 1)
    return L.segments(e).select("first_seq", "last_seq", "messages")


@query(f"""WITH {_M}, c AS (SELECT seq AS position, 'u' || CAST(user_id AS VARCHAR) AS name, CASE seq % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'cursor' ELSE 'create' END AS command, event_type AS body FROM m WHERE seq % 13 <> 0),
a AS (SELECT name, max(position) FILTER (WHERE command = 'create') AS created, max(position) FILTER (WHERE command = 'delete') AS deleted, max(position) FILTER (WHERE command = 'cursor') AS moved,
  arg_max(body, position) FILTER (WHERE command = 'create') AS body, arg_max(body, position) FILTER (WHERE command = 'cursor') AS cur FROM c GROUP BY name)
SELECT name, body, CASE WHEN moved > created THEN cur END AS cursor FROM a WHERE created IS NOT NULL AND coalesce(deleted, -1) < created""")
def metadata_replay(spark, d):
    """The catalog that a log of commands leaves; records of a bad checksum are passed over."""
    command = F.when(F.col("seq") % 4 == 0, "delete").when(F.col("seq") % 4 == 1, "cursor").otherwise("create")
    changes = event_messages(spark, d).select(
        F.col("seq").alias("position"), command.alias("command"), F.lit("stream").alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("body"),
    )
    names = ("position", "command", "kind", "name", "body")
    stored = changes.withColumn("crc", L.row_checksum(*names) + F.when(F.col("position") % 13 == 0, 1).otherwise(0))
    return L.replayed_catalog(stored, "crc").select("name", "body", "cursor")


@query(f"WITH {_M} SELECT seq AS \"offset\", subject, payload, 499 + row_number() OVER (ORDER BY ts_ms, seq) AS seq FROM m")
def appended_log(spark, d):
    """Rows numbered by time, appended in segments and read back where their checksums hold."""
    m = event_messages(spark, d).withColumnRenamed("seq", "offset")
    path = new_path(spark, "log")
    sinks.append(sinks.numbered(m, 500, "ts_ms", "offset"), path, 1_000)
    return L.verified(spark.read.parquet(path)).select("offset", "subject", "payload", "seq")


@query(f"""WITH {_M}, x AS (SELECT seq, ts_ms, CASE WHEN seq % 100 = 0 THEN 700000000 WHEN seq % 3 = 0 THEN 0 ELSE seq % 10 * 1000 END AS delay FROM m),
h AS (SELECT seq, row_number() OVER (ORDER BY ts_ms, seq) AS r FROM x WHERE delay > 0 AND delay <= 604800000)
SELECT x.seq, x.ts_ms + delay AS deliver_at, CASE WHEN delay > 604800000 THEN 'delay_too_long' WHEN delay > 0 AND h.r > 500 THEN 'too_many_delayed' END AS error FROM x LEFT JOIN h USING (seq)""")
def publish_delayed(spark, d):
    """Delayed publishes under the bounds of delay and number; there is room for 500 more."""
    delay = F.when(F.col("seq") % 100 == 0, 700_000_000).when(F.col("seq") % 3 == 0, 0).otherwise(F.col("seq") % 10 * 1000)
    rows = event_messages(spark, d).select("seq", "ts_ms", delay.cast("long").alias("delay_ms"))
    return sinks.delayed(rows, MAX_DELAYED - 500).select("seq", "deliver_at", "error")


@query(f"WITH {_M}, a AS (SELECT user_id AS consumer, max(seq) FILTER (WHERE seq <= 5000) AS b, max(seq) AS c FROM m GROUP BY user_id) SELECT consumer AS consumer_id, c AS cursor FROM a WHERE b IS DISTINCT FROM c")
def moved_cursors(spark, d):
    """What a cursor persister writes: consumers whose cursor changed."""
    m = event_messages(spark, d)
    of = lambda t: t.groupBy(F.col("user_id").alias("consumer_id")).agg(F.max("seq").alias("cursor"))
    return sinks.changed_cursors(of(m.where("seq <= 5000")), of(m))


@query(f"WITH {_M}, x AS (SELECT user_id % 30 AS connection, seq, row_number() OVER (PARTITION BY user_id % 30 ORDER BY seq) AS r FROM m) SELECT connection AS connection_id, seq, CASE WHEN connection % 7 = 0 OR connection >= 25 THEN 'writer_gone' WHEN r > 40 THEN 'backpressured' ELSE 'ok' END AS outcome FROM x")
def deliver_outcomes(spark, d):
    """What becomes of each offer: sent, beyond a connection's room, or its writer gone."""
    offers = event_messages(spark, d).select((F.col("user_id") % 30).alias("connection_id"), "seq")
    connections = spark.range(25).select(F.col("id").alias("connection_id"), F.lit(40).alias("room"), (F.col("id") % 7 != 0).alias("alive"))
    return sinks.delivered(offers, connections)


@query(f"WITH {_M} SELECT seq, 16 + 8 * CAST(seq % 4 = 0 AS INTEGER) AS flags, CASE WHEN seq % 3 <> 0 THEN 'id' || CAST(seq AS VARCHAR) END AS msg_id, nbytes, CASE WHEN seq % 11 = 0 THEN 'invalid_char' END AS error FROM m")
def publishable_rows(spark, d):
    """Messages as they are stored: flags, id, size, and why one is refused."""
    m = event_messages(spark, d)
    value = F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("id"), F.col("seq").cast("string")))
    rows = m.select(
        "seq", F.when(F.col("seq") % 11 == 0, F.concat("subject", F.lit(" !"))).otherwise(F.col("subject")).alias("subject"),
        F.create_map(F.lit("msg-id"), value).alias("headers"), F.when(F.col("seq") % 4 == 0, "inbox").alias("reply_to"), "payload",
    )
    return sinks.publishable(rows).select("seq", "flags", "msg_id", "nbytes", "error")


@query(f"WITH {_M}, x AS (SELECT seq, event_type AS stream, CASE WHEN seq % 23 = 0 THEN 'invalid' WHEN event_type = 'error' THEN 'unknown_stream' WHEN event_type = 'click' AND seq > 1200 THEN 'over_quota' ELSE 'ok' END AS verdict FROM m WHERE seq <= 4000) SELECT seq, stream, verdict, CASE WHEN verdict = 'ok' THEN 999 + row_number() OVER (PARTITION BY verdict ORDER BY seq) END AS stored_seq FROM x")
def publish_verdicts(spark, d):
    """A publish as one operator: validated, de-duplicated, under quota, numbered; no id repeats here.

    The quota of stream click is what the store holds once row 1200 has come.
    """
    m = event_messages(spark, d).where("seq <= 4000")
    rows = m.select(
        "seq", F.col("event_type").alias("stream"), F.when(F.col("seq") % 23 == 0, F.lit("a b")).otherwise(F.col("subject")).alias("subject"), "ts_ms",
        F.create_map(F.lit("msg-id"), F.col("seq").cast("string")).alias("headers"), F.lit(None).cast("string").alias("reply_to"), "payload",
    )
    most = m.where("seq <= 1200 AND seq % 23 <> 0 AND event_type <> 'error'").count()
    names = [r[0] for r in m.select("event_type").distinct().collect() if r[0] != "error"]
    streams = spark.createDataFrame(
        [(n, most if n == "click" else 0, 0, "new" if n == "click" else "old", 60_000) for n in names],
        "name string, max_msgs long, max_bytes long, discard string, idempotency_window_ms long",
    )
    return publish.publish(rows, streams, 1000).select("seq", "stream", "verdict", "stored_seq")


@query(f"""WITH RECURSIVE {_M}, b AS (SELECT seq // 7 AS batch, count(*) AS n, CAST(sum(nbytes) AS BIGINT) AS b, count(DISTINCT user_id) < count(*) AS dup, min(seq) AS s FROM m GROUP BY 1),
u AS (SELECT *, row_number() OVER (ORDER BY s) AS i FROM b WHERE NOT dup),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, FALSE AS ok UNION ALL SELECT u.i, CASE WHEN r.n + u.n <= 3000 AND r.b + u.b <= 50000 THEN r.n + u.n ELSE r.n END, CASE WHEN r.n + u.n <= 3000 AND r.b + u.b <= 50000 THEN r.b + u.b ELSE r.b END, r.n + u.n <= 3000 AND r.b + u.b <= 50000 FROM r JOIN u ON u.i = r.i + 1)
SELECT batch AS batch_id, 'duplicate' AS verdict FROM b WHERE dup UNION ALL SELECT batch, CASE WHEN ok THEN 'ok' ELSE 'over_quota' END FROM r JOIN u USING (i)""")
def publish_batch_verdicts(spark, d):
    """Batches published whole or not at all: a duplicate within refuses one, and so does the quota."""
    rows = event_messages(spark, d).select(F.floor(F.col("seq") / 7).alias("batch_id"), "seq", "stream", F.col("user_id").cast("string").alias("msg_id"), "nbytes")
    return publish.publish_batches(rows, None, 3_000, 50_000)


# ---- row filters and routing


@query(f"WITH {_M} SELECT event_type AS stream, seq FROM m WHERE event_type IN ('click', 'error')")
def rows_in_demand(spark, d):
    m = event_messages(spark, d).select(F.col("event_type").alias("stream"), "seq")
    bindings = spark.createDataFrame([("click", 1), ("click", 2), ("error", 3), ("nothing", 4)], "stream string, binding_id long")
    return routing.with_demand(m, bindings)


_OFFERS = "o AS (SELECT user_id % 20 AS consumer, seq FROM m), fl AS (SELECT consumer, consumer * 100 AS floor FROM o WHERE consumer < 15 GROUP BY consumer), dn AS (SELECT consumer, seq FROM o WHERE seq % 5 = 0)"


def _offers(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = event_messages(spark, d).select((F.col("user_id") % 20).alias("consumer_id"), "seq")
    floors = spark.range(15).select(F.col("id").alias("consumer_id"), (F.col("id") * 100).alias("floor"))
    return o, floors, o.where("seq % 5 = 0")


@query(f"WITH {_M}, {_OFFERS} SELECT consumer AS consumer_id, seq FROM o LEFT JOIN fl USING (consumer) WHERE seq > coalesce(floor, 0) AND seq % 5 <> 0")
def unsuppressed_offers(spark, d):
    """Offers above their consumer's floor that it neither has nor had."""
    return routing.unsuppressed(*_offers(spark, d))


@query(f"WITH {_M}, {_OFFERS} SELECT consumer AS consumer_id, seq FROM dn LEFT JOIN fl USING (consumer) WHERE seq > coalesce(floor, 0) AND seq % 3 <> 0")
def suppression_after_release(spark, d):
    """The suppression set above the floors, without what was nacked."""
    o, floors, done = _offers(spark, d)
    return acks.released(acks.suppressed(floors, done), o.where("seq % 3 = 0"))


@query(f"WITH {_M} SELECT user_id % 20 AS consumer_id, seq, CASE WHEN seq % 2 = 0 THEN seq % 3 ELSE 0 END AS binding_id FROM m WHERE seq % 4 <> 3 AND (seq % 2 = 1 OR seq % 3 = seq % 5)")
def acked_by_binding(spark, d):
    """Acks that name a binding release its pending; those that don't, the consumer's first."""
    m = event_messages(spark, d).where("seq % 4 <> 3").select((F.col("user_id") % 20).alias("consumer_id"), "seq")
    held = m.withColumn("binding_id", F.when(F.col("seq") % 2 == 0, F.col("seq") % 3).otherwise(0))
    more = held.where("seq % 2 = 1").withColumn("binding_id", F.lit(9).cast("long"))
    named = m.withColumn("binding_id", F.when(F.col("seq") % 2 == 0, F.col("seq") % 5))
    return routing.acked_pendings(named, held.unionByName(more)).select("consumer_id", "seq", "binding_id")


@query(f"WITH {_M} SELECT seq, user_id % 40 AS binding_id FROM m WHERE user_id % 40 >= 30")
def late_release_rows(spark, d):
    sent = event_messages(spark, d).select("seq", (F.col("user_id") % 40).alias("binding_id"))
    return routing.late_releases(sent, spark.range(30).select(F.col("id").alias("binding_id")))


# ---- credit


_PENDING = "p AS (SELECT user_id % 20 AS consumer, seq, ts_ms FROM m WHERE seq % 3 = 0)"


def _pendings(spark, d) -> DataFrame:
    return event_messages(spark, d).where("seq % 3 = 0").select((F.col("user_id") % 20).alias("consumer_id"), "seq", F.col("ts_ms").alias("delivered_ms"))


@query(f"WITH {_M}, {_PENDING}, n AS (SELECT consumer, count(*) AS n FROM p WHERE consumer < 18 GROUP BY consumer) SELECT i AS consumer_id, coalesce(n, 0) AS inflight, i % 4 = 0 OR coalesce(n, 0) < i * 20 AS has_capacity FROM range(20) AS t(i) LEFT JOIN n ON n.consumer = i")
def consumer_capacity(spark, d):
    consumers = spark.range(20).select(F.col("id").alias("consumer_id"), F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id") * 20).alias("max_inflight"))
    return credit.with_capacity(consumers, _pendings(spark, d).where("consumer_id < 18")).drop("max_inflight")


@query("SELECT n_name AS name, n_regionkey = 1 OR n_name = 'NATION_3' AS paused FROM nation WHERE n_name <> 'NATION_7' UNION ALL SELECT 'NATION_7', FALSE")
def paused_consumers(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 1).alias("paused"))
    return credit.paused(credit.paused(rows, ["NATION_3", "NATION_7"]), ["NATION_7"], False)


@query(f"WITH {_M} SELECT user_id AS connection_id, max(ts_ms) AS last_progress_ms, max(seq % 2) AS owed FROM m GROUP BY user_id HAVING max(seq % 2) > 0 AND max(ts_ms) + 86400000 <= {NOW_MS + 15 * 86_400_000}")
def stalled(spark, d):
    progress = event_messages(spark, d).select(F.col("user_id").alias("connection_id"), F.col("ts_ms").alias("progress_ms"), (F.col("seq") % 2).alias("owed"))
    return credit.stalled_connections(progress, NOW_MS + 15 * 86_400_000, 86_400_000)


@query(f"WITH {_M}, x AS (SELECT seq, row_number() OVER (PARTITION BY user_id % 3, ts_ms // 1000 ORDER BY ts_ms, seq) AS r FROM (SELECT seq, user_id, ts_ms // 1000000 * 1000 AS ts_ms FROM m)) SELECT seq AS frame_id, r <= 1 AS accepted FROM x")
def rate_limit(spark, d):
    """The first frame of a connection in each second; times are made coarse so that some meet."""
    rows = event_messages(spark, d).select(
        F.col("seq").alias("frame_id"), (F.col("user_id") % 3).alias("connection_id"), (F.floor(F.col("ts_ms") / 1_000_000) * 1000).alias("ts_ms")
    )
    return credit.rate_limited(rows, 1).select("frame_id", "accepted")


# ---- acks


@query(f"WITH {_M} SELECT user_id % 20 AS consumer_id, seq, 1 AS attempt, ts_ms + 5 AS delivered_ms FROM m WHERE user_id % 20 % 3 <> 0")
def opened_pendings(spark, d):
    """Deliveries open a pending once, and none where acks are not asked for."""
    m = event_messages(spark, d).select((F.col("user_id") % 20).alias("consumer_id"), "seq", F.col("ts_ms").alias("delivered_ms"))
    twice = m.withColumn("attempt", F.lit(0)).unionByName(m.select("consumer_id", "seq", (F.col("delivered_ms") + 5).alias("delivered_ms"), F.lit(1).alias("attempt")))
    consumers = spark.range(20).select(F.col("id").alias("consumer_id"), F.when(F.col("id") % 3 == 0, "none").otherwise("explicit").alias("ack_policy"))
    return acks.opened(twice, consumers)


def _answers(spark, d) -> DataFrame:
    kind = F.when(F.col("seq") % 5 == 0, "nack").when(F.col("seq") % 7 == 0, "term").otherwise("ack")
    return event_messages(spark, d).select(
        (F.col("user_id") % 20).alias("consumer_id"), "seq", kind.alias("kind"), F.col("ts_ms").alias("acked_ms"),
        F.when(F.col("seq") % 2 == 0, F.col("seq") % 9 * 1000).alias("delay_ms"),
    )


@query(f"WITH {_M} SELECT user_id % 20 AS consumer_id, seq, ts_ms + CASE WHEN seq % 2 = 0 THEN seq % 9 * 1000 ELSE 0 END AS offer_ms FROM m WHERE seq % 5 = 0")
def nack_redeliveries(spark, d):
    """Nacked rows are offered at once, or after the delay they ask for."""
    return acks.redeliveries(_answers(spark, d))


@query(f"WITH {_M} SELECT seq, CASE WHEN seq % 5 <> 0 AND seq % 7 = 0 THEN 1 ELSE 0 END AS flags FROM m")
def terminated_rows(spark, d):
    """What any consumer ended has a tombstone for all."""
    return acks.terminated(event_messages(spark, d).select("seq", "flags"), _answers(spark, d))


@query(f"WITH {_M} SELECT user_id % 20 AS consumer_id, seq FROM m WHERE seq % 5 = 0 OR seq % 7 = 0")
def unknown_acks(spark, d):
    a = _answers(spark, d)
    return acks.unknown(a, a.where("kind = 'ack'")).select("consumer_id", "seq")


@query(f"WITH {_M}, x AS (SELECT user_id % 20 AS consumer, row_number() OVER (PARTITION BY user_id % 20 ORDER BY seq) AS r, seq FROM m), g AS (SELECT consumer, min(r) AS r FROM x WHERE r > 30 AND seq % 97 = 0 GROUP BY consumer) SELECT x.consumer AS consumer_id, coalesce(min(g.r) - 1, max(x.r)) AS floor FROM x LEFT JOIN g USING (consumer) GROUP BY x.consumer")
def ack_floor_seeded(spark, d):
    """The floor from a seed of 30 on, whatever was acked below it."""
    o = acks.owed_rank(event_messages(spark, d).select((F.col("user_id") % 20).alias("consumer_id"), "seq"))
    return acks.ack_floor(o.where("seq % 97 <> 0 AND rank > 10"), F.lit(30), "rank")


@query(f"WITH {_M}, b AS (SELECT event_type, min(seq) AS lo, max(seq) AS hi FROM m GROUP BY event_type) SELECT c.i AS consumer_id, CASE WHEN i % 2 = 0 THEN i * 10 ELSE 0 END AS cursor, CASE WHEN i % 2 = 0 THEN i ELSE 0 END AS generation, lo AS first_seq, hi AS last_seq FROM (SELECT i, CASE i % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'none' END AS stream FROM range(9) AS t(i)) AS c LEFT JOIN b ON b.event_type = c.stream")
def ack_states(spark, d):
    m = event_messages(spark, d).select(F.col("event_type").alias("stream"), "seq")
    stream = F.when(F.col("id") % 3 == 0, "click").when(F.col("id") % 3 == 1, "view").otherwise("none")
    c = spark.range(9).select(F.col("id").alias("consumer_id"), stream.alias("stream"))
    cursors = spark.range(0, 9, 2).select(F.col("id").alias("consumer_id"), (F.col("id") * 10).alias("cursor"), F.col("id").alias("generation"))
    return acks.ack_state(m, cursors, c)


@query(f"WITH {_M} SELECT user_id % 20 AS consumer_id, min(seq) AS rewind_to, count(*) AS released FROM m WHERE user_id % 7 IN (0, 4) GROUP BY user_id % 20")
def retire_connection(spark, d):
    """Everything of one connection is retired."""
    pendings = event_messages(spark, d).select((F.col("user_id") % 20).alias("consumer_id"), "seq", (F.col("user_id") % 7).alias("binding_id"))
    bindings = spark.range(7).select(F.col("id").alias("binding_id"), (F.col("id") % 4).alias("connection_id"))
    return acks.retire(pendings, acks.bindings_of(bindings, connection_id=0))


@query(f"WITH {_M}, s AS (SELECT user_id % 20 AS c, min(seq) - 1 AS lo FROM m WHERE seq > 4000 AND seq % 5 = 0 AND user_id % 20 < 15 GROUP BY 1) SELECT i AS consumer_id, least(CAST(4100 + i AS BIGINT), lo) AS cursor FROM range(20) AS t(i) LEFT JOIN s ON s.c = i")
def rewound_cursors(spark, d):
    """Cursors go back before the least nacked seq; signals compose by minimum."""
    cursors = spark.range(20).select(F.col("id").alias("consumer_id"), (F.col("id") + 4100).alias("cursor"))
    signals = event_messages(spark, d).select((F.col("user_id") % 20).alias("consumer_id"), "seq").where("seq > 4000 AND seq % 5 = 0 AND consumer_id < 15")
    return acks.rewound(cursors, signals)


@query("SELECT c_custkey AS consumer_id, CASE c_nationkey % 3 WHEN 0 THEN c_custkey + 1 WHEN 1 THEN 77 ELSE CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END + 1 END AS start FROM customer")
def resume_points(spark, d):
    """Where a new subscription starts: behind its creation, at a given seq, or behind the acked."""
    c = table(spark, d, "customer")
    policy = F.when(F.col("c_nationkey") % 3 == 0, "new").when(F.col("c_nationkey") % 3 == 1, "by_start_seq").otherwise("all")
    acked = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))
    return c.select(F.col("c_custkey").alias("consumer_id"), acks.resume_from(policy, acked, F.col("c_custkey"), F.lit(77)).cast("long").alias("start"))


@query(f"WITH {_M} SELECT user_id % 20 AS consumer_id, seq FROM m WHERE seq % 3 = user_id % 20 % 3 AND user_id % 20 < 18")
def deferred_acks(spark, d):
    """Acks that waited in a client; those of an older generation are purged."""
    a = event_messages(spark, d).select((F.col("user_id") % 20).alias("consumer_id"), "seq", (F.col("seq") % 3).alias("generation"))
    now = spark.range(18).select(F.col("id").alias("consumer_id"), (F.col("id") % 3).alias("generation"))
    return acks.deferred(a, now).select("consumer_id", "seq")


@query(f"WITH {_M} SELECT DISTINCT event_type AS stream, user_id % 20 AS consumer_id, seq // 3 AS seq FROM m WHERE seq // 3 % 4 <> 0")
def first_deliveries(spark, d):
    """What a client takes for the first time, by stream, consumer and seq."""
    rows = event_messages(spark, d).select(F.col("event_type").alias("stream"), (F.col("user_id") % 20).alias("consumer_id"), F.floor(F.col("seq") / 3).alias("seq"))
    return acks.first_seen(rows, rows.where("seq % 4 = 0"))


@query(f"WITH {_M} SELECT event_type AS stream, user_id % 20 AS consumer_id, seq FROM m WHERE seq > CASE WHEN event_type = 'click' THEN 3000 ELSE 0 END")
def confirmed_records(spark, d):
    rows = event_messages(spark, d).select(F.col("event_type").alias("stream"), (F.col("user_id") % 20).alias("consumer_id"), "seq")
    floors = spark.range(20).select(F.lit("click").alias("stream"), F.col("id").alias("consumer_id"), F.lit(3000).cast("long").alias("floor"))
    return acks.confirmed_up_to(rows, floors)


@query(f"""WITH {_M}, w AS (SELECT event_type AS stream, user_id % 20 AS consumer, seq // 5 AS s, CASE WHEN seq % 4 = 1 THEN 'confirm' ELSE 'record' END AS op, ts_ms, seq AS position FROM m),
a AS (SELECT stream, consumer, s, arg_max(op, ts_ms * 1000000 + position) AS op, max(ts_ms) AS t FROM w GROUP BY ALL)
SELECT stream, consumer AS consumer_id, s AS seq, t AS at_ms FROM a WHERE op = 'record' AND t > {NOW_MS - 3 * 86_400_000}""")
def wal_replay(spark, d):
    """The live records that a client's log leaves."""
    wal = event_messages(spark, d).select(
        F.col("event_type").alias("stream"), (F.col("user_id") % 20).alias("consumer_id"), F.floor(F.col("seq") / 5).alias("s"),
        F.when(F.col("seq") % 4 == 1, "confirm").otherwise("record").alias("op"), F.col("ts_ms").alias("at_ms"), F.col("seq").alias("position"),
    ).withColumnRenamed("s", "seq")
    return acks.replayed_wal(wal, NOW_MS, 3 * 86_400_000)


# ---- dedup, time, retention


@query(f"WITH {_M} SELECT seq, user_id FROM m WHERE user_id % 3 = 0")
def ids_on_record(spark, d):
    m = event_messages(spark, d).select("stream", "seq", "user_id", F.col("user_id").cast("string").alias("msg_id"))
    return dedup.seen_ids(m, m.where("user_id % 3 = 0").select("stream", "msg_id").distinct()).select("seq", "user_id")


@query(f"WITH {_M} SELECT DISTINCT CAST(user_id AS VARCHAR) AS msg_id FROM m WHERE user_id NOT IN (SELECT user_id FROM m WHERE seq // 10 % 50 = 7)")
def forgotten_ids(spark, d):
    """The record after batches are taken back."""
    m = event_messages(spark, d).select("stream", "seq", F.col("user_id").cast("string").alias("msg_id"))
    return dedup.forgotten(m.select("stream", "msg_id").distinct(), m.where(F.floor(F.col("seq") / 10) % 50 == 7)).select("msg_id")


@query(f"WITH {_M} SELECT min(ts_ms) - {NOW_MS} AS wait_ms, count(*) AS waiting FROM m WHERE ts_ms > {NOW_MS}")
def next_maturity(spark, d):
    """How long until the next delayed entry, and how many wait."""
    rows = event_messages(spark, d).select(F.col("ts_ms").alias("deliver_at"))
    return schedule.next_deadline(rows, NOW_MS).join(schedule.pending(rows, NOW_MS).agg(F.count("*").alias("waiting")), F.lit(True))


@query(f"""WITH {_M}, q AS (SELECT 'job' || CAST(user_id % 40 AS VARCHAR) AS name, event_type AS worker, seq AS position, seq % 6 = 0 AS deleted FROM m),
l AS (SELECT name, worker, min(position) AS first, arg_max(deleted, position) AS gone FROM q GROUP BY ALL)
SELECT name, string_agg(worker, ',' ORDER BY first) AS workers FROM l WHERE NOT gone GROUP BY name""")
def cron_workers(spark, d):
    """Schedules by name; a name that is there gains a worker."""
    m = event_messages(spark, d)
    asks = m.select(
        F.concat(F.lit("job"), (F.col("user_id") % 40).cast("string")).alias("name"), F.lit("* * * * *").alias("expr"), F.lit("UTC").alias("tz"),
        F.lit(0).cast("long").alias("timeout_ms"), F.col("event_type").alias("worker"), F.col("seq").alias("position"), (F.col("seq") % 6 == 0).alias("deleted"),
    )
    return schedule.with_workers(asks).select("name", F.array_join("workers", ",").alias("workers"))


@query(f"WITH {_M} SELECT seq FROM m WHERE ts_ms + CASE WHEN seq % 2 = 0 THEN 3600000 ELSE seq * 1000 END < {NOW_MS}")
def cron_timeouts(spark, d):
    running = event_messages(spark, d).select("seq", F.col("ts_ms").alias("running_since_ms"), F.when(F.col("seq") % 2 == 0, 0).otherwise(F.col("seq") * 1000).alias("timeout_ms"))
    return schedule.timed_out(running, NOW_MS).select("seq")


@query(f"WITH {_M} SELECT seq, CASE WHEN seq = 4711 OR event_type = 'click' THEN 1 ELSE 0 END AS flags FROM m WHERE seq >= 2500")
def tombstoned(spark, d):
    """A truncated front, one row deleted by seq and one stream by name."""
    m = event_messages(spark, d).select("seq", "flags", F.col("event_type").alias("stream"))
    return retention.tombstone_stream(retention.tombstone_at(retention.truncate_front(m, 2500), 4711), "click").select("seq", "flags")


@query(f"WITH {_M} SELECT 0 AS messages, max(seq) + 1 AS next_seq FROM m")
def purged(spark, d):
    """A purge leaves nothing, and seqs go on."""
    m = event_messages(spark, d).select("seq")
    return retention.purge(m).agg(F.count("*").cast("int").alias("messages")).join(m.agg((F.max("seq") + 1).alias("next_seq")), F.lit(True))


@query(f"WITH {_M} SELECT stream, seq FROM m WHERE seq % 3 <> 0")
def work_queue_rows(spark, d):
    m = event_messages(spark, d).select("stream", "seq")
    return retention.work_queue_retained(m, m.where("seq % 3 = 0"))


# ---- listings


@query("SELECT c_custkey AS consumer_id, c_mktsegment AS stream FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 10")
def consumer_listing(spark, d):
    """One page of a stream's consumers; the limit is the operator."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("consumer_id"), F.col("c_mktsegment").alias("stream"))
    return metrics.list_consumers(rows, "BUILDING", 10, 20)


@query("SELECT n_name AS name, n_regionkey FROM nation WHERE n_name = 'NATION_3'")
def catalog_entry(spark, d):
    return metrics.get(table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), "NATION_3")


@query(f"WITH {_M}, {_PENDING} SELECT count(*) AS pending FROM p WHERE consumer = 7")
def pending_of_consumer(spark, d):
    return metrics.pending_count(_pendings(spark, d), 7)


@query(f"WITH {_M}, {_PENDING}, n AS (SELECT consumer, count(*) AS n, min(seq) AS lo FROM p WHERE consumer < 18 GROUP BY consumer) SELECT i AS consumer_id, i % 2 = 0 AS paused, coalesce(n, 0) AS pending, lo AS oldest, CAST(CASE WHEN i < 10 THEN i * 3 ELSE 0 END AS BIGINT) AS floor FROM range(20) AS t(i) LEFT JOIN n ON n.consumer = i")
def consumer_snapshot(spark, d):
    c = spark.range(20).select(F.col("id").alias("consumer_id"), (F.col("id") % 2 == 0).alias("paused"))
    floors = spark.range(10).select(F.col("id").alias("consumer_id"), (F.col("id") * 3).alias("floor"))
    return metrics.consumer_states(c, _pendings(spark, d).where("consumer_id < 18"), floors)


# ---- codecs


@query(f"WITH {_M} SELECT seq, 'events' AS head, event_type || '.u' || CAST(user_id AS VARCHAR) AS tail, CASE WHEN seq % 2 = 0 THEN event_type END AS method, (seq * 1000003) // 1000000 AS ms FROM m")
def subject_parts(spark, d):
    """The first token and the rest, the method that a request names, and milliseconds of nanoseconds."""
    asked = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("_svc.store.m."), F.col("event_type"))).otherwise(F.col("subject"))
    return event_messages(spark, d).select(
        "seq", S.next_token("subject").alias("head"), S.rest("subject").alias("tail"), S.service_method(asked, "store").alias("method"),
        P.timestamp_ms(F.col("seq") * 1_000_003).alias("ms"),
    )


@query(f"WITH {_M} SELECT seq, event_type AS first, payload, CASE WHEN seq % 2 = 0 THEN 'inbox' END AS reply_to, CAST(user_id AS VARCHAR) AS coded FROM m")
def header_codec(spark, d):
    """Of equal header keys the first counts; a consumer sees payload and reply address."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    rows = event_messages(spark, d).select(
        "seq", F.array(pair("a", F.col("event_type")), pair("b", F.col("user_id").cast("string")), pair("a", F.lit("late"))).alias("pairs"),
        F.struct(F.col("payload"), F.when(F.col("seq") % 2 == 0, "inbox").alias("reply_to"), F.lit("x").alias("headers")).alias("message"),
    )
    return rows.select(
        "seq", P.header(F.col("pairs"), "a").alias("first"), P.delivered_payload(F.col("message"))["payload"].alias("payload"),
        P.delivered_payload(F.col("message"))["reply_to"].alias("reply_to"), F.element_at(P.headers_of(F.col("pairs")), "b").alias("coded"),
    )


@query(f"WITH {_M} SELECT seq, CAST(user_id AS VARCHAR) AS instance_id, CAST(seq % 9 AS INTEGER) AS step, CAST(seq % 4 AS INTEGER) AS attempt, payload AS context, seq % 2 = 0 AS is_compensation, ts_ms AS deadline_ms FROM m")
def task_codec(spark, d):
    """Tasks and parked states, coded and read again."""
    m = event_messages(spark, d)
    step = (F.col("seq") % 9).cast("int").bitwiseOR(F.when(F.col("seq") % 2 == 0, P.COMPENSATION_BIT).otherwise(0))
    coded = m.select(
        "seq", P.decode_task(P.encode_task(F.col("user_id").cast("string"), step, F.col("seq") % 4, F.col("payload"))).alias("t"),
        P.decode_parked(P.encode_parked(F.lit(1), F.col("ts_ms"), F.lit("s"))).alias("p"),
    )
    return coded.select("seq", "t.instance_id", "t.step", "t.attempt", "t.context", "t.is_compensation", "p.deadline_ms")


# ---- workflows and services


@query(f"WITH {_M} SELECT CAST(user_id AS VARCHAR) AS instance_id, min(seq) AS position, arg_min(event_type, seq) AS context FROM m GROUP BY user_id")
def workflow_triggers(spark, d):
    """Rows of another stream start instances, each once."""
    return workflow.triggers(event_messages(spark, d), "user_id", "event_type").select("instance_id", "position", "context")


@query(f"WITH {_M}, x AS (SELECT CAST(user_id AS VARCHAR) AS instance, arg_max(seq, seq) AS seq, arg_max(event_type, seq) AS e FROM m GROUP BY user_id) SELECT instance AS instance_id, CAST(seq % 5 AS INTEGER) AS step, e AS context FROM x WHERE seq % 2 = 0")
def suspended_instances(spark, d):
    """Instances whose last event parked them."""
    states = event_messages(spark, d).select(
        F.col("user_id").cast("string").alias("instance_id"), F.col("seq").alias("position"), F.when(F.col("seq") % 2 == 0, "park").otherwise("remove").alias("kind"),
        (F.col("seq") % 5).cast("int").alias("step"), F.col("event_type").alias("context"),
    )
    return workflow.suspended(states)


def _shout(text: str) -> str:
    if text == "error":
        raise ValueError("refused")
    return text.upper()


@query(f"WITH {_M} SELECT seq, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS reply, CASE WHEN event_type = 'error' THEN 'nack' ELSE 'ack' END AS outcome FROM m")
def service_replies(spark, d):
    """Requests answered by a function; its error is a nack."""
    rows = event_messages(spark, d).select("seq", F.col("event_type").alias("payload"))
    return workflow.handled(rows, _shout, "seq long").select("seq", "reply", "outcome")


# ---- catalog


def _catalog(spark, d) -> dict[str, DataFrame]:
    """Segments of the market as streams, customers as consumers, orders as subscriptions with bindings."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    streams = c.select(F.col("c_mktsegment").alias("name")).distinct().withColumn("filter", F.concat(F.lower("name"), F.lit(".>")))
    consumers = c.select(
        F.col("c_custkey").alias("consumer_id"), F.col("c_mktsegment").alias("stream"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"),
        F.concat(F.lower("c_mktsegment"), F.lit(".n"), F.col("c_nationkey").cast("string"), F.lit(".>")).alias("filter"),
    )
    subscriptions = o.select(F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("consumer_id"))
    bindings = subscriptions.select(
        "subscription_id", "consumer_id", F.col("subscription_id").alias("binding_id"), (F.col("subscription_id") % 50).alias("connection_id"), F.col("subscription_id").alias("bound_at"),
    )
    return {"streams": streams, "consumers": consumers, "subscriptions": subscriptions, "bindings": bindings}


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, t in sorted(tables.items())]
    out = counted[0]
    for t in counted[1:]:
        out = out.unionByName(t)
    return out


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT 'bindings' AS kind, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT * FROM g) UNION ALL SELECT 'consumers', count(*) FROM customer WHERE c_custkey NOT IN (SELECT * FROM g)
UNION ALL SELECT 'streams', count(DISTINCT c_mktsegment) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'subscriptions', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM g)""")
def delete_stream_cascade(spark, d):
    """What is left when streams go with all that hangs on them."""
    return _sizes(catalog.delete_streams(["BUILDING", "MACHINERY"], *_catalog(spark, d).values()))


@query("SELECT o_orderkey AS subscription_id, o_custkey AS consumer_id FROM orders WHERE o_custkey % 3 <> 0")
def delete_consumer_cascade(spark, d):
    t = _catalog(spark, d)
    gone = t["consumers"].where("consumer_id % 3 = 0").select("consumer_id")
    return catalog.delete_consumers(gone, t["consumers"], t["subscriptions"], t["bindings"])["subscriptions"]


@query("SELECT o_orderkey AS binding_id FROM orders WHERE o_orderkey % 50 NOT IN (3, 4) AND o_custkey NOT IN (5, 7)")
def drop_connection_rows(spark, d):
    """Connections close, and two consumers leave with all their bindings."""
    kept = catalog.drop_connections([3, 4], _catalog(spark, d))["bindings"]
    return catalog.unsubscribe(kept, [5, 7]).select("binding_id")


@query("SELECT o_custkey AS subscription_id, max(o_orderkey) AS binding_id FROM orders GROUP BY o_custkey")
def latest_bindings(spark, d):
    """One binding for each subscription: the latest."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subscription_id"), F.col("o_orderkey").alias("binding_id"), (F.col("o_orderkey") * 2).alias("bound_at"))
    return catalog.bound(o).select("subscription_id", "binding_id")


@query("SELECT c_custkey AS consumer_id, 'have' AS state FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'asked' FROM customer WHERE c_custkey % 2 = 1")
def upserted(spark, d):
    """Create or keep: entries that are there stay as they are."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("consumer_id"))
    return catalog.upsert(c.withColumn("state", F.lit("asked")), c.where("consumer_id % 2 = 0").withColumn("state", F.lit("have")), ["consumer_id"])


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 10 = 0 THEN 'consumer_unknown' WHEN o_orderkey % 7 = 0 THEN 'filter_invalid' WHEN o_orderkey % 5 = 0 THEN 'filter_outside_consumer' ELSE 'subscribed' END AS verdict
FROM orders JOIN customer ON c_custkey = o_custkey""")
def subscribe_verdicts(spark, d):
    """A verdict for each subscription: unknown consumers, bad filters, filters outside of the consumer's."""
    c = _catalog(spark, d)["consumers"]
    asked = F.when(F.col("o_orderkey") % 7 == 0, "a..b").when(F.col("o_orderkey") % 5 == 0, "other.x").otherwise(F.concat(F.regexp_replace("filter", r"\.>$", ""), F.lit(".x")))
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("consumer_id")).select(
        F.col("o_orderkey").alias("request_id"), "consumer_id", F.array(asked).alias("filters")
    )
    return catalog.subscription_verdicts(rows, c.where("consumer_id % 10 <> 0")).select("request_id", "verdict")


@query("""WITH v AS (SELECT o_orderkey // 4 AS batch, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey // 4 % 5 = 0 THEN 'consumer_unknown' ELSE 'subscribed' END AS verdict FROM orders)
SELECT batch AS batch_id, CASE WHEN bool_and(verdict = 'consumer_unknown') THEN 'consumer_unknown' END AS error, CAST(count(*) FILTER (WHERE verdict <> 'subscribed') AS BIGINT) AS rejected FROM v GROUP BY batch""")
def subscribe_batches(spark, d):
    """Batches report each reject; a uniform failure is one error."""
    batch = F.floor(F.col("o_orderkey") / 4)
    bad = (F.col("o_orderkey") % 3 == 0) | (batch % 5 == 0)
    return catalog.batch_reply(table(spark, d, "orders").select(batch.alias("batch_id"), F.when(bad, "consumer_unknown").otherwise("subscribed").alias("verdict")))


_CONSUMER_SQL = """SELECT c_custkey AS consumer_id, CASE WHEN c_custkey % 19 = 0 THEN 'stream_unknown' WHEN c_custkey % 17 = 0 THEN 'group_missing' WHEN c_custkey % 13 = 0 THEN 'needs_explicit_acks'
  WHEN c_custkey % 11 = 0 THEN 'start_seq_missing' WHEN c_custkey % 7 = 0 THEN 'filter_outside_stream' WHEN c_custkey % 4 = 0 THEN 'same' WHEN c_custkey % 4 = 1 THEN 'mismatch' ELSE 'created' END AS verdict FROM customer"""


def _consumer_requests(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = _catalog(spark, d)
    k = F.col("consumer_id")
    when = lambda n, x: F.when(k % n == 0, x)
    full = t["consumers"].select(
        "consumer_id", "stream", "name", F.lit("g").alias("group_name"), F.concat(F.lower("stream"), F.lit(".c"), k.cast("string")).alias("filter"),
        F.lit("fanout").alias("mode"), F.lit("explicit").alias("ack_policy"), F.lit("all").alias("deliver_policy"), F.lit(0).cast("long").alias("start_seq"),
        F.lit(5).cast("long").alias("max_inflight"), F.lit(0).cast("long").alias("ack_wait_ms"), F.lit(False).alias("paused"),
    )
    asks = full.withColumns(
        {
            "stream": when(19, F.lit("nowhere")).otherwise(F.col("stream")), "group_name": when(17, F.lit("")).otherwise(F.col("group_name")),
            "ack_policy": when(13, F.lit("none")).otherwise(F.col("ack_policy")), "deliver_policy": when(11, F.lit("by_start_seq")).otherwise(F.col("deliver_policy")),
            "filter": when(7, F.lit("outside.x")).otherwise(F.col("filter")),
        }
    )
    have = full.where("consumer_id % 4 < 2").withColumn("max_inflight", F.when(k % 4 == 0, F.col("max_inflight")).otherwise(9).cast("long"))
    return asks, t["streams"], have


@query("SELECT stream, count(*) AS n, max(tail) AS tail FROM (SELECT c_mktsegment AS stream, CASE WHEN c_custkey % 2 = 0 THEN 40 ELSE 0 END AS tail FROM customer) GROUP BY stream")
def created_consumers(spark, d):
    """Consumers afterwards; those of policy New are stamped with their stream's tail."""
    t = _catalog(spark, d)
    asks, _, _ = _consumer_requests(spark, d)
    clean = t["consumers"].select(F.col("consumer_id").alias("k"), F.col("stream").alias("s"), F.concat(F.lower("stream"), F.lit(".c"), F.col("consumer_id").cast("string")).alias("f"))
    whole = asks.join(clean, F.col("consumer_id") == F.col("k")).withColumns(
        {
            "stream": F.col("s"), "filter": F.col("f"), "group_name": F.lit("g"), "ack_policy": F.lit("explicit"),
            "deliver_policy": F.when(F.col("consumer_id") % 2 == 0, "new").otherwise("all"),
        }
    ).drop("k", "s", "f")
    tails = t["streams"].select(F.col("name").alias("stream"), F.lit(40).cast("long").alias("last_seq"))
    rows = catalog.create_consumers(whole, t["streams"], whole.where("consumer_id < 0"), tails)
    return rows.groupBy("stream").agg(F.count("*").alias("n"), F.max("start_seq").cast("int").alias("tail"))


@query("""SELECT o_orderkey AS subscription_id, c_mktsegment AS stream, o_orderkey % 50 AS connection_id, c_custkey % 2 = 0 AS paused FROM orders JOIN customer ON c_custkey = o_custkey""")
def delivery_snapshot(spark, d):
    """One row for each bound subscription, with what delivery asks of its consumer and stream."""
    t = _catalog(spark, d)
    streams = t["streams"].withColumns({"max_age_ms": F.lit(0), "created_at_seq": F.lit(1)})
    consumers = t["consumers"].withColumns({"group_name": F.lit("g"), "mode": F.lit("fanout"), "ack_policy": F.lit("explicit"), "max_inflight": F.lit(0), "paused": F.col("consumer_id") % 2 == 0})
    subscriptions = t["subscriptions"].join(t["consumers"].select("consumer_id", "stream"), "consumer_id")
    return catalog.snapshot(streams, consumers, subscriptions, t["bindings"]).select("subscription_id", "stream", "connection_id", "paused")
