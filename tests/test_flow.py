"""Credit, acks, dedup, time, retention, catalog and workflows against plain simulations."""

import itertools
import random
import threading
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowlark.functions import subjects as S
from flowlark.operators import acks, catalog, credit, dedup, metrics, retention, schedule, workflow
from flowlark.sources import log, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- credit


def test_credit_is_the_delivery_loop(spark):
    rng = random.Random(3)
    rows = [(c, q, rng.choice("abcd"), rng.choice([1, 2, 5]), 8 * (c % 2)) for c in range(4) for q in range(60)]
    limit = {(c, s): rng.choice([None, 1, 4]) for c in range(4) for s in "abcd"}
    rows = [(c, q, s, limit[c, s], m) for c, q, s, _, m in rows]
    want, held, cursor = set(), defaultdict(Counter), {}
    for c, q, s, cap, most in rows:
        total = sum(held[c].values())
        if (most and total >= most) or (cap is not None and held[c][s] >= cap):
            cursor.setdefault(c, q - 1)
            continue
        held[c][s] += 1
        want.add((c, q))
    for c, q, *_ in rows:
        if c not in cursor and q == 59:
            cursor[c] = q
    owed = frame(spark, rows, "consumer_id long, seq long, subject string, limit long, max_inflight long")
    sent = credit.credit(owed)
    assert {(r["consumer_id"], r["seq"]) for r in sent.collect()} == want
    assert {r["consumer_id"]: r["cursor"] for r in credit.cursor_pin(owed, sent).collect()} == cursor


def test_known_cap_is_pruned_before_the_shuffle(spark, capsys):
    owed = frame(spark, [(1, 1, "a")], "consumer_id long, seq long, subject string")
    credit.capped(owed, ["subject"], 2).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_credit_with_acks(spark):
    e = [(1, 0, k, "offer", k, "a" if k < 4 else "b", 2, 3) for k in range(1, 7)]
    e += [(1, 10, 10, "ack", 1, None, None, None), (1, 20, 11, "nack", 2, None, None, None), (1, 30, 12, "ack", 99, None, None, None)]
    events = frame(spark, e, "consumer_id long, at_ms long, position long, kind string, seq long, subject string, limit long, max_inflight long")
    got = [(r["seq"], r["at_ms"], r["attempt"]) for r in credit.credit_with_acks(events).orderBy("at_ms", "seq").collect()]
    assert got == [(1, 0, 1), (2, 0, 1), (4, 0, 1), (3, 10, 1), (2, 20, 2)]


def test_capacity_quota_rate_and_stalls(spark):
    consumers = frame(spark, [(1, "a", 2, False), (2, "b", 0, False)], "consumer_id long, name string, max_inflight long, paused boolean")
    pend = frame(spark, [(1, 1), (1, 2), (2, 1)], "consumer_id long, seq long")
    assert {r["consumer_id"]: r["has_capacity"] for r in credit.with_capacity(consumers, pend).collect()} == {1: False, 2: True}
    assert [r["paused"] for r in credit.paused(consumers, ["b"]).orderBy("consumer_id").collect()] == [False, True]
    frames = frame(spark, [(1, k, k * 100) for k in range(20)], "connection_id long, frame_id long, ts_ms long")
    assert credit.rate_limited(frames, 3).where("accepted").count() == 6
    progress = frame(spark, [(1, 100, 5), (2, 100, 0), (3, 950, 5)], "connection_id long, progress_ms long, owed long")
    assert [r[0] for r in credit.stalled_connections(progress, 1000, 500).collect()] == [1]
    owned = frame(spark, [(1, "streams")] * 3 + [(2, "streams")], "connection_id long, kind string")
    assert [(r[0], r["n"]) for r in credit.over_quota(owned, 2).collect()] == [(1, 3)]


# ---- acks


@pytest.mark.parametrize("base", [0, 3])
def test_ack_floor(spark, base):
    rng = random.Random(base)
    rows = [(c, q) for c in range(12) for q in range(1, 30) if rng.random() < c / 11]
    want = {}
    for c in {c for c, _ in rows}:
        have, f = {q for k, q in rows if k == c}, base
        while f + 1 in have:
            f += 1
        want[c] = f
    got = acks.ack_floor(frame(spark, rows, "consumer_id long, seq long"), F.lit(base))
    assert {r["consumer_id"]: r["floor"] for r in got.collect()} == want


def test_ack_life(spark):
    sent = frame(spark, [(1, q, 0, 100 * q) for q in range(1, 6)], "consumer_id long, seq long, attempt int, delivered_ms long")
    done = frame(spark, [(1, 1, "ack", 150, None), (1, 2, "nack", 260, 1000), (1, 4, "term", 420, None), (1, 9, "ack", 1, None)], "consumer_id long, seq long, kind string, acked_ms long, delay_ms long")
    consumers = frame(spark, [(1, "explicit"), (2, "none")], "consumer_id long, ack_policy string")
    opened = acks.opened(sent.union(sent), consumers)
    assert opened.count() == 5
    assert sorted(r["seq"] for r in acks.settled(opened, done).collect()) == [3, 5]
    assert [r["seq"] for r in acks.unknown(done, opened).collect()] == [9]
    assert {r["kind"]: (r["accepted"], r["not_found"]) for r in acks.ack_replies(done, opened).collect()} == {"ack": (1, 1), "nack": (1, 0), "term": (1, 0)}
    assert [(r["seq"], r["due_ms"]) for r in acks.timeouts(sent, done, 100, 420).collect()] == [(3, 400)]
    assert [(r["seq"], r["offer_ms"]) for r in acks.redeliveries(done).collect()] == [(2, 1260)]
    messages = frame(spark, [(4, 0), (5, 0)], "seq long, flags int")
    assert {r["seq"]: r["flags"] for r in acks.terminated(messages, done).collect()} == {4: 1, 5: 0}
    cursors = frame(spark, [(1, 50), (2, 60)], "consumer_id long, cursor long")
    assert {r["consumer_id"]: r["cursor"] for r in acks.rewound(cursors, frame(spark, [(1, 7), (1, 9)], "consumer_id long, seq long")).collect()} == {1: 6, 2: 60}
    rows = frame(spark, [("new", 5, 9, 3), ("by_start_seq", 5, 9, 3), ("all", 5, 9, 3), ("all", None, 9, 3)], "p string, c long, f long, s long")
    assert [r[0] for r in rows.select(acks.resume_from(F.col("p"), F.col("c"), F.col("f"), F.col("s"))).collect()] == [10, 3, 6, 1]


def test_client_records(spark):
    key = "stream string, consumer_id long, seq long"
    sent = frame(spark, [("s", 1, 1), ("s", 1, 1), ("s", 1, 2), ("s", 2, 1)], key)
    seen = frame(spark, [("s", 1, 2)], key)
    assert {tuple(r) for r in acks.first_seen(sent, seen).collect()} == {("s", 1, 1), ("s", 2, 1)}
    wal = frame(spark, [("s", 1, 1, "record", 10, 0), ("s", 1, 2, "record", 10, 1), ("s", 1, 2, "forget", 11, 2), ("s", 1, 3, "record", -90, 3)], key + ", op string, at_ms long, position long")
    assert [r["seq"] for r in acks.replayed_wal(wal, 20, 100).collect()] == [1]
    floors = frame(spark, [("s", 1, 1)], "stream string, consumer_id long, floor long")
    assert [r["seq"] for r in acks.confirmed_up_to(frame(spark, [("s", 1, 1), ("s", 1, 2)], key), floors).collect()] == [2]
    late = frame(spark, [(1, 5, 1), (1, 6, 2)], "consumer_id long, seq long, generation long")
    assert [r["seq"] for r in acks.deferred(late, frame(spark, [(1, 2)], "consumer_id long, generation long")).collect()] == [6]


# ---- dedup


def test_first_sight_does_not_slide(spark):
    rng = random.Random(9)
    rows, at = [], 0
    for q in range(800):
        at += rng.choice([0, 1, 40, 150])
        rows.append((q, rng.choice(["a", "b", "c", ""]), at))
    last, want = {}, set()
    for q, k, t in rows:
        if k == "" or k not in last or t >= last[k] + 100:
            last[k] = t
            want.add(q)
    got = dedup.first_sight(frame(spark, rows, "seq long, msg_id string, ts_ms long"), ["msg_id"], 100)
    assert {r["seq"] for r in got.where("accepted").collect()} == want and got.count() == 800
    assert dedup.effective_window(1) == 1000 and dedup.effective_window(10**9) == 300_000


def test_batches_are_atomic(spark):
    rows = [(1, "s", "a"), (1, "s", "b"), (2, "s", "c"), (2, "s", "c"), (3, "s", ""), (3, "s", ""), (4, "s", "z")]
    seen = frame(spark, [("s", "z")], "stream string, msg_id string")
    found = dedup.accepted_batches(frame(spark, rows, "batch_id long, stream string, msg_id string"), seen)
    assert {r["batch_id"]: r["accepted"] for r in found.collect()} == {1: True, 2: False, 3: True, 4: False}
    ids = frame(spark, [("s", "a"), ("s", "q")], "stream string, msg_id string")
    batch = frame(spark, rows, "batch_id long, stream string, msg_id string")
    assert [r["msg_id"] for r in dedup.forgotten(ids, batch).collect()] == ["q"] and dedup.seen_ids(batch, ids).count() == 1


# ---- retention


@pytest.mark.parametrize("by", [[], ["stream"]])
def test_newest_and_admitted(spark, by):
    rng = random.Random(4)
    rows = [(q * 3 + rng.randint(0, 2), rng.choice("xy"), rng.randint(1, 9)) for q in range(500)]
    df = frame(spark, rows, "seq long, stream string, nbytes long")
    groups = defaultdict(list)
    for r in sorted(rows):
        groups[r[1] if by else ""].append(r)
    take = lambda f: {r[0] for g in groups.values() for r in f(g)}

    def within(g, most):
        out, b = [], 0
        for r in g:
            b += r[2]
            if b > most:
                break
            out.append(r)
        return out

    seqs = lambda d: {r["seq"] for r in d.collect()}
    for n in (0, 1, 77, 10_000):
        assert seqs(retention.newest_messages(df, n, by)) == take(lambda g: g[len(g) - min(n, len(g)) :])
        assert seqs(retention.admitted_messages(df, n, by)) == take(lambda g: g[:n])
        assert seqs(retention.newest_bytes(df, n, by)) == take(lambda g: within(g[::-1], n))


def test_byte_quota_is_greedy(spark):
    rows = [("a", 1, 6), ("a", 2, 6), ("a", 3, 3), ("a", 4, 2), ("b", 5, 11), ("b", 6, 10)]
    found = retention.admitted_bytes(frame(spark, rows, "stream string, seq long, nbytes long"), 10, ["stream"])
    assert {r["seq"] for r in found.where("accepted").collect()} == {1, 3, 6}
    batches = frame(spark, [(1, 1, 5), (1, 2, 5), (2, 3, 9), (3, 4, 1)], "batch_id long, seq long, nbytes long")
    assert {r["batch_id"]: r["accepted"] for r in retention.admitted_batches(batches, 3, 12).collect()} == {1: True, 2: False, 3: True}


def test_purges_and_tombstones(spark):
    df = frame(spark, [(1, 10, "s", "a.b", 0), (2, 99, "s", "a.c", 0), (3, 20, "t", "a.b", 0), (4, 30, "s", "x", 1)], "seq long, ts_ms long, stream string, subject string, flags int")
    seqs = lambda d: sorted(r["seq"] for r in d.collect())
    assert seqs(retention.purge_before(df, 50)) == [2, 3, 4] and seqs(retention.purge_before(df, 1000)) == []
    assert seqs(retention.drain(df, "s", "a.*")) == [3, 4] and seqs(retention.drain(df, "s")) == [3]
    assert seqs(retention.compact(retention.tombstone_at(df, 2))) == [1, 3] and seqs(retention.compact(retention.tombstone_stream(df, "s"))) == [3]
    assert seqs(retention.truncate_front(df, 3)) == [3, 4] and seqs(retention.purge(df)) == []
    assert seqs(retention.work_queue_retained(df, frame(spark, [("s", 1)], "stream string, seq long"))) == [2, 3, 4]
    assert seqs(retention.page(df, "seq", 1, 2)) == [2, 3]


# ---- time


def test_delayed_order(spark):
    rows = [(k, (k * 7919) % 50) for k in range(200)]
    got = schedule.matured(frame(spark, rows, "offset long, deliver_at long"), 30, 500).orderBy("seq").collect()
    want = sorted((t, k) for k, t in rows if t <= 30)
    assert [(r["deliver_at"], r["offset"]) for r in got] == want and [r["seq"] for r in got] == list(range(500, 500 + len(want)))
    assert schedule.next_deadline(frame(spark, [(1, 40)], "offset long, deliver_at long"), 30).first()[0] == 10


@pytest.mark.parametrize(
    "expr, n", [("0 0 * * *", 31), ("*/30 * * * *", 31 * 48), ("0 12 1,15 * *", 2), ("0 9-17/4 * * mon-fri", 23 * 3), ("0 0 13 * fri", 5), ("15 0 0 * * 7", 4), ("@weekly", 4), ("0 0 31 2 *", 0)]
)
def test_cron(spark, expr, n):
    assert schedule.cron_fires(spark, "j", expr, "2024-01-01 00:00:00", "2024-02-01 00:00:00").count() == n


def test_cron_time_zone(spark):
    got = schedule.cron_fires(spark, "j", "0 9 * * *", "2024-03-30 00:00:00", "2024-04-01 00:00:00", "Europe/Paris").orderBy("fire")
    assert [r[0] for r in got.select(F.date_format("fire_ts", "dd HH:mm")).collect()] == ["30 08:00", "31 07:00"]
    with pytest.raises(ValueError):
        schedule.cron_parts("61 * * * *")


def test_cron_workers_and_overlap(spark):
    rows = [("j", t, took, 0, False, ["a", "b"]) for t, took in ((0, 50), (100, 250), (200, 10), (300, 10), (400, None), (500, 1), (3_700_000, 1))]
    runs = schedule.cron_runs(frame(spark, rows, "name string, due_ms long, took_ms long, timeout_ms long, overlap boolean, workers array<string>"))
    got = [(r["due_ms"], r["worker"]) for r in runs.where("fired").orderBy("due_ms").collect()]
    assert got == [(0, "a"), (100, "b"), (400, "a"), (3_700_000, "b")]
    asks = frame(spark, [("j", "* * * * *", "UTC", 0, "w1", 1, False), ("j", "x", "UTC", 5, "w2", 2, False), ("j", "x", "UTC", 5, "w1", 3, True)], "name string, expr string, tz string, timeout_ms long, worker string, position long, deleted boolean")
    row = schedule.with_workers(asks).first()
    assert row["workers"] == ["w2"] and row["expr"] == "* * * * *" and row["timeout_ms"] == 3_600_000


# ---- catalog


def test_stream_rules(spark):
    have = frame(spark, [("old", "old.>"), ("log", "log.*")], "name string, filter string")
    asks = [("new", "new.>"), ("old", "old.>"), ("log", "log.>"), ("all", ">"), ("none", ""), ("bad name", "x"), ("clash", "old.a"), ("odd", "a..b"), ("wild", "*.a")]
    got = {r["name"]: r["verdict"] for r in catalog.stream_verdicts(frame(spark, asks, "name string, filter string"), have).collect()}
    assert got == {
        "new": "filter_overlaps", "old": "exists", "log": "filter_changed", "all": "filter_too_wide", "none": "filter_missing",
        "bad name": "name_invalid_char", "clash": "filter_overlaps", "odd": "filter_invalid_char", "wild": "filter_overlaps",
    }


CONSUMER = "name string, stream string, group_name string, filter string, ack_policy string, deliver_policy string, start_seq long, max_inflight long, ack_wait_ms long"


def test_consumer_rules(spark):
    streams = frame(spark, [("s", "o.>")], "name string, filter string")
    have = frame(spark, [("c0", "s", "g", "o.a.*", "explicit", "all", 0, 5, 0)], CONSUMER)
    asks = [
        ("c0", "s", "g", "o.a.*", "explicit", "all", 0, 5, 0), ("c1", "s", "g", "", "explicit", "all", 0, 0, 0), ("c2", "s", "", "o.b", "explicit", "all", 0, 0, 0),
        ("c3", "x", "g", "o.b", "explicit", "all", 0, 0, 0), ("c4", "s", "g", "p.b", "explicit", "all", 0, 0, 0), ("c5", "s", "g", "o.c", "none", "all", 0, 5, 0),
        ("c6", "s", "g", "o.d", "explicit", "by_start_seq", 0, 0, 0), ("c7", "s", "g", "o.e.f", "none", "all", 0, 0, 0),
    ]
    got = {r["name"]: r["verdict"] for r in catalog.consumer_verdicts(frame(spark, asks, CONSUMER), streams, have).collect()}
    assert got == {
        "c0": "same", "c1": "filter_nested", "c2": "group_missing", "c3": "stream_unknown", "c4": "filter_outside_stream",
        "c5": "needs_explicit_acks", "c6": "start_seq_missing", "c7": "filter_nested",
    }
    changed = frame(spark, [("c0", "s", "g", "o.a.*", "explicit", "all", 0, 6, 0), ("c8", "s", "g", "o.z", "none", "new", 0, 0, 0)], CONSUMER)
    verdicts = {r["name"]: r["verdict"] for r in catalog.consumer_verdicts(changed, streams, have).collect()}
    assert verdicts == {"c0": "mismatch", "c8": "created"}
    after = catalog.create_consumers(changed, streams, have, frame(spark, [("s", 42)], "stream string, last_seq long"))
    assert {r["name"]: r["start_seq"] for r in after.collect()} == {"c0": 0, "c8": 42}


def test_nesting_equals_all_pairs(spark):
    """Look-ups by shape find what a comparison of all pairs finds, also for filters that nothing validated."""
    odd = [None, "", ".", "a.", ".a", "a..b", ">", "*", "*.>", ">.a", "a.>.b", "*.>.>", "a*.b", "a.b>", ">.>", "a.*.", "*.*.>"]
    tokens = ["a", "b", "*"]
    plain = [".".join(x) for n in (1, 2, 3) for x in itertools.product(tokens, repeat=n)]
    filters = odd + plain + [p + ".>" for p in plain if p.count(".") < 2]
    rows = [(f"c{i % 50}" if i % 17 else None, ["s", "t", None][i % 7 // 3], f) for i, f in enumerate(filters * 3)]
    rows += [("c1", "u", "a.b"), ("c1", "u", "a.*"), ("c2", "u", "b.*")]  # a consumer's own filters may nest
    t = frame(spark, rows, "name string, stream string, filter string")
    a, b = (t.select(*[F.col(c).alias(f"{x}_{c}") for c in t.columns]) for x in "ab")
    every = a.crossJoin(b).where((F.col("a_stream") == F.col("b_stream")) & (F.col("a_name") != F.col("b_name")) & S.strictly_nested("b_filter", "a_filter"))
    want = [(r["a_stream"], r["a_name"], r["b_name"]) for r in every.collect()]
    assert len(want) > 500
    assert sorted((r["stream"], r["outer"], r["inner"]) for r in catalog.nested_consumers(t).collect()) == sorted(want)
    names = {(s, n) for s, *pair in want for n in pair}
    got = [tuple(r) for r in catalog.in_nesting(t).select("stream", "name").collect()]
    assert len(got) == len(names) and set(got) == names
    assert {s for s, _ in names} == {"s", "t"}


def test_consumers_of_a_stream_are_not_compared_in_pairs(spark):
    """Two streams of 20,000 consumers: one of literal filters, one where 10,000 share a filter that holds the others'."""
    k = F.col("id").cast("string")
    asks = spark.range(40_000).select(
        F.concat(F.lit("c"), k).alias("name"), F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("stream"), F.lit("g").alias("group_name"),
        F.when(F.col("id") % 4 == 0, "s.*").otherwise(F.concat(F.when(F.col("id") % 2 == 0, "s.c").otherwise("t.c"), k)).alias("filter"),
        F.lit("explicit").alias("ack_policy"), F.lit("all").alias("deliver_policy"), *[F.lit(0).cast("long").alias(c) for c in ("start_seq", "max_inflight", "ack_wait_ms")],
    )
    streams = frame(spark, [("s", "s.>"), ("t", "t.>")], "name string, filter string")
    context = spark.sparkContext
    context.setJobGroup("pairs", "consumer verdicts", interruptOnCancel=True)
    stop = threading.Timer(90, context.cancelJobGroup, ["pairs"])
    stop.start()
    try:
        verdicts = catalog.consumer_verdicts(asks, streams, asks.limit(0))
        got = {(r["stream"], r["verdict"]): r["n"] for r in verdicts.groupBy("stream", "verdict").agg(F.count("*").alias("n")).collect()}
    finally:
        stop.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == {("s", "filter_nested"): 20_000, ("t", "created"): 20_000}


def test_subscriptions_and_bindings(spark):
    consumers = frame(spark, [(1, "o.>")], "consumer_id long, filter string")
    asks = [(1, 1, 1, ["o.a"]), (1, 2, 1, []), (1, 3, 9, ["o.a"]), (2, 4, 1, ["p"]), (2, 5, 1, ["q"]), (3, 6, 1, ["a b"])]
    v = catalog.subscription_verdicts(frame(spark, asks, "batch_id long, request_id long, consumer_id long, filters array<string>"), consumers)
    assert [r["verdict"] for r in v.orderBy("request_id").collect()] == ["subscribed", "subscribed", "consumer_unknown", "filter_outside_consumer", "filter_outside_consumer", "filter_invalid"]
    assert {r["batch_id"]: (r["error"], r["rejected"]) for r in catalog.batch_reply(v).collect()} == {1: (None, 1), 2: ("filter_outside_consumer", 2), 3: ("filter_invalid", 1)}
    b = frame(spark, [(1, 1, 7, 1, 10), (2, 1, 7, 2, 20), (3, 2, 8, 2, 5)], "binding_id long, subscription_id long, consumer_id long, connection_id long, bound_at long")
    assert {r["binding_id"] for r in catalog.bound(b).collect()} == {2, 3}
    assert {r["binding_id"] for r in catalog.unsubscribe(b, [7]).collect()} == {3}
    assert {r["binding_id"] for r in catalog.drop_connections([2], {"b": b})["b"].collect()} == {1}


def test_metrics(spark):
    ticks = frame(spark, [("a", 1, 5), ("a", 2, 9), ("a", 3, 2)], "k string, t long, n long")
    assert [r["delta"] for r in metrics.deltas(ticks, ["k"], "t", "n").orderBy("t").collect()] == [5, 4, 0]
    line = metrics.prometheus(frame(spark, [('x"y', 3)], "s string, n long"), "m", "n", ["s"]).first()[0]
    assert line == 'm{s="x\\"y"} 3'
    kept, seen = metrics.observed_drops(frame(spark, [(1,), (2,), (None,)], "v long"), {"two": F.col("v") == 2, "none": F.col("v").isNull()})
    assert kept.count() == 1 and seen.get == {"two": 1, "none": 1}


# ---- logs


def test_log(spark, tmp_path):
    rows = frame(spark, [("s", f"a.{k}", 1000 + k, {"msg-id": str(k % 3)} if k % 2 else {}, None, f"p{k}") for k in range(50)], "stream string, subject string, ts_ms long, headers map<string,string>, reply_to string, payload string")
    stored = sinks.numbered(sinks.publishable(rows).drop("error"), 100, "ts_ms")
    path = str(tmp_path / "log")
    sinks.append(stored, path, segment_rows=7)
    full = log.MESSAGES.add("crc", "long")
    df = log.open_log(spark, path, full)
    assert df.count() == 50 and log.verified(df).count() == 50 and log.segments(df).count() >= 7
    assert [r["seq"] for r in log.range_scan(df, 110, 113).collect()] == [110, 111, 112]
    assert log.lookup(df, 120).first()["subject"] == "a.20" and log.lower_bound(df, 149).first()[0] == 149
    assert log.store_info(df).first()["messages"] == 50 and log.feed(df, 120, 5).count() == 5
    bad = df.withColumn("payload", F.when(F.col("seq") == 130, "x").otherwise(F.col("payload")))
    assert log.corrupt(bad).count() == 1 and log.recovered(bad).count() == 30 and log.verified(bad).count() == 49
    ids = {r["msg_id"]: r["remaining_ms"] for r in log.idempotency_rebuild(df, 1050, 10).collect()}
    assert ids == {"0": 5, "1": 9, "2": 7} and log.continues(df, 99) and not log.continues(df, 98)


def test_catalog_replay(spark):
    rows = [(1, "create", "stream", "a", "v1"), (2, "create", "stream", "b", "v1"), (3, "delete", "stream", "a", None), (4, "create", "stream", "a", "v2"), (5, "delete", "stream", "b", None), (6, "cursor", "consumer", "c", "9"), (0, "create", "consumer", "c", "w")]
    got = {(r["kind"], r["name"]): (r["body"], r["cursor"]) for r in log.replayed_catalog(frame(spark, rows, "position long, command string, kind string, name string, body string")).collect()}
    assert got == {("stream", "a"): ("v2", None), ("consumer", "c"): ("w", "9")}


def test_sinks(spark):
    rows = frame(spark, [(k, 0, 10 if k else 8 * 24 * 3600 * 1000) for k in range(5)], "seq long, ts_ms long, delay_ms long")
    assert sinks.delayed(rows, already=99_998).where("error is null").count() == 2
    assert sinks.delayed(rows).where("error = 'delay_too_long'").count() == 1
    a, b = (frame(spark, x, "consumer_id long, cursor long") for x in ([(1, 5), (2, 6)], [(1, 5), (2, 7), (3, 1)]))
    assert {r["consumer_id"] for r in sinks.changed_cursors(a, b).collect()} == {2, 3}
    offers = frame(spark, [(1, q) for q in range(5)] + [(2, 9)], "connection_id long, seq long")
    live = frame(spark, [(1, 3, True), (2, 5, False)], "connection_id long, room long, alive boolean")
    assert Counter(r["outcome"] for r in sinks.delivered(offers, live).collect()) == {"ok": 3, "backpressured": 2, "writer_gone": 1}


# ---- workflows


def test_workflow(spark):
    e = [
        ("a", 0, "trigger", 0, 0), ("a", 1, "ok", 0, 0), ("a", 2, "ok", 1, 0), ("a", 3, "ok", 2, 0), ("a", 4, "ok", 2, 0),
        ("b", 0, "trigger", 0, 0), ("b", 1, "trigger", 0, 0), ("b", 2, "ok", 0, 0), ("b", 3, "error", 1, 0), ("b", 4, "error", 1, 1), ("b", 5, "ok", 1, 1),
        ("c", 0, "trigger", 0, 0), ("c", 1, "suspend", 0, 0), ("c", 2, "timeout", 5, 0), ("c", 3, "resume", 0, 0), ("c", 4, "resume", 0, 0), ("c", 5, "cancel", 0, 0),
        ("d", 0, "trigger", 0, 0), ("d", 1, "suspend", 0, 0), ("d", 2, "cancel", 0, 0), ("d", 3, "resume", 0, 0),
    ]
    events = frame(spark, [(*x, None) for x in e], workflow.EVENTS)
    got = defaultdict(list)
    for r in workflow.replay(events, 3, max_retries=1).orderBy("instance_id", "position").collect():
        got[r["instance_id"]].append((r["kind"], r["step"], r["attempt"]))
    assert got["a"] == [("task", 0, 0), ("task", 1, 0), ("task", 2, 0), ("done", 2, 0)]
    assert got["b"] == [("task", 0, 0), ("task", 1, 0), ("task", 1, 1), ("dead", 1, 1), ("compensate", 0x8000, 0)]
    assert got["c"] == [("task", 0, 0), ("park", 0, 0), ("task", 1, 0)]
    assert got["d"] == [("task", 0, 0), ("park", 0, 0), ("cancelled", 0, 0)]
    logged = workflow.replay(events, 3, 1).where("kind in ('park', 'cancelled')")
    assert workflow.suspended(logged).select("instance_id").collect() == [("c",)]


def test_handlers(spark):
    asks = frame(spark, [(1, "2"), (2, "x")], "id long, payload string")
    got = {r["id"]: (r["reply"], r["outcome"]) for r in workflow.handled(asks, lambda p: str(int(p) * 2), "id long").collect()}
    assert got == {1: ("4", "ack"), 2: (None, "nack")}
