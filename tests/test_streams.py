"""Streaming forms, run to the end of small file streams."""

import time

import pytest
from pyspark.sql import functions as F

from flowlark.operators import workflow
from flowlark.streaming import flows, stateful


@pytest.fixture(scope="module")
def store(spark):
    old = spark.conf.get(stateful.STORE_KEY, None)
    spark.conf.set(stateful.STORE_KEY, stateful.STORE)
    yield spark
    spark.conf.set(stateful.STORE_KEY, old) if old else spark.conf.unset(stateful.STORE_KEY)


def stream(spark, tmp_path, batches, schema):
    """Batches as files of a stream that is read a file at a time."""
    path = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, tmp_path, name, mode="append", until=None):
    """The rows that come out; a stream with timers never rests, so it runs until it has so many rows."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        if until is None:
            q.processAllAvailable()
        end = time.time() + 60
        while until is not None and time.time() < end and df.sparkSession.table(name).count() < until:
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


LOG = "seq long, stream string, subject string, ts_ms long, msg_id string, payload string"


def test_dedup(spark, tmp_path):
    rows = [[(1, "s", "a", 0, "x", ""), (2, "s", "a", 10, "x", ""), (3, "s", "a", 10, "", "")], [(4, "s", "a", 20, "x", ""), (5, "s", "a", 30, "", ""), (6, "t", "a", 30, "x", "")]]
    found = run(flows.dedup(stream(spark, tmp_path, rows, LOG), 60_000), tmp_path, "dedup")
    # of equal ids in one batch any may pass
    assert sorted(r["seq"] for r in found) in ([1, 3, 5, 6], [2, 3, 5, 6])


def test_routed_and_counts(spark, tmp_path):
    subs = spark.createDataFrame([(1, 1, "s", ["a.*"]), (2, 2, "s", [])], "subscription_id long, consumer_id long, stream string, filters array<string>")
    rows = [[(1, "s", "a.b", 0, "", ""), (2, "s", "c", 0, "", ""), (3, "t", "a.b", 0, "", "")]]
    source = stream(spark, tmp_path, rows, LOG)
    found = run(flows.routed(source, subs), tmp_path, "routed")
    assert sorted((r["seq"], r["subscription_id"]) for r in found) == [(1, 1), (1, 2), (2, 2)]
    counts = run(flows.windowed_counts(source, ["stream"]), tmp_path / "w", "counted", "update")
    assert {r["stream"]: r["n"] for r in counts} == {"s": 2, "t": 1}


def test_append_and_deliver(spark, tmp_path):
    rows = [[(1, "s", "a", 0, "", "p")], [(2, "s", "b", 0, "", "q")]]
    source = stream(spark, tmp_path, rows, LOG)
    flows.append_sink(source, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("crc is not null").count() == 2
    got = []
    flows.deliver(source, lambda df, k: got.extend(r["seq"] for r in df.collect()), str(tmp_path / "c2")).awaitTermination()
    assert sorted(got) == [1, 2]


def test_first_sight(store, tmp_path):
    batches = [[("s", "x", 1, 0), ("s", "x", 2, 50), ("s", "", 3, 50)], [("s", "x", 4, 99), ("s", "x", 5, 100), ("s", "", 6, 100)]]
    found = run(stateful.first_sight(stream(store, tmp_path, batches, "stream string, msg_id string, seq long, ts_ms long"), 100), tmp_path, "seen")
    assert sorted(r["seq"] for r in found) == [1, 3, 5, 6]


def test_ack_timeouts(store, tmp_path):
    now = int(time.time() * 1000)
    schema = "consumer_id long, seq long, kind string, at_ms long, wait_ms long, delay_ms long"
    rows = [[(1, 1, "delivered", now, 10, None), (1, 2, "delivered", now, 10**8, None), (1, 3, "delivered", now, 10**8, None), (1, 4, "delivered", now, 10**8, None)], [(1, 2, "ack", now, None, None), (1, 3, "nack", now, None, 0)]]
    found = run(stateful.ack_timeouts(stream(store, tmp_path, rows, schema)), tmp_path, "late", until=2)
    got = {(r["seq"], r["reason"]) for r in found}
    assert got == {(1, "timeout"), (3, "nack")}
    assert all(r["at_ms"] >= now + 10 for r in found if r["reason"] == "timeout")


def test_delayed_release(store, tmp_path):
    now = int(time.time() * 1000)
    rows = [[("s", 1, now - 5, "b"), ("s", 2, now - 9, "a"), ("s", 3, now + 10**9, "z")]]
    found = run(stateful.delayed_release(stream(store, tmp_path, rows, "stream string, offset long, deliver_at long, payload string")), tmp_path, "due", until=2)
    assert [r["payload"] for r in found] == ["a", "b"]


def test_credit(store, tmp_path):
    schema = "consumer_id long, seq long, kind string, subject string, limit long, max_inflight long, at_ms long"
    rows = [[(1, k, "offer", "a" if k < 4 else "b", 2, 3, k) for k in range(1, 7)], [(1, 1, "ack", None, None, None, 10), (1, 2, "nack", None, None, None, 20)]]
    found = run(stateful.credit(stream(store, tmp_path, rows, schema)), tmp_path, "sent")
    assert [(r["seq"], r["at_ms"]) for r in found] == [(1, 1), (2, 2), (4, 4), (3, 10), (2, 20)]


def test_workflow(store, tmp_path):
    batches = [[("a", 0, "trigger", 0, 0, "{}")], [("a", 1, "ok", 0, 0, "{}"), ("a", 2, "suspend", 1, 0, "{}")], [("a", 3, "resume", 0, 0, "{}"), ("a", 4, "resume", 0, 0, "{}")]]
    found = run(stateful.workflow(stream(store, tmp_path, batches, workflow.EVENTS), 3), tmp_path, "acted")
    assert [(r["kind"], r["step"]) for r in sorted(found, key=lambda r: r["position"])] == [("task", 0), ("task", 1), ("park", 1), ("task", 2)]


def test_stalled(store, tmp_path):
    now = int(time.time() * 1000)
    rows = [[(1, now - 10_000)], [(2, now + 10**8)]]
    found = run(stateful.stalled_connections(stream(store, tmp_path, rows, "connection_id long, at_ms long"), 500), tmp_path, "stalled", until=1)
    assert [r["connection_id"] for r in found] == [1]


def test_correlated(spark, tmp_path):
    schema = "correlation_id long, ts_ms long, payload string"
    asks = stream(spark, tmp_path / "a", [[(1, 1000, "q"), (2, 1000, "q")]], schema)
    replies = stream(spark, tmp_path / "b", [[(1, 1500, "r"), (2, 9000, "r")]], schema)
    found = run(flows.correlated(asks, replies, 1000), tmp_path, "answered")
    assert [(r["correlation_id"], r["reply"]) for r in found] == [(1, "r")]
