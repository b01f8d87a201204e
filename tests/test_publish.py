"""Publishing as one operator, and quotas of a whole store, against folds in plain Python."""

import random

from flowlark.operators import credit, publish, retention

STREAMS = [("a", 5, 0, "new", 1000), ("b", 0, 60, "new", 0), ("c", 3, 0, "old", 2500), ("d", None, None, "new", None)]
SCHEMA = "name string, max_msgs long, max_bytes long, discard string, idempotency_window_ms long"


def test_publish(spark):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        stream, subject = rng.choice(["a", "b", "c", "d", "e"]), rng.choice(["x.y", "x.y", "x..y", "z"])
        rows.append((k, stream, subject, 300 * k, rng.choice(["", "i", "j", "k"]), "p" * rng.randint(0, 9)))
    table = spark.createDataFrame([(k, s, u, t, {"msg-id": i} if i else None, None, p) for k, s, u, t, i, p in rows], "seq long, stream string, subject string, ts_ms long, headers map<string,string>, reply_to string, payload string")
    streams = spark.createDataFrame(STREAMS, SCHEMA)
    limits = {n: (m, b, d, w) for n, m, b, d, w in STREAMS}
    windows = {"a": 1000, "b": 0, "c": 3000, "d": 0}
    want, last, n, held, number = {}, {}, 0, 0, 50
    for k, stream, subject, at, i, payload in rows:
        if subject == "x..y":
            want[k] = ("invalid", None)
        elif stream not in limits:
            want[k] = ("unknown_stream", None)
        elif i and windows[stream] and at - last.get((stream, i), -(10**9)) < windows[stream]:
            want[k] = ("duplicate", None)
        else:
            last[stream, i] = at
            most, size, discard, _ = limits[stream]
            if discard == "new" and (most and n >= most or size and held + len(payload) > size):
                want[k] = ("over_quota", None)
            else:
                n, held = n + 1, held + len(payload)
                want[k] = ("ok", number)
                number += 1
    got = {r["seq"]: (r["verdict"], r["stored_seq"]) for r in publish.publish(table, streams, 50).collect()}
    assert got == want and {v for v, _ in want.values()} == {"ok", "invalid", "unknown_stream", "duplicate", "over_quota"}


def test_quota_of_each_store(spark):
    rows = [(k, "a", 1, k % 2) for k in range(40)]
    out = retention.admitted(spark.createDataFrame(rows, "seq long, stream string, nbytes long, shard long"), spark.createDataFrame(STREAMS, SCHEMA), shard="shard")
    assert sorted(r["seq"] for r in out.where("accepted").collect()) == list(range(10))


def test_caps_beyond_the_plan(spark, monkeypatch):
    """Caps as a literal before the shuffle, and by ranges of seq beyond it, keep the same rows."""
    rows = [(c, f"s{k % 3}", k, m, lim) for c, m in ((1, 7), (2, 0), (3, None), (4, 900)) for k in range(60) for lim in [None if k % 3 == 0 else k % 3]]
    owed = spark.createDataFrame(rows, "consumer_id long, subject string, seq long, max_inflight long, limit long")
    found = []
    for cap in (1000, 0):
        monkeypatch.setattr(credit, "PLAN_CAP", cap)
        found.append(sorted((r["consumer_id"], r["seq"]) for r in credit.credit(owed).collect()))
    assert found[0] == found[1]
    assert [s for c, s in found[0] if c == 1] == [0, 1, 2, 3, 5, 6, 9] and len([s for c, s in found[0] if c == 2]) == 23
