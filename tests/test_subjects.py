"""Subjects, patterns and routing against a plain walk over tokens."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlark.functions import payload as P
from flowlark.functions import subjects as S
from flowlark.operators import routing

TRUTH = [
    ("orders.*", "orders.created", True), ("orders.*", "orders.a.b", False), ("orders.>", "orders", False),
    ("orders.>", "orders.a.b.c", True), ("orders.*.done", "orders.created.fail", False), ("orders.*.done", "orders.x.done", True),
    (">", "a", True), ("a", "a", True), ("a", "b", False), ("*", "a.b", False),
]
ODD = [("a", "a.", True), ("a", "a..", True), ("a", "a...", False), ("a.*", "a.", False), ("a.*", "a.b.", True), ("a.>", "a.", False), (">", ".a", False), (">", "a..b", True)]


def matches(pattern, subject):
    p, s = pattern.split("."), subject.split(".")
    for i, t in enumerate(p):
        if t == ">":
            return len(s) > i
        if i >= len(s) or t not in ("*", s[i]):
            return False
    return len(p) == len(s)


def patterns(rng, n):
    out = []
    for _ in range(n):
        t = [rng.choice(["a", "b", "c", "*"]) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            t[-1] = ">"
        out.append(".".join(t))
    return out


@pytest.mark.parametrize("pattern, subject, want", TRUTH + ODD)
def test_regex(pattern, subject, want):
    assert bool(re.match(S.pattern_regex(pattern), subject)) is want


def test_match_columns(spark):
    rng = random.Random(1)
    rows = [(p, ".".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))) for p in patterns(rng, 2000)]
    rows += [(p, s) for p, s, _ in TRUTH]
    found = spark.createDataFrame(rows, "p string, s string").select("p", "s", S.matches("p", "s").alias("m")).collect()
    assert all(r["m"] == matches(r["p"], r["s"]) for r in found)


def test_known_patterns(spark):
    subjects = [s for _, s, _ in TRUTH + ODD]
    df = spark.createDataFrame([(s,) for s in subjects], "subject string")
    for pattern in {p for p, _, _ in TRUTH + ODD}:
        got = Counter(r[0] for r in df.where(S.subject_matches("subject", pattern)).collect())
        assert got == Counter(s for s in subjects if re.match(S.pattern_regex(pattern), s)), pattern


def test_covers_and_overlaps(spark):
    """Against all subjects of up to five tokens of a small alphabet."""
    import itertools

    space = [".".join(t) for n in range(1, 6) for t in itertools.product("abx", repeat=n)]
    rng = random.Random(2)
    some = sorted(set(patterns(rng, 40)) - {"c"})
    some = [p for p in some if "c" not in p][:24]
    sets = {p: {s for s in space if matches(p, s)} for p in some}
    pairs = spark.createDataFrame([(a, b) for a in some for b in some], "a string, b string")
    for r in pairs.select("a", "b", S.covers("a", "b").alias("c"), S.overlaps("a", "b").alias("o"), S.strictly_nested("b", "a").alias("n")).collect():
        a, b = sets[r["a"]], sets[r["b"]]
        assert r["o"] == bool(a & b), r
        if r["c"]:
            assert b <= a, r
        elif b <= a:  # a star never covers an open end
            assert r["b"].endswith(">"), r
        assert r["n"] == (r["c"] and r["a"] != r["b"] and not (a <= b and r["c"] and sets[r["a"]] == b)), r


@pytest.mark.parametrize(
    "subject, error",
    [("a.b", None), ("a" * 255, None), ("a" * 256, "too_long"), ("", "empty"), (None, "empty"), ("a..b", "invalid_char"), (".a", "invalid_char"), ("a.", "invalid_char"), ("a*", "invalid_char"), ("a.>.b", "invalid_char"), ("a.>", None), ("*.b", None), ("a b", "invalid_char"), (">", None)],
)
def test_validation(spark, subject, error):
    row = spark.createDataFrame([(subject,)], "s string").select(S.subject_error("s"), S.valid_subject("s")).first()
    assert tuple(row) == (error, error is None)


def test_names_and_tokens(spark):
    row = spark.createDataFrame([("a.b.c", "x" * 256, "A_-9")], "s string, long string, n string").select(
        S.next_token("s"), S.rest("s"), S.rest(F.lit("a")), S.name_error("long"), S.name_error("n"), S.name_error("s"), S.slug(F.lit("4-NOT SPECIFIED")),
        S.service_method(F.lit("_svc.pay.m.charge.now"), "pay"), S.service_method(F.lit("_svc.other.m.x"), "pay"),
    ).first()
    assert tuple(row) == ("a", "b.c", "", "too_long", None, "invalid_char", "4-not-specified", "charge.now", None)


def test_payloads(spark):
    df = spark.range(1).select(
        F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("msg-id", "1"), ("x", "y"), ("msg-id", "2"))]).alias("h")
    )
    row = df.select(P.headers_of(F.col("h")).alias("m"), P.header(F.col("h"), "x").alias("x"), P.message_id(P.headers_of(F.col("h"))).alias("i")).first()
    assert row["m"] == {"msg-id": "1", "x": "y"} and row["x"] == "y" and row["i"] == "1"
    task = spark.range(1).select(P.decode_task(P.encode_task(F.lit("i"), F.lit(0x8003), F.lit(2), F.lit("{}"))).alias("t")).first()["t"]
    assert task.asDict() == {"instance_id": "i", "step": 3, "attempt": 2, "context": "{}", "is_compensation": True}
    parked = spark.range(1).select(P.decode_parked(P.encode_parked(F.lit(4), F.lit(99), F.lit("s"))).alias("p")).first()["p"]
    assert tuple(parked) == (4, 99, "s")
    assert spark.range(1).select(P.timestamp_ms(F.lit(1_234_567_890_123))).first()[0] == 1_234_567


@pytest.mark.parametrize(
    "context, patch, want",
    [('{"a":1,"b":{"c":1}}', '{"b":{"d":2}}', {"a": 1, "b": {"d": 2}}), ("", '{"a":1}', {"a": 1}), (None, "{}", {}), ("[1]", '{"a":1}', {"a": 1}), ('{"a":1}', "[2]", [2]), ('{"a":1}', "7", 7)],
)
def test_json_merge(spark, context, patch, want):
    import json

    df = spark.createDataFrame([(context, patch)], "c string, p string")
    assert json.loads(df.select(P.json_merge(F.col("c"), F.col("p"))).first()[0]) == want


# ---- routing


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    subs = [(i, rng.randint(1, 6), rng.randint(1, 3), rng.choice([None, "q1", "q2"]), "s", patterns(rng, rng.randint(0, 3))) for i in range(1, 15)]
    messages = [(k + 1, "s", ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))) for k in range(300)]
    s = spark.createDataFrame(subs, "subscription_id long, consumer_id long, connection_id long, queue string, stream string, filters array<string>")
    return subs, messages, s, spark.createDataFrame(messages, "seq long, stream string, subject string")


def owed(subs, subject):
    """Matches in order: exact, catch-all, pattern."""
    found = []
    for sub in subs:
        filters = sub[5] or [""]
        ranks = [(0 if f == subject and "*" not in f and ">" not in f else 1 if not f else 2) for f in filters if not f or matches(f, subject)]
        if ranks:
            found.append((min(ranks), sub[0], sub))
    return [x[2] for x in sorted(found, key=lambda x: x[:2])]


def test_match(world):
    subs, messages, s, m = world
    got = Counter((r["seq"], r["subscription_id"]) for r in routing.match(m, s).collect())
    assert got == Counter((k, x[0]) for k, _, subject in messages for x in owed(subs, subject))


def test_match_has_no_nested_loop(world, capsys):
    _, _, s, m = world
    routing.match(m, s).explain()
    assert "NestedLoop" not in capsys.readouterr().out


@pytest.mark.parametrize("busy", [(), (1, 3)])
def test_queue(world, busy):
    subs, messages, s, m = world
    want = Counter()
    for k, _, subject in messages:
        found, served = owed(subs, subject), set()
        for i in range(len(found)):
            x = found[(k % len(found) + i) % len(found)]
            if x[3] and x[3] not in served and x[1] not in busy:
                served.add(x[3])
                want[k, x[3], x[0]] += 1
    able = (lambda x: ~x["consumer_id"].isin(*busy)) if busy else None
    picks = routing.queue_picks(routing.recipients(m, s), able)
    assert Counter((r["seq"], r["queue"], r["subscription_id"]) for r in picks.collect()) == want


def test_wire_rows_and_siblings(world):
    subs, messages, s, m = world
    wire = routing.wire_rows(routing.fanout(m, s))
    assert Counter((r["seq"], r["connection_id"], r["consumer_id"]) for r in wire.collect()) == Counter(
        {(k, x[2], x[1]) for k, _, subject in messages for x in owed(subs, subject)}
    )
    deliveries = m.withColumn("consumer_id", F.lit(subs[0][1]).cast("long"))
    got = {(r["seq"], r["subscription_id"]) for r in routing.sibling_fanout(deliveries, s).collect()}
    assert got == {(k, x[0]) for k, _, subject in messages for x in owed(subs, subject) if x[1] == subs[0][1]}


def test_limits(spark):
    limits = spark.createDataFrame(
        [("s", "message.premium.>", 3, 1), ("s", "message.freemium.>", 1, 2), ("s", "message.*.x", 2, 3), ("s", "message.premium.x", 9, 4), ("s", "message.premium.x", 7, 5)],
        "stream string, pattern string, limit long, written long",
    )
    subjects = spark.createDataFrame([("s", x) for x in ("message.premium.a", "message.freemium.x", "message.premium.x", "other.x", "message.free.x")], "stream string, subject string")
    got = {r["subject"]: r["limit"] for r in routing.resolve_limits(subjects, limits).collect()}
    assert got == {"message.premium.a": 3, "message.freemium.x": 1, "message.premium.x": 7, "other.x": None, "message.free.x": 2}


def test_floors_and_suppression(spark):
    offers = spark.createDataFrame([(c, q) for c in (1, 2) for q in range(1, 11)], "consumer_id long, seq long")
    floors = spark.createDataFrame([(1, 4)], "consumer_id long, floor long")
    done = spark.createDataFrame([(1, 6), (2, 1)], "consumer_id long, seq long")
    got = Counter(r["consumer_id"] for r in routing.unsuppressed(offers, floors, done).collect())
    assert got == {1: 5, 2: 9}


def test_replies(spark):
    asks = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "correlation_id long, ts_ms long")
    replies = spark.createDataFrame([(1, 150, "late"), (1, 120, "first"), (2, 400, "too late"), (2, 50, "early")], "correlation_id long, ts_ms long, payload string")
    got = {r["correlation_id"]: (r["reply"], r["outcome"]) for r in routing.correlate(asks, replies, 100).collect()}
    assert got == {1: ("first", "reply"), 2: (None, "timeout"), 3: (None, "timeout")}


def test_acks_meet_pendings(spark):
    pend = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (2, 6, 12)], "consumer_id long, seq long, binding_id long")
    acks = spark.createDataFrame([(1, 5, 11), (2, 6, None), (2, 7, None), (1, 5, 99)], "consumer_id long, seq long, binding_id long")
    assert {tuple(r[c] for c in ("consumer_id", "seq", "binding_id")) for r in routing.acked_pendings(acks, pend).collect()} == {(1, 5, 11), (2, 6, 12)}
    late = routing.late_releases(pend, spark.createDataFrame([(10,), (12,)], "binding_id long"))
    assert [r["binding_id"] for r in late.collect()] == [11]
