"""Numbering that is written, and replies to repeated requests."""

from pyspark.sql import functions as F

from flowlark.operators import routing
from flowlark.sources import sinks


def test_numbered_rows_are_written_whole(spark, tmp_path):
    """Two million rows with a payload: ranges are sampled, so each row must be ranged once."""
    n = 2_000_000
    rows = spark.range(n).select(
        F.xxhash64("id").alias("deliver_at"), F.col("id").alias("offset"), F.concat(F.lit("payload-"), F.col("id").cast("string")).alias("payload")
    )
    path = str(tmp_path / "numbered")
    sinks.numbered(rows, 1000, "deliver_at", "offset").write.parquet(path)
    out = spark.read.parquet(path)
    got = out.agg(
        F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq"), F.countDistinct("offset"),
        F.sum((F.concat(F.lit("payload-"), F.col("offset").cast("string")) != F.col("payload")).cast("int")),
    ).first()
    assert tuple(got) == (n, n, 1000, 1000 + n - 1, n, 0)
    # in order: seq / place by key agree on a sample of neighbours
    some = out.where("seq % 1000 < 2").orderBy("seq").select("deliver_at").collect()
    keys = [r[0] for r in some]
    assert keys == sorted(keys)


def test_numbered_ties_nothing_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, i, "x", 9, 9) for i in range(50)], "deliver_at long, offset long, __at string, __part long, __start long")
    out = sinks.numbered(rows, 1, "deliver_at", "offset").orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(1, 51)) and [r["offset"] for r in out] == list(range(50))
    assert out[0]["__at"] == "x" and out[0]["__part"] == 9
    assert sinks.numbered(rows.where("offset < 0"), 1, "offset").count() == 0


def test_correlate_keeps_repeated_requests(spark):
    asks = spark.createDataFrame(
        [(1, 100, {"a": "b"}), (1, 100, {"a": "b"}), (1, 5000, None), (2, 100, None), (None, 100, None)],
        "correlation_id long, ts_ms long, headers map<string,string>",
    )
    replies = spark.createDataFrame(
        [(1, 150, "late"), (1, 120, "b"), (1, 120, "a"), (2, 99, "early"), (2, 501, "over"), (None, 101, "none")],
        "correlation_id long, ts_ms long, payload string",
    )
    got = sorted((str(r["correlation_id"]), r["ts_ms"], r["reply"], r["outcome"]) for r in routing.correlate(asks, replies, 400).collect())
    assert got == [
        ("1", 100, "a", "reply"), ("1", 100, "a", "reply"), ("1", 5000, None, "timeout"), ("2", 100, None, "timeout"), ("None", 100, None, "timeout"),
    ]
