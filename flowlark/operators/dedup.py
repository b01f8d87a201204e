"""De-duplication by message id within a window that does not slide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MAX_DEDUP_WINDOW_MS


def effective_window(window_ms: int) -> int:
    """Rounded up to whole seconds, at most five minutes."""
    return min(-(-window_ms // 1000) * 1000, MAX_DEDUP_WINDOW_MS)


def first_sight(rows: DataFrame, key: list[str], window_ms: int, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """Rows with ``accepted``: the first of an id, and then the first at least a window after the last accepted.

    A duplicate does not extend the window, so this is a fold and no ``lag``.
    A gap of a whole window before a row always accepts it: rows between two
    such gaps are an island, and islands fold independently.  They are dealt out
    by (key, island), so an id that holds a third of all rows is many islands
    wherever it ever pauses; within a task rows stream by in order and nothing
    but the last accepted time is held.  An empty id is never a duplicate.
    """
    w = Window.partitionBy(*key).orderBy(ts, order)
    gap = F.col(ts) - F.lag(ts).over(w)
    marked = rows.withColumn("__new", F.when(gap < window_ms, 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blank = F.lit(False)
    for k in key:
        blank |= F.col(k).isNull() | (F.col(k).cast("string") == "")
    dealt = marked.withColumn("__blank", blank).repartition(*key, "__island").sortWithinPartitions(*key, "__island", ts, order)
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_time = None, 0
        for part in parts:
            keys = list(zip(*[part[k] for k in key], part["__island"], strict=True))
            times, blanks = part[ts].to_numpy(), part["__blank"].to_numpy()
            out = np.zeros(len(part), dtype=bool)
            for i, k in enumerate(keys):
                if blanks[i] or k != last_key or times[i] >= last_time + window_ms:
                    out[i] = True
                    last_key, last_time = k, times[i]
            yield part.drop(columns=["__new", "__island", "__blank"]).assign(accepted=out)

    return dealt.mapInPandas(run, schema)


def seen_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is on record; the whole id is compared."""
    return rows.join(ids, [c for c in ids.columns if c in ("stream", "msg_id")], "left_semi")


def forgotten(ids: DataFrame, batch: DataFrame) -> DataFrame:
    """The record without the ids of a batch that is taken back."""
    key = ["stream", "msg_id"]
    return ids.join(batch.select(*key), key, "left_anti")


def accepted_batches(batches: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Batches with ``accepted``: one duplicate, also of its own, refuses a whole batch; empty ids are none."""
    named = batches.where(F.coalesce("msg_id", F.lit("")) != "")
    twice = named.groupBy("batch_id", "stream", "msg_id").agg(F.count("*").alias("n")).where("n > 1").select("batch_id")
    bad = twice
    if seen is not None:
        bad = bad.union(named.join(seen, ["stream", "msg_id"], "left_semi").select("batch_id"))
    bad = bad.distinct().withColumn("__bad", F.lit(True))
    return batches.join(bad, "batch_id", "left").withColumn("accepted", F.col("__bad").isNull()).drop("__bad")
