"""Delayed release, timers and cron schedules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_CRON_TIMEOUT_MS
from ..sources.sinks import numbered


def matured(delayed: DataFrame, now_ms: int, next_seq: int) -> DataFrame:
    """Entries that are due, numbered in the order (deliver_at, offset)."""
    return numbered(delayed.where(F.col("deliver_at") <= now_ms), next_seq, "deliver_at", "offset")


def pending(delayed: DataFrame, now_ms: int) -> DataFrame:
    """Entries that are not due."""
    return delayed.where(F.col("deliver_at") > now_ms)


def next_deadline(delayed: DataFrame, now_ms: int) -> DataFrame:
    """``wait_ms`` until the next entry is due; null without one."""
    return pending(delayed, now_ms).agg((F.min("deliver_at") - now_ms).alias("wait_ms"))


def fired(timers: DataFrame, tick_ms: int) -> DataFrame:
    """Timers with ``fire_ms``: the end of the tick that holds their deadline, never before it."""
    return timers.withColumn("fire_ms", (F.ceil(F.col("expire_at_ms") / F.lit(tick_ms)) * tick_ms).cast("long"))


def due_between(timers: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Timers that one advance of the clock fires, each once."""
    return timers.where((F.col("expire_at_ms") > from_ms) & (F.col("expire_at_ms") <= to_ms))


# ---- cron


def with_workers(requests: DataFrame) -> DataFrame:
    """Schedules of ``name, expr, tz, timeout_ms, worker, position, deleted``: a name that is there gains a worker."""
    last = requests.groupBy("name", "worker").agg(F.max_by(F.struct("deleted", "position"), "position").alias("l"), F.min("position").alias("first"))
    live = last.where(~F.col("l.deleted")).groupBy("name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first", "worker"))), lambda x: x["worker"]).alias("workers")
    )
    head = requests.where(~F.col("deleted")).groupBy("name").agg(
        *[F.min_by(c, "position").alias(c) for c in ("expr", "tz", "timeout_ms")]
    )
    timeout = F.when(F.coalesce("timeout_ms", F.lit(0)) == 0, DEFAULT_CRON_TIMEOUT_MS).otherwise(F.col("timeout_ms"))
    return head.join(live, "name").withColumn("timeout_ms", timeout)


_NAMES = {
    "month": {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)},
    "day": {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())},
}
_ALIASES = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}


def cron_field(text: str, low: int, high: int, names: dict[str, int] | None = None) -> list[int]:
    """The numbers that one field of a cron expression stands for."""
    number = lambda x: (names or {}).get(x.lower()[:3], None) if not x.isdigit() else int(x)
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = (number(x) for x in span.split("-"))
        else:
            a = number(span)
            b = high if step else a
        if a is None or b is None or not low <= a <= b <= high or step == "0":
            raise ValueError(f"{text!r} is no field of a cron expression")
        out.update(range(a, b + 1, int(step or 1)))
    return sorted(out)


def cron_parts(expr: str) -> dict[str, list[int]]:
    """The fields of an expression of five parts, or of six with seconds first."""
    parts = _ALIASES.get(expr.strip(), expr).split()
    if len(parts) == 5:
        parts = ["0", *parts]
    if len(parts) != 6:
        raise ValueError(f"{expr!r} is no cron expression")
    second, minute, hour, day, month, weekday = parts
    days = cron_field(weekday, 0, 7, _NAMES["day"])
    return {
        "second": cron_field(second, 0, 59), "minute": cron_field(minute, 0, 59), "hour": cron_field(hour, 0, 23),
        "day": cron_field(day, 1, 31), "month": cron_field(month, 1, 12, _NAMES["month"]),
        "weekday": sorted({d % 7 for d in days}),
        "either": day not in ("*", "?") and weekday not in ("*", "?"),
    }


def cron_fires(spark: SparkSession, name: str, expr: str, start: str, end: str, tz: str = "UTC") -> DataFrame:
    """``name, fire, fire_ts`` of a schedule from ``start`` up to, not including, ``end`` (both UTC).

    Days, then hours and so on are generated and filtered by field, so a year
    of a daily job is 366 rows and not its seconds.  Fields are read in the
    schedule's time zone; where both day fields are set, either suffices.
    """
    c = cron_parts(expr)
    local = lambda t: F.from_utc_timestamp(F.lit(t).cast("timestamp"), tz)
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(local(start)), F.date_add(F.to_date(local(end)), 1))).alias("d")
    )
    by_day, by_weekday = F.dayofmonth("d").isin(c["day"]), (F.dayofweek("d") - 1).isin(c["weekday"])
    days = days.where(F.month("d").isin(c["month"]) & ((by_day | by_weekday) if c["either"] else (by_day & by_weekday)))
    numbers = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    times = (
        days.select("d", numbers(c["hour"]).alias("h")).select("*", numbers(c["minute"]).alias("m")).select("*", numbers(c["second"]).alias("s"))
    )
    wall = F.timestamp_seconds(F.unix_timestamp(F.col("d").cast("timestamp")) + F.col("h") * 3600 + F.col("m") * 60 + F.col("s"))
    fires = times.select(F.to_utc_timestamp(wall, tz).alias("fire_ts")).where(
        (F.col("fire_ts") >= F.lit(start).cast("timestamp")) & (F.col("fire_ts") < F.lit(end).cast("timestamp"))
    )
    # one schedule's fires: a small table
    return fires.distinct().select(
        F.lit(name).alias("name"), F.row_number().over(Window.orderBy("fire_ts")).cast("long").alias("fire"), "fire_ts"
    )


def round_robin(fires: DataFrame, workers: Column) -> DataFrame:
    """Fires with the ``worker`` whose turn it is."""
    return fires.withColumn("worker", F.get(workers, F.pmod(F.col("fire") - 1, F.size(workers)).cast("int")))


def cron_runs(fires: DataFrame) -> DataFrame:
    """Due fires with ``fired`` and ``worker``: none while the last one runs, unless overlap is allowed.

    Input is ``name, due_ms, took_ms`` (null: never ended), ``timeout_ms,
    overlap, workers``.  A run that exceeds its timeout is taken as ended.  It
    is a fold over the fires of one schedule.
    """
    schema = "name string, due_ms long, fired boolean, worker string, fire_count long"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, busy_until, count = [], -1, 0
        for r in rows.sort_values("due_ms").itertuples():
            fires = bool(r.overlap) or r.due_ms >= busy_until
            worker = None
            if fires and len(r.workers):
                worker = r.workers[count % len(r.workers)]
                count += 1
                limit = r.timeout_ms or DEFAULT_CRON_TIMEOUT_MS
                busy_until = r.due_ms + (limit if pd.isna(r.took_ms) else min(r.took_ms, limit))
            out.append((r.name, r.due_ms, fires and worker is not None, worker, count))
        return pd.DataFrame(out, columns=["name", "due_ms", "fired", "worker", "fire_count"])

    return fires.groupBy("name").applyInPandas(run, schema)


def timed_out(running: DataFrame, now_ms: int) -> DataFrame:
    """Runs that exceeded their timeout."""
    limit = F.when(F.coalesce("timeout_ms", F.lit(0)) == 0, DEFAULT_CRON_TIMEOUT_MS).otherwise(F.col("timeout_ms"))
    return running.where(F.col("running_since_ms") + limit < now_ms)


def idle(connections: DataFrame, now_ms: int, idle_ms: int) -> DataFrame:
    """Connections without any sign for too long."""
    return connections.groupBy("connection_id").agg(F.max("seen_ms").alias("seen_ms")).where(F.col("seen_ms") + idle_ms <= now_ms)


def needs_ping(connections: DataFrame, now_ms: int, every_ms: int) -> DataFrame:
    """Connections that are due a keepalive."""
    return connections.groupBy("connection_id").agg(F.max("seen_ms").alias("seen_ms")).where(F.col("seen_ms") + every_ms <= now_ms)
