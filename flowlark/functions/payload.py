"""Headers, replies, task records and JSON contexts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HAS_HEADERS, HAS_REPLY_TO, MSG_ID

_TASK = "struct<instance_id:string,step:int,attempt:int,context:string>"
#: In a task's step, tells a compensation.
COMPENSATION_BIT = 0x8000


def headers_of(pairs: Column) -> Column:
    """A map of (key, value) pairs in which the first of equal keys wins."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    first = lambda k: F.get(F.filter(pairs, lambda p: p["key"] == k), 0)["value"]
    return F.map_from_arrays(keys, F.transform(keys, first))


def header(pairs: Column, key: str) -> Column:
    """The first value of a key, by a scan of the pairs; null without one."""
    return F.get(F.filter(pairs, lambda p: p["key"] == key), 0)["value"]


def message_id(headers: Column) -> Column:
    """The id that dedup uses; an empty id is none."""
    return F.nullif(F.element_at(headers, MSG_ID), F.lit(""))


def message_flags(headers: Column, reply_to: Column) -> Column:
    """The flags that follow from what a message carries."""
    h = F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, HAS_HEADERS).otherwise(0)
    return h.bitwiseOR(F.when(reply_to.isNotNull(), HAS_REPLY_TO).otherwise(0)).cast("int")


def delivered_payload(message: Column) -> Column:
    """What a consumer sees of a message: payload and reply address, without the headers."""
    return F.struct(message["payload"].alias("payload"), message["reply_to"].alias("reply_to"))


def encode_task(instance_id: Column, step: Column, attempt: Column, context: Column) -> Column:
    """A workflow task as one string."""
    return F.to_json(
        F.struct(
            instance_id.alias("instance_id"), step.cast("int").alias("step"), attempt.cast("int").alias("attempt"),
            context.alias("context"),
        ),
        {"ignoreNullFields": "false"},
    )


def decode_task(task: Column) -> Column:
    """The parts of a task, with ``is_compensation`` and the bare step."""
    t = F.from_json(task, _TASK)
    return F.struct(
        t["instance_id"].alias("instance_id"),
        t["step"].bitwiseAND(COMPENSATION_BIT - 1).alias("step"),
        t["attempt"].alias("attempt"),
        t["context"].alias("context"),
        (t["step"].bitwiseAND(COMPENSATION_BIT) != 0).alias("is_compensation"),
    )


def encode_parked(step: Column, deadline_ms: Column, state: Column) -> Column:
    """A suspended instance as one string."""
    return F.to_json(F.struct(step.cast("int").alias("step"), deadline_ms.alias("deadline_ms"), state.alias("state")))


def decode_parked(parked: Column) -> Column:
    return F.from_json(parked, "struct<step:int,deadline_ms:long,state:string>")


def json_field(context: Column, path: str, default: str | None = None) -> Column:
    """A member of a JSON context; an empty context has the default."""
    found = F.get_json_object(context, path)
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(default)).otherwise(found)


def json_merge(context: Column, patch: Column) -> Column:
    """A shallow merge: members of the patch replace those of the context.

    Members keep their JSON as variants.  Where either is no object the patch
    replaces the context; an empty context is an empty object.
    """
    base = F.when(F.coalesce(context, F.lit("")) == "", "{}").otherwise(context)
    both = F.trim(base).startswith("{") & F.trim(patch).startswith("{")
    # parsed only where both are objects, so others never fail
    a = F.from_json(F.when(both, base), "map<string,variant>")
    b = F.from_json(F.when(both, patch), "map<string,variant>")
    rest = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.when(both, F.to_json(F.map_concat(rest, b))).otherwise(patch)


def json_replace(value: Column) -> Column:
    """A struct or map as the whole context."""
    return F.to_json(value)


def timestamp_ms(ns: Column) -> Column:
    """Whole milliseconds of nanoseconds."""
    return ((ns - F.pmod(ns, F.lit(1_000_000))).cast("decimal(20,0)") / 1_000_000).cast("long")


def routing_hash(c: Column) -> Column:
    """Spreads names over partitions; never an identity, and never compared with other systems' hashes."""
    return F.xxhash64(c)
