"""Schemas, flags and limits.

All tables are declared, never inferred.  Names, not hashes, are keys.
"""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()), "array<string>": T.ArrayType(T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """A schema from "name kind, ..."; needs no session, so workers may import this module."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(", "))])


MESSAGES = _schema(
    "seq long, stream string, subject string, ts_ms long, headers map<string,string>, msg_id string, "
    "reply_to string, payload string, nbytes long, flags int"
)
STREAMS = _schema(
    "name string, filter string, max_msgs long, max_bytes long, max_age_ms long, discard string, "
    "retention string, idempotency_window_ms long, created_at_seq long"
)
CONSUMERS = _schema(
    "consumer_id long, stream string, name string, group_name string, filter string, mode string, ack_policy string, "
    "deliver_policy string, start_seq long, max_inflight long, ack_wait_ms long, paused boolean"
)
SUBSCRIPTIONS = _schema(
    "subscription_id long, consumer_id long, stream string, connection_id long, filters array<string>"
)
LIMITS = _schema("stream string, pattern string, limit long, written long")
DELIVERIES = _schema("seq long, consumer_id long, subscription_id long, attempt int, delivered_ms long")
ACKS = _schema("consumer_id long, seq long, kind string, acked_ms long, delay_ms long")

# Message flags.
TOMBSTONE = 1
HAS_REPLY_TO = 8
HAS_HEADERS = 16

# Limits of the data model.
MAX_NAME = 255
MAX_SUBJECT = 255
MAX_STREAMS = 4096
MAX_PER_CONNECTION = 1000
MAX_BATCH_SUBSCRIPTIONS = 1024
MAX_BATCH_ACKS = 1000
MAX_CRONS = 10_000
MAX_CRON_WORKERS = 1000
MAX_DELAY_MS = 7 * 24 * 3600 * 1000
MAX_DELAYED = 100_000
MAX_DEDUP_WINDOW_MS = 300_000
DEFAULT_CRON_TIMEOUT_MS = 3_600_000
DEFAULT_FEED = 256
MSG_ID = "msg-id"
