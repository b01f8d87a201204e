"""Keyed workflows: steps in turn, retries, suspension, compensation.

:class:`Instance` is the state machine of one instance.  A table of events is
replayed by :func:`replay`; ``streaming.workflow`` runs the same machine over a
stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import COMPENSATION_BIT

#: kind: task (work to hand out), park, done, dead (dead letter), compensate, cancelled.
ACTIONS = "instance_id string, position long, kind string, step int, attempt int, message_id string, context string"
#: Kinds of events: trigger, ok, error, suspend, resume, timeout, cancel, compensated.
EVENTS = "instance_id string, position long, kind string, step int, attempt int, context string"


def task_id(instance: str, step: int, attempt: int) -> str:
    """The id that makes handing out a task idempotent."""
    return f"wf:{instance}:{step}:{attempt}"


@dataclass
class Instance:
    """One instance's state."""

    instance: str
    steps: int
    max_retries: int = 3
    compensated: tuple[int, ...] | None = None  # steps that have a compensation; None: all
    parked: int | None = None
    seen: set[str] = field(default_factory=set)
    finished: bool = False

    def _task(self, step: int, attempt: int, context: str | None) -> list[tuple]:
        mid = task_id(self.instance, step, attempt)
        if mid in self.seen:
            return []
        self.seen.add(mid)
        return [("task", step, attempt, mid, context)]

    def on(self, kind: str, step: int, attempt: int, context: str | None) -> list[tuple]:
        """What follows from an event, as (kind, step, attempt, message id, context)."""
        if kind == "trigger":
            return self._task(0, 0, context)
        if self.finished:
            return []
        if kind == "cancel":
            if self.parked is None:
                return []
            step, self.parked, self.finished = self.parked, None, True
            return [("cancelled", step, 0, None, context)]
        if kind in ("resume", "timeout"):
            if self.parked is None or (kind == "timeout" and self.parked != step):
                return []
            step, self.parked = self.parked, None
            return self._after(step, context)
        if kind == "suspend":
            self.parked = step
            return [("park", step, attempt, f"wf:{self.instance}:park:{step}", context)]
        if kind == "ok":
            return self._after(step, context)
        if kind == "error":
            return self._failed(step, attempt, context)
        return []

    def _after(self, step: int, context: str | None) -> list[tuple]:
        if step + 1 < self.steps:
            return self._task(step + 1, 0, context)
        self.finished = True
        return [("done", step, 0, None, context)]

    def _failed(self, step: int, attempt: int, context: str | None) -> list[tuple]:
        if attempt < self.max_retries:
            return self._task(step, attempt + 1, context)
        self.finished = True
        back = [s for s in range(step - 1, -1, -1) if self.compensated is None or s in self.compensated]
        return [("dead", step, attempt, f"wf:{self.instance}:dlq:{step}", context)] + [
            ("compensate", COMPENSATION_BIT | s, 0, f"wf:{self.instance}:comp:{s}", context) for s in back
        ]


def replay(events: DataFrame, steps: int, max_retries: int = 3, compensated: tuple[int, ...] | None = None) -> DataFrame:
    """The actions that a table of events leads to; each instance by itself, in the order of ``position``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, out = Instance(key[0], steps, max_retries, compensated), []
        for r in rows.sort_values("position").itertuples():
            step = 0 if pd.isna(r.step) else int(r.step)
            attempt = 0 if pd.isna(r.attempt) else int(r.attempt)
            out += [(key[0], r.position, *a) for a in one.on(r.kind, step, attempt, r.context)]
        return pd.DataFrame(out, columns=["instance_id", "position", "kind", "step", "attempt", "message_id", "context"])

    return events.groupBy("instance_id").applyInPandas(run, ACTIONS)


def triggers(source: DataFrame, instance_id: str, context: str) -> DataFrame:
    """Rows of another stream as triggers; an instance that is there is not started twice."""
    return source.groupBy(F.col(instance_id).cast("string").alias("instance_id")).agg(
        F.min("seq").alias("position"), F.min_by(context, "seq").alias("context")
    ).select(
        "instance_id", "position", F.lit("trigger").alias("kind"), F.lit(0).alias("step"), F.lit(0).alias("attempt"), "context"
    )


def linear_progress(steps_done: DataFrame, steps: int) -> DataFrame:
    """``instance_id, next_step, state`` from the steps that each instance has behind it, without a fold.

    Where steps only succeed, an instance stands behind its unbroken run of
    steps from 0.
    """
    done = steps_done.select("instance_id", "step").distinct()
    after = done.select("instance_id", (F.col("step") - 1).alias("step"))
    start = done.select("instance_id").distinct().withColumn("step", F.lit(-1))
    ends = start.unionByName(done).join(after, ["instance_id", "step"], "left_anti")
    at = ends.groupBy("instance_id").agg((F.min("step") + 1).alias("next_step"))
    return at.withColumn("state", F.when(F.col("next_step") >= steps, "done").otherwise("running"))


def suspended(states: DataFrame) -> DataFrame:
    """Instances that are parked, from the log of park and remove events."""
    last = states.groupBy("instance_id").agg(F.max_by(F.struct("kind", "step", "context"), "position").alias("l"))
    return last.where(F.col("l.kind") == "park").select("instance_id", "l.step", "l.context")


def handled(requests: DataFrame, handler: object, schema: str) -> DataFrame:
    """Requests answered by a Python function from payload to payload, an Arrow batch at a time.

    The function's error becomes a nack, its value a reply and an ack.
    ``schema`` names the columns of the requests that are kept.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(parts):
        for part in parts:
            replies, errors = [], []
            for payload in part["payload"]:
                try:
                    replies.append(handler(payload))
                    errors.append(None)
                except Exception as e:  # whatever a handler raises is its answer
                    replies.append(None)
                    errors.append(str(e))
            out = part[names].copy()
            out["reply"], out["error"] = pd.Series(replies, index=part.index, dtype=object), pd.Series(errors, index=part.index, dtype=object)
            out["outcome"] = ["ack" if e is None else "nack" for e in errors]
            yield out

    return requests.mapInPandas(run, f"{schema}, reply string, error string, outcome string")
