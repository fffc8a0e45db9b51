"""State transitions of queues, leases, publications and chats (Q1-Q17, W9, W11, M2, A5, A6). `now` is always a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import backoff


def due(tasks: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """Q1: tasks that may be claimed: waiting and due, or running with a lease that has run out; oldest first."""
    waiting = F.col("status").isin("PENDING", "RETRY_WAIT") & (F.col("next_run_at") <= now)
    lost = (F.col("status") == "RUNNING") & (F.col("lease_until") < now)
    return tasks.where((waiting | lost) & (F.col("attempts") < F.col("max_attempts"))).orderBy("next_run_at", "task_id").limit(limit)


def expired(tasks: DataFrame, now: Column) -> DataFrame:
    """Q2, Q4, Q7: what becomes of running tasks whose lease has run out: FAILED without attempts left, else RETRY_WAIT."""
    lost = (F.col("status") == "RUNNING") & (F.col("lease_until") < now)
    status = F.when(lost & (F.col("attempts") >= F.col("max_attempts")), "FAILED").when(lost, "RETRY_WAIT").otherwise(F.col("status"))
    return tasks.withColumn("new_status", status).withColumn("delay", F.when(status == "RETRY_WAIT", backoff(F.col("attempts"))))


def heartbeat(tasks: DataFrame, beats: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Q3: a beat extends a lease only with the right owner and epoch before it runs out; progress never falls."""
    b = beats.groupBy("task_id", "owner", "epoch").agg(F.max("progress").alias("_p"))
    j = tasks.join(b, ["task_id", "owner", "epoch"], "left")
    ok = F.col("_p").isNotNull() & (F.col("lease_until") >= now)
    return j.withColumn("lease_until", F.when(ok, now + F.make_dt_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_until"))).withColumn("progress", F.when(ok, F.greatest("progress", "_p")).otherwise(F.col("progress"))).drop("_p")


def first_by_key(rows: DataFrame, key: list[str], order: list[str], digest: str) -> DataFrame:
    """Q8: the first request of each idempotency key, with how many replays and conflicting digests follow it."""
    w = Window.partitionBy(*key).orderBy(*order)
    r = rows.withColumn("_n", F.row_number().over(w)).withColumn("_d", F.first(digest).over(w))
    return r.groupBy(*key).agg(F.min_by(order[-1], "_n").alias("first_id"), F.count_if((F.col("_n") > 1) & (F.col(digest) == F.col("_d"))).alias("replays"), F.count_if(F.col(digest) != F.col("_d")).alias("conflicts"))


def checkpoint_gaps(steps: DataFrame, key: str, number: str) -> DataFrame:
    """Q6: cursors that did not advance by one."""
    before = F.lag(number).over(Window.partitionBy(key).orderBy(number))
    return steps.withColumn("_b", before).where(F.col(number) != F.coalesce(F.col("_b") + 1, F.lit(0))).drop("_b")


def contiguous(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Whether each key's numbers are 0 to n - 1, each once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), ((F.min(number) == 0) & (F.max(number) == F.count(F.lit(1)) - 1) & (F.countDistinct(number) == F.count(F.lit(1)))).alias("contiguous"))


def at_most_one(rows: DataFrame, key: str, active: Column, name: str) -> DataFrame:
    """Q17: whether each key has one active row at most."""
    return rows.groupBy(key).agg((F.count_if(active) <= 1).alias(name))


def superseded(revisions: DataFrame) -> DataFrame:
    """Q10: all but the newest revision of a document give way."""
    newest = F.max("revision_no").over(Window.partitionBy("document_id"))
    return revisions.withColumn("new_status", F.when(F.col("revision_no") < newest, "SUPERSEDED").otherwise(F.col("status")))


def requeued(tasks: DataFrame, active: DataFrame, more: int) -> DataFrame:
    """Q16: failed tasks of generations that are still active, with attempts left below 100."""
    t = tasks.where("status = 'FAILED' and attempts < 100").join(active, "generation_id", "left_semi")
    return t.withColumn("status", F.lit("PENDING")).withColumn("max_attempts", F.least(F.lit(100), F.col("attempts") + more))


def history_tail(messages: DataFrame, turns: int = 6) -> DataFrame:
    """The last turns of each session, and none from before an unreadable one."""
    w = Window.partitionBy("session_id").orderBy(F.col("sequence_no").desc())
    m = messages.withColumn("_bad", F.sum(F.when(F.col("readable"), 0).otherwise(1)).over(w)).withColumn("_n", F.row_number().over(w))
    return m.where((F.col("_bad") == 0) & (F.col("_n") <= turns)).drop("_bad", "_n")


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Q14: (key, event_id, allowed): a window opens at a key's first event and lasts `seconds`; beyond `limit` events in it
    are refused. Each window's start depends on the one before, so keys are walked in Arrow batches, in time order, with
    constant state: a hot key needs one task but no memory."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, n = None, None, 0
        for part in parts:
            allowed = []
            for k, t in zip(part["key"], part["at"]):
                if k != key or (t - start) >= seconds:
                    key, start, n = k, t, 0
                n += 1
                allowed.append(n <= limit)
            yield pd.DataFrame({"key": part["key"], "event_id": part["event_id"], "allowed": allowed})

    rows = events.select("key", "event_id", F.col("at").cast("double").alias("at")).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return rows.mapInPandas(walk, "key long, event_id long, allowed boolean")


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """M2: an audit row (key, column, before, after) for each value that an update changes."""
    j = old.select(key, *[F.col(c).cast("string").alias(f"_o_{c}") for c in columns]).join(new.select(key, *[F.col(c).cast("string").alias(f"_n_{c}") for c in columns]), key)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_o_{c}").alias("before"), F.col(f"_n_{c}").alias("after")) for c in columns]))
    return j.select(key, each.alias("c")).select(key, "c.*").where(~F.col("before").eqNullSafe(F.col("after")))
