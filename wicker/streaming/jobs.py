"""Deliveries, queue entries, bursts and leases over streams. Watermarks bound the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.queue import LEASE


def first_deliveries(stream: DataFrame, key: str = "delivery_id", ts: str = "received_at", late: str = "1 day") -> DataFrame:
    """Each delivery once; a repeat within the watermark is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def enqueued(stream: DataFrame, key: str = "dedupe_key", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Requests that open a job: one for each key while the watermark remembers it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def debounced(stream: DataFrame, ts: str, wanted: Column, gap: str, late: str = "1 minute", keys: tuple[str, ...] = ()) -> DataFrame:
    """Bursts that a quiet gap has ended, as the batch operator of the same name. (Sessions of a stream need a key: a constant where there is none.)"""
    burst = stream.withColumn("_w", wanted.cast("int")).withColumn("_all", F.lit(0)).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), "_all", *keys).agg(F.count(F.lit(1)).alias("n_events"), F.sum("_w").alias("n_wanted"))
    return burst.where("n_wanted > 0").select(*keys, F.col("w.start").alias("began"), F.col("w.end").alias("due"), "n_events", "n_wanted")


def leases(stream: DataFrame, lease: int = LEASE, late: str = "1 second") -> DataFrame:
    """(job_id, event, owner): claims and renewals of stream(job_id, ts, owner, what) and, once a lease has run out in event
    time without a renewal by its owner or a `done`, its reclaim."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job, out = key[0], []
        if state.hasTimedOut:
            owner = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [job], "event": ["reclaimed"], "owner": [owner]})
            return
        owner, until = state.get if state.exists else (None, 0)
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            at = int(row.ts.timestamp() * 1000)
            if owner is not None and at > until:
                out.append((job, "reclaimed", owner))
                owner = None
            if row.what == "done" and row.owner == owner:
                out.append((job, "done", owner))
                owner = None
            elif row.what == "claim" and owner is None:
                owner, until = row.owner, at + lease * 1000
                out.append((job, "claimed", owner))
            elif row.what == "renew" and row.owner == owner:
                until = at + lease * 1000
        if owner is None:
            if state.exists:
                state.remove()
        else:
            state.update((owner, until))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "event", "owner"])

    return stream.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(step, "job_id long, event string, owner string", "owner string, until long", "append", GroupStateTimeout.EventTimeTimeout)
