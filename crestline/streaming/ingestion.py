"""The states of ingestions: queued, processing, done, failed; the same on a table of events and on a stream of them.

An ingestion's state follows from its last event of the worker (start, finish,
error) and its last request (submit, retry), whatever order the events come in:
what is done stays done, a later request queues anything else anew, and what is
being processed without a word for too long has failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORKER, REQUESTS = ["start", "finish", "error"], ["submit", "retry"]
#: Minutes until processing is taken for broken off, what is then said, and how much of an error is kept.
STALE_MINUTES = 20
INTERRUPTED = "Ingestion worker was interrupted (server restart/reload). Please retry the ingestion."
ERROR_CHARS = 4000


def states(events: DataFrame, as_of: Column, stale_minutes: int = STALE_MINUTES) -> DataFrame:
    """ingestion_id, status, error, updated_at from a table of event_id, ingestion_id, kind, error and created_at.

    Events with a null id or an unknown kind count for nothing; of events at
    the same time the larger event_id is the later. Both last events are
    aggregated before the shuffle, so an ingestion may have any number.
    """
    known = events.where(F.col("ingestion_id").isNotNull() & F.col("kind").isin(*WORKER, *REQUESTS))
    told = F.struct("created_at", "event_id", "kind", F.substring(F.coalesce("error", F.lit("")), 1, ERROR_CHARS).alias("error"))
    last = known.groupBy("ingestion_id").agg(F.max(F.when(F.col("kind").isin(WORKER), told)).alias("worker"), F.max(F.when(F.col("kind").isin(REQUESTS), F.struct("created_at", "event_id"))).alias("request"))
    done = F.coalesce(F.col("worker.kind") == "finish", F.lit(False))
    asked = F.col("worker").isNull() | F.coalesce(F.col("request") > F.struct("worker.created_at", "worker.event_id"), F.lit(False))
    status = F.when(done, "done").when(asked, "queued").when(F.col("worker.kind") == "start", "processing").otherwise("failed")
    told_at = F.when(~done & asked, F.col("request.created_at")).otherwise(F.col("worker.created_at"))
    found = last.select("ingestion_id", status.alias("status"), told_at.alias("updated_at"), F.col("worker.error").alias("error"))
    stale = (F.col("status") == "processing") & (F.col("updated_at") <= as_of - F.make_dt_interval(mins=F.lit(stale_minutes)))
    said = F.when(stale, INTERRUPTED).when(F.col("status") == "failed", F.col("error")).otherwise("")
    return found.select("ingestion_id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"), said.alias("error"), "updated_at")


_STATE = "worker_at long, worker_id long, kind string, error string, request_at long, request_id long, stale boolean"
STATES = "ingestion_id long, status string, error string, updated_at timestamp"


def _told(state: tuple) -> tuple[str, str, int]:
    """status, error and the time of the last change."""
    worker_at, worker_id, kind, error, request_at, request_id, stale = state
    if kind == "finish":
        return "done", "", worker_at
    if kind is None or (request_at is not None and (request_at, request_id) > (worker_at, worker_id)):
        return "queued", "", request_at
    if kind == "start":
        return ("failed", INTERRUPTED, worker_at) if stale else ("processing", "", worker_at)
    return "failed", error, worker_at


def watched(events: DataFrame, stale_seconds: int = STALE_MINUTES * 60) -> DataFrame:
    """A stream of states from a stream of events: a row whenever an ingestion's events come, and when its time is up.

    Time is up stale_seconds of processing time after the last event of an
    ingestion that is being processed; a later event puts it back.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None, None, None, None, None, False)
        if state.hasTimedOut:
            now = (*now[:6], now[2] == "start")
        else:
            worker, request = now[:4], now[4:6]
            for batch in batches:
                for at, event, kind, error in zip(batch["created_at"], batch["event_id"], batch["kind"], batch["error"], strict=True):
                    at = pd.Timestamp(at).value // 1000
                    if kind in WORKER and (worker[0] is None or (at, event) > worker[:2]):
                        worker = (at, int(event), kind, error[:ERROR_CHARS] if isinstance(error, str) else "")
                    if kind in REQUESTS and (request[0] is None or (at, event) > request):
                        request = (at, int(event))
            now = (*worker, *request, bool(now[6]) and (worker, request) == (now[:4], now[4:6]))
        state.update(now)
        status, error, at = _told(now)
        if status == "processing":
            state.setTimeoutDuration(stale_seconds * 1000)
        yield pd.DataFrame({"ingestion_id": [key[0]], "status": [status], "error": [error], "updated_at": [pd.Timestamp(at * 1000)]})

    known = events.where(F.col("ingestion_id").isNotNull() & F.col("kind").isin(*WORKER, *REQUESTS)).select("ingestion_id", "event_id", "kind", "error", "created_at")
    return known.groupBy("ingestion_id").applyInPandasWithState(run, STATES, _STATE, "update", "ProcessingTimeTimeout")
