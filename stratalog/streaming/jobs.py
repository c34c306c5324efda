"""The life of leased jobs as a state machine over a stream of events, one state a job.

Events: enqueue, claim (by a worker, for lease_s seconds), heartbeat, complete, fail, defer, cancel. Rules: only the worker
that holds a live lease may renew, complete, fail or defer; a lease that ran out frees the job for the next claim; cancel
wins over what comes later; a failure waits 2 to the power of attempts (8 at most) seconds, none after a deterministic one,
and the last allowed attempt makes the job dead. Events of a batch are taken in the order of (time, sequence); an event
that the rules don't allow leaves the state and is reported as refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, worker string, lease_until double, attempts int, available_at double, max_attempts int"
OUT = "job_id long, seq long, event string, accepted boolean, status string, worker string, attempts int, available_at double"
FINAL = ("done", "dead", "cancelled")
#: status, worker, lease_until, attempts, available_at, max_attempts
NEW = (None, None, 0.0, 0, 0.0, 3)


def step(state: tuple, event: str, at: float, worker: str | None, lease_s: float, deterministic: bool, max_attempts: int | None = None) -> tuple[tuple, bool]:
    """The next state and whether the event was allowed."""
    status, owner, until, attempts, available, most = state
    if event == "enqueue":
        return (("queued", None, 0.0, 0, at, max_attempts or most), True) if status is None or status in FINAL else (state, False)
    if status is None or status in FINAL:
        return state, False
    if event == "cancel":
        return ("cancelled", None, 0.0, attempts, available, most), True
    if event == "claim":
        free = status == "queued" and at >= available or status == "running" and at > until
        if free and attempts >= most:
            return ("dead", None, 0.0, attempts, available, most), False
        return (("running", worker, at + lease_s, attempts + 1, available, most), True) if free else (state, False)
    if status != "running" or worker != owner or at > until:
        return state, False
    if event == "heartbeat":
        return (status, owner, at + lease_s, attempts, available, most), True
    if event == "complete":
        return ("done", None, 0.0, attempts, available, most), True
    if event == "defer":
        return ("queued", None, 0.0, attempts - 1, at + lease_s, most), True
    if event == "fail":
        if deterministic or attempts >= most:
            return ("dead", None, 0.0, attempts, available, most), True
        return ("queued", None, 0.0, attempts, at + 2.0 ** min(8, attempts), most), True
    return state, False


def _run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else NEW
    events = pd.concat(list(parts)).sort_values(["at", "seq"], kind="stable")
    rows = []
    for e in events.itertuples(index=False):
        most = None if pd.isna(e.max_attempts) else int(e.max_attempts)
        now, ok = step(tuple(now), e.event, float(e.at), None if pd.isna(e.worker) else e.worker, float(e.lease_s) if not pd.isna(e.lease_s) else 0.0, bool(e.deterministic) if not pd.isna(e.deterministic) else False, most)
        rows.append((key[0], e.seq, e.event, ok, now[0], now[1], now[3], now[4]))
    if now[0] in FINAL:  # forgotten: later events but an enqueue are refused all the same
        if state.exists:
            state.remove()
    else:
        state.update(now)
    yield pd.DataFrame(rows, columns=["job_id", "seq", "event", "accepted", "status", "worker", "attempts", "available_at"])


def job_states(events: DataFrame) -> DataFrame:
    """Of a stream with job_id, seq, at (seconds), event, worker, lease_s, deterministic, max_attempts: what became of
    each event. A job's events of one batch are held by one task; the state is six values a job, and none
    once a job has ended."""
    return events.groupBy("job_id").applyInPandasWithState(_run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
