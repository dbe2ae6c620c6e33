"""Sliding-window rate limit: rejected events don't count towards the limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "key long, event_id long, ts timestamp, allowed boolean"


def _admit(times: deque, now: float, limit: int, window: float) -> bool:
    """Drops what is at least a window old; the event is let in, and noted, if fewer than limit are left."""
    while times and now - times[0] >= window:
        times.popleft()
    if len(times) < limit:
        times.append(now)
        return True
    return False


def limited(events: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """Batch form over events (key, event_id, ts): each key's events in order of time and id.

    Keys are dealt over the tasks and sorted there by Spark, which spills; a task streams through its rows and holds the
    at most limit times of the key that it is at. A key's events are judged in one task, since each verdict depends on
    the ones before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, times = object(), deque()
        for rows in batches:
            out = []
            for key, ts in zip(rows["key"], rows["ts"], strict=True):
                if key != at:
                    at, times = key, deque()
                out.append(_admit(times, ts.timestamp(), limit, window_seconds))
            yield rows.assign(allowed=out)[["key", "event_id", "ts", "allowed"]]

    rows = events.filter("key is not null").select("key", "event_id", "ts")
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, RESULT)


def limited_stream(events: DataFrame, limit: int, window_seconds: float, late: str = "1 hour") -> DataFrame:
    """Streaming form. Events wait until the watermark, `late` behind the newest, has passed them, so that those out of
    order are judged in order; later ones are dropped. A key's state, its waiting events and the at most limit times
    that count, ends when the watermark is a window past the last of them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, times = (list(zip(*state.get[:2], strict=True)), deque(state.get[2])) if state.exists else ([], deque())
        if not state.hasTimedOut:
            for rows in batches:
                waiting += [(int(e), t.timestamp()) for e, t in zip(rows["event_id"], rows["ts"], strict=True)]
        mark = state.getCurrentWatermarkMs() / 1000
        due = sorted((t, e) for e, t in waiting if t <= mark)
        waiting = [(e, t) for e, t in waiting if t > mark]
        out = [(key[0], e, pd.Timestamp(t, unit="s"), _admit(times, t, limit, window_seconds)) for t, e in due]
        if waiting or (times and mark < times[-1] + window_seconds):
            state.update(([e for e, _ in waiting], [t for _, t in waiting], list(times)))
            wake = min(t for _, t in waiting) if waiting else times[-1] + window_seconds
            state.setTimeoutTimestamp(int(max(wake, mark) * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "allowed"])

    held = "event_ids array<long>, waiting array<double>, times array<double>"
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(run, RESULT, held, "append", GroupStateTimeout.EventTimeTimeout)
