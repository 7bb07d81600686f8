"""Agent events as a stream: sessions by gaps, repeats dropped, counters as deltas, one alert a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap_seconds: int = 3 * 3600, late: str = "1 hour") -> DataFrame:
    """(session, first, last_end, events) of events (session, ts); a gap of gap_seconds or more begins a new period.

    Spark's session windows join events exactly a gap apart, so the window is a second shorter on times in whole seconds.
    """
    timed = events.withColumn("ts", F.date_trunc("second", "ts")).withWatermark("ts", late)
    told = timed.groupBy("session", F.session_window("ts", f"{gap_seconds - 1} seconds")).agg(F.count("*").alias("events"))
    return told.select("session", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last_end"), "events")


def once(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of the keys that come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def changed_paths(events: DataFrame, every: str = "1 second", late: str = "1 minute") -> DataFrame:
    """(window, paths): the distinct paths that change within each stretch of time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def deltas(counters: DataFrame, expire_ms: int = 30 * 86_400_000) -> DataFrame:
    """(session, seq, delta) of growing counters (session, seq, total), each session's last total held as state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        before = rows["total"].shift(fill_value=last)
        state.update((int(rows["total"].iloc[-1]),))
        state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame({"session": key[0], "seq": rows["seq"], "delta": (rows["total"] - before).clip(lower=0)})

    kind = dict(counters.dtypes)["session"]
    return counters.select("session", "seq", "total").groupBy("session").applyInPandasWithState(run, f"session {kind}, seq bigint, delta bigint", "last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def alerts(findings: DataFrame, expire_ms: int = 30 * 86_400_000) -> DataFrame:
    """(session, finding): the first finding of each session; what comes later in the session is not told again."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        told = state.exists
        state.update((True,))
        state.setTimeoutDuration(expire_ms)
        if not told:
            first = min(f["finding"].min() for f in frames)
            yield pd.DataFrame({"session": [key[0]], "finding": [first]})

    kind = dict(findings.dtypes)["session"]
    return findings.select("session", "finding").groupBy("session").applyInPandasWithState(run, f"session {kind}, finding string", "told boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
