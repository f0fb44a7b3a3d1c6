"""Conversation history: window frames in batch, keyed state that expires in a stream."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_TURNS = 20
TTL_SECONDS = 1800
TURN = "array<struct<role:string,content:string>>"


def history(turns: DataFrame, session: str, order: str, role: str = "role", content: str = "text", max_turns: int = MAX_TURNS) -> DataFrame:
    """Adds ``history``: up to ``max_turns`` turns before each one, oldest first."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(-max_turns, -1)
    return turns.withColumn("history", F.collect_list(F.struct(F.col(role).alias("role"), F.col(content).alias("content"))).over(w))


def last_turns(history_column: Column, n: int = 10) -> Column:
    return F.slice(history_column, F.greatest(F.lit(1), F.size(history_column) - n + 1), n)


def idle_sessions(events: DataFrame, key: str, ts: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Adds ``session_no``: a key's next session begins after an idle time of more than ``ttl_seconds``."""
    w = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    begins = F.when(gap > ttl_seconds * 1_000_000, 1).otherwise(0)
    return events.withColumn("__new", begins).withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def history_stream(turns: DataFrame, session: str = "session_id", max_turns: int = MAX_TURNS, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The same history over a stream of (session, ts, role, content): each turn with the turns before it by ts.

    State is at most ``2 * max_turns`` turns a session, the newest, and goes when a session has been idle. A turn that comes in a later batch
    than turns after it is put in its place: it gets the kept turns before it, and what was given out already stays. An idle time of
    more than ``ttl_seconds`` ends a history. A turn without a ts counts as the newest. Under an availableNow trigger over several batches,
    switch ``spark.sql.streaming.noDataMicroBatches.enabled`` off: empty batches that look for idle sessions keep the query from ending.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = [tuple(p) for p in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, role, content in zip(rows["ts"], rows["role"], rows["content"], strict=True):
            now = round(ts.timestamp() * 1_000_000) if not pd.isna(ts) else past[-1][0] if past else 0
            at = bisect_right(past, now, key=lambda p: p[0])
            first, after = at, now
            while first and at - first < max_turns and after - past[first - 1][0] <= ttl_seconds * 1_000_000:
                first -= 1
                after = past[first][0]
            out.append((key[0], ts, role, content, [{"role": r, "content": c} for _, r, c in past[first:at]]))
            past.insert(at, (now, role, content))
            past = past[-2 * max_turns :]
        state.update((past,))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame(out, columns=[session, "ts", "role", "content", "history"])

    kind = dict(turns.dtypes)[session]
    return turns.groupBy(session).applyInPandasWithState(step, f"{session} {kind}, ts timestamp, role string, content string, history {TURN}", "past array<struct<at:long,role:string,content:string>>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_stats(evidence: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped. Works on streams and tables."""
    return evidence.withWatermark("timestamp", late).groupBy(F.window("timestamp", window, slide)).agg(F.count("*").alias("total"), F.count_if(~F.col("passed")).alias("failed"), F.max("risk_score").alias("top_risk")).select(F.col("window.start").alias("window_start"), "total", "failed", "top_risk")


def session_windows(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), "n")
