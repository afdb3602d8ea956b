"""Structured Streaming forms: the policy filter runs on a stream as it is; collapsing keeps state by key.

The state of a key is its open group and its last time.  A group goes out when an event of its key
lies beyond the window, or when the watermark passes its end.  Late events go out alone, as in a batch, unless
the watermark has passed them: those Spark drops, so ``delay`` should cover what lags behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, first_row long, last_row long, first_seen timestamp, last_seen timestamp, occurrence_count long, out_of_order boolean"
STATE = "first long, last long, top long, first_row long, last_row long, n long"


def _out(key: str, s: tuple, late: bool = False) -> pd.DataFrame:
    first, last, _, a, b, n = s
    return pd.DataFrame({"key": [key], "first_row": [a], "last_row": [b], "first_seen": [pd.Timestamp(first, unit="us")], "last_seen": [pd.Timestamp(last, unit="us")], "occurrence_count": [n], "out_of_order": [late]})


def collapse_stream(events: DataFrame, key: str, time: str, row: str, window_minutes: float = 15, delay: str = "0 seconds") -> DataFrame:
    """Collapsed groups of a stream of (key, time, row)."""
    window = int(window_minutes * 60_000_000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if now is not None and now[5]:
                yield _out(k[0], now)
                state.update((now[0], now[1], now[2], now[3], now[4], 0))  # the last time still tells late events
            return
        rows = pd.concat(list(frames)).sort_values("row")
        for t, r in zip(rows["micros"].tolist(), rows["row"].tolist()):
            if now is not None and t < now[2]:
                yield _out(k[0], (t, t, t, r, r, 1), True)
            elif now is not None and now[5] and t - now[0] <= window:
                now = (now[0], t, t, now[3], r, now[5] + 1)
            else:
                if now is not None and now[5]:
                    yield _out(k[0], now)
                now = (t, t, t, r, r, 1)
        state.update(now)
        close = (now[0] + window) // 1000 + 1
        state.setTimeoutTimestamp(max(close, state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark(time, delay).select(F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(time).alias("micros"), F.col(row).cast("long").alias("row"))
    return timed.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
