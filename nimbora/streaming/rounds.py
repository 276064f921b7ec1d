"""Rounds of a game over a stream of events, as keyed state with timers (an extension: the batch engine
has no streams). A player's round opens; a guess in time answers it, the time limit or the player's
next round closes it unanswered. State is one open round a player, so it ends with its timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "player long, round_id long, guess_id long, answered boolean, seconds double"


def outcomes(events: DataFrame, limit_seconds: float = 45.0, delay: str = "10 minutes") -> DataFrame:
    """One row per closed round of a stream (player, event_id, kind: open or guess, ts). Events of a
    player count in the order of (ts, event_id); they may come later than others by ``delay``. A
    guess without an open round is none. A round that nothing closes is told once the watermark
    has passed its limit."""
    limit = int(limit_seconds * 1000)
    rows = events.filter(F.col("kind").isin("open", "guess")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    slim = rows.select("player", "event_id", "kind", "ts", F.unix_millis("ts").alias("ms"))

    def play(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, open_ = [], state.get if state.exists else None

        def close(guess: int | None, at: int | None) -> None:
            closed.append((key[0], open_[0], guess, guess is not None, None if at is None else (at - open_[1]) / 1000))

        if state.hasTimedOut:
            close(None, None)
            open_ = None
        else:
            every = pd.concat(list(parts)).sort_values(["ms", "event_id"])
            for id_, kind, ms in zip(every["event_id"].tolist(), every["kind"].tolist(), every["ms"].tolist(), strict=True):
                if open_ and (kind == "open" or ms > open_[1] + limit):
                    close(None, None)
                    open_ = None
                if kind == "open":
                    open_ = (id_, ms)
                elif open_:
                    close(id_, ms)
                    open_ = None
        if open_ and open_[1] + limit <= state.getCurrentWatermarkMs():
            close(None, None)
            open_ = None
        if open_:
            state.update(open_)
            state.setTimeoutTimestamp(open_[1] + limit)
        elif state.exists:
            state.remove()
        table = pd.DataFrame(closed, columns=["player", "round_id", "guess_id", "answered", "seconds"])
        yield table.astype({"guess_id": "Int64", "seconds": "float64"})

    return slim.groupBy("player").applyInPandasWithState(play, OUT, "round_id long, ms long", "append", GroupStateTimeout.EventTimeTimeout)
