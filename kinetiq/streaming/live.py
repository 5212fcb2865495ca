"""Live operators: the same rules with state kept per key by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


START_SPEED, END_SHARE, END_MS = 7.0, 0.6, 120.0


def collision_step(state, at: float, speed: float):
    """One sample of a player's head speed: (state, event or None).

    A collision starts at START_SPEED and ends once the speed has stayed under END_SHARE of that for END_MS.
    State: (started at, since when slow or None, events so far).
    """
    start, slow, n = state
    if start is None:
        return ((at, None, n + 1), ("start", n + 1, at, 0.0)) if speed >= START_SPEED else (state, None)
    if speed >= END_SHARE * START_SPEED:
        return (start, None, n), None
    slow = at if slow is None else slow
    if at - slow >= END_MS:
        return (None, None, n), ("end", n, at, at - start)
    return (start, slow, n), None


def _collisions(key, batches: Iterator[pd.DataFrame], group: GroupState):
    state = group.get if group.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values("timestamp_ms")
    out = []
    for at, speed in zip(rows["timestamp_ms"], rows["speed"]):
        state, event = collision_step(state, float(at), float(speed))
        if event:
            out.append((*key, *event))
    group.update(state)
    yield pd.DataFrame(out, columns=["play_id", "player_id", "event", "number", "timestamp_ms", "duration_ms"])


def live_collisions(samples: DataFrame) -> DataFrame:
    """Starts and ends of collisions from (play_id, player_id, timestamp_ms, speed)."""
    return samples.groupBy("play_id", "player_id").applyInPandasWithState(
        _collisions,
        "play_id string, player_id string, event string, number int, timestamp_ms double, duration_ms double",
        "start double, slow double, number int",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def window_metrics(frames: DataFrame, kind: str = "tumbling", length: str = "1 second", slide: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Mean and largest velocity per subject in tumbling, sliding or session windows; rows later than ``late`` are dropped."""
    at = {"tumbling": lambda: F.window("ts", length), "sliding": lambda: F.window("ts", length, slide), "session": lambda: F.session_window("ts", length)}[kind]()
    marked = frames.withWatermark("ts", late)
    return marked.groupBy(at.alias("w"), "subject_id").agg(F.count("*").alias("n"), F.avg("velocity").alias("mean"), F.max("velocity").alias("most")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "subject_id", "n", "mean", "most"
    )


