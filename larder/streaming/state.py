"""Keyed state over streams of (event_id, ts, user_id, item_id, payload).

Toggles and last-write-wins are built-in streaming aggregations in update mode;
the bounded history keeps a small list for each user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators import state


def favourites(events: DataFrame) -> DataFrame:
    """Every changed (user_id, item_id) with its membership; for update mode."""
    odd = events.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("last"))
    return odd.select("user_id", "item_id", (F.col("n") % 2 == 1).alias("favourite"), F.col("last.ts").alias("changed"))


def latest_profiles(events: DataFrame, schema: str, default: Column) -> DataFrame:
    """For update mode; the batch operator holds on streams as it stands."""
    return state.latest_profiles(events, schema, default)


def history(events: DataFrame, most: int = 20) -> DataFrame:
    """Each changed user's list, newest first; the state of a user is at most ``most`` items, and late events find their place."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seen = {i: (t, e) for i, t, e in zip(*held.get, strict=True)} if held.exists else {}
        for frame in frames:
            for i, t, e in zip(frame["item_id"], frame["us"], frame["event_id"], strict=True):
                seen[i] = max(seen.get(i, (t, e)), (t, e))
        rows = sorted(seen.items(), key=lambda x: x[1], reverse=True)[:most]
        items, times, ids = [int(i) for i, _ in rows], [int(v[0]) for _, v in rows], [int(v[1]) for _, v in rows]
        held.update((items, times, ids))
        yield pd.DataFrame({"user_id": key[0], "item_id": items, "us": times, "pos": range(1, len(rows) + 1)})

    timed = events.select(F.col("user_id").cast("long"), F.col("item_id").cast("long"), F.unix_micros("ts").alias("us"), F.col("event_id").cast("long"))
    out = timed.groupBy("user_id").applyInPandasWithState(update, "user_id long, item_id long, us long, pos int", "items array<long>, times array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)
    return out.select("user_id", "item_id", F.timestamp_micros("us").alias("viewed_at"), "pos")
