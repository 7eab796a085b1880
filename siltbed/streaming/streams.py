"""Streaming forms of the operators: the corpus as it arrives, windows over events, and locks as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltbed.operators import secrets
from siltbed.sources.corpus import lines


def secret_stream(corpus: DataFrame) -> DataFrame:
    """The secret scan over a stream of (file, text); stateless, so each file's rows come once, in append mode."""
    return secrets.findings(lines(corpus))


def event_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events and values by type in tumbling or sliding windows; later than ``delay`` is dropped."""
    ts = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return ts.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """A user's events without a pause longer than ``gap``."""
    ts = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return ts.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def lock_stream(events: DataFrame) -> DataFrame:
    """(file, session, action, granted) of each lock or unlock as it is decided, in event order within a batch.

    Keyed state holds each file's owner, so the decision is that of the batch fold over all that has arrived.
    """

    def decide(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        out = []
        for session, action in zip(rows["session"].astype(str), rows["action"]):
            granted = owner in (None, session) if action == "lock" else owner == session
            if granted:
                owner = session if action == "lock" else None
            out.append((key[0], session, action, granted))
        if owner is None:
            if state.exists:
                state.remove()
        else:
            state.update((owner,))
        yield pd.DataFrame(out, columns=["file", "session", "action", "granted"])

    rows = events.where(F.col("action").isin("lock", "unlock"))
    return rows.groupBy("file").applyInPandasWithState(decide, "file string, session string, action string, granted boolean", "owner string", "append", GroupStateTimeout.NoTimeout)
