"""Event-time windows and stateful deltas over streams of landed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counted(events: DataFrame, time: str, keys: list[str], size: str, late: str = "1 hour", slide: str | None = None, value: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) per tumbling or sliding window; rows later than `late` are left out."""
    window: Column = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late).groupBy(window, *keys)
    total = F.sum(value) if value else F.count("*")
    return rows.agg(F.count("*").alias("n"), total.alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events without a longer pause."""
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key)
    return rows.agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def deltas(updates: DataFrame) -> DataFrame:
    """(post_id, new_comments, score_delta) of a stream of (post_id, at, score, num_comments) against the state kept per post."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for batch in batches:
            for row in batch.sort_values("at").itertuples():
                out.append((key[0], max(0, row.num_comments - last[1]) if last else 0, row.score - last[0] if last else 0))
                last = (row.score, row.num_comments)
        state.update(last)
        yield pd.DataFrame(out, columns=["post_id", "new_comments", "score_delta"])

    return updates.groupBy("post_id").applyInPandasWithState(
        step, "post_id string, new_comments long, score_delta long", "score long, num_comments long", "append", GroupStateTimeout.NoTimeout
    )
