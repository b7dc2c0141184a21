"""Feeds in which no provider or domain takes too many places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def capped_feed(rows: DataFrame, caps: dict[str, int], most: int, key: str = "item_id", score: str = "rank_score") -> DataFrame:
    """(key, place): by falling score, ties by key, a row is taken unless one of its groups has its cap already.

    A row refused by one cap doesn't use up another, so the caps are folded in order. Rows
    that share all their groups are taken from the best down, and at most the least cap of
    them: this pool is exact, and the driver reads it in order until the feed is full.
    """
    order = [F.desc(score), F.col(key)]
    deep = F.row_number().over(Window.partitionBy(*caps).orderBy(*order))
    pool = rows.withColumn("_n", deep).where(F.col("_n") <= min(most, *caps.values())).orderBy(*order)
    taken, used = [], {}
    for row in pool.select(key, score, *caps).toLocalIterator():
        groups = [(g, row[g]) for g in caps]
        if all(used.get(g, 0) < caps[g[0]] for g in groups):
            for g in groups:
                used[g] = used.get(g, 0) + 1
            taken.append((row[key], len(taken) + 1))
            if len(taken) == most:
                break
    return rows.sparkSession.createDataFrame(taken, f"{key} string, place int")
