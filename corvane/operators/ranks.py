"""Row numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import Scratch


def numbered(rows: DataFrame, order: list[Column], out: str = "n") -> DataFrame:
    """Adds each row's number from 1 in a total order: rows are sorted over ranges, numbered within theirs, and each range starts after the ones before it.

    The driver gets one count a range. Rows equal in the order get their numbers by chance.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    ranges = scratch.save(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = {r["_range"]: r["count"] for r in ranges.groupBy("_range").count().collect()}
    names = sorted(counts)
    starts = dict(zip(names, accumulate([0, *(counts[k] for k in names)])))
    if not starts:
        return ranges.withColumn(out, F.lit(0)).drop("_range")
    before = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn(out, own + F.element_at(before, F.col("_range"))).drop("_range")
