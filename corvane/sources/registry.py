"""The registry of sources: a dimension of some dozens of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry(sources: DataFrame) -> DataFrame:
    """Sources with the rule for runs they miss: those of the first tier are required."""
    return sources.withColumn("rule", F.when(F.col("tier") == 1, "required").otherwise("optional"))


def expected(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """(provider, tier, run_id): every source of every run; runs are listed once each."""
    days = F.array_sort(F.array_agg("run_id")).alias("days")  # a run a day
    listed = runs.distinct().agg(days)
    return sources.select("provider", "tier").join(F.broadcast(listed)).select("provider", "tier", F.explode("days").alias("run_id"))
