"""Runs source adapters and tells how each went; landed files of a day become items."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.runtime import delete_path
from corvane.sources import landed
from corvane.sources.items import to_items

Adapter = Callable[[SparkSession], DataFrame]


def run_adapters(spark: SparkSession, adapters: dict[str, Adapter], wanted: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows by source, health): every wanted source's rows, and a row (source, status, rows, error, seconds) for each.

    A source without an adapter is skipped, one that fails is an error, one without rows
    empty; a failure of one doesn't stop the others. Sources are few.
    """
    found, health = {}, []
    for name in wanted:
        began, status, rows, error = time.perf_counter(), "skipped", 0, ""
        if name in adapters:
            try:
                found[name] = adapters[name](spark)
                rows = found[name].count()
                status = "ok" if rows else "empty"
            except Exception as problem:  # whatever a source does, the run goes on
                found.pop(name, None)
                status, error = "error", str(problem).splitlines()[0][:200] if str(problem) else type(problem).__name__
        health.append((name, status, rows, error, round(time.perf_counter() - began, 3)))
    return found, spark.createDataFrame(health, "source string, status string, rows bigint, error string, seconds double")


def with_fallback(parts: list[DataFrame], fallback: Adapter, spark: SparkSession) -> DataFrame:
    """All parts together; where none has a row, the fallback instead, which knows no figures."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if rows.limit(1).count():
        return rows
    return fallback(spark).withColumns({"score": F.lit(0), "num_comments": F.lit(0)})


def items_of_day(spark: SparkSession, folder: str, files: list[str], observed_at: str) -> tuple[DataFrame, int]:
    """(items, broken lines) of the landed files of a day; the first file that has an item keeps it."""
    parts, broken = [], 0
    for place, name in enumerate(files):
        rows, bad = landed.read_json_lines(spark, f"{folder}/{name}")
        broken += bad.count()
        parts.append(to_items(rows, name, observed_at).withColumn("_place", F.lit(place)))
    items = reduce(DataFrame.unionByName, parts)
    return landed.first_of_each(items, ["item_id"], ["_place", "canonical_url", "title"]).drop("_place"), broken


def write_snapshot(tables: dict[str, DataFrame], path: str, partition_by: str) -> None:
    """A snapshot's tables as parquet, partitioned by a column; what lay there before is replaced."""
    for name, rows in tables.items():
        delete_path(rows.sparkSession, f"{path}/{name}")
        rows.write.partitionBy(partition_by).parquet(f"{path}/{name}")
