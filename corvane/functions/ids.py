"""Stable identifiers and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(*parts: Column, length: int = 20, separator: str = "|") -> Column:
    """The first hex digits of the SHA-256 of the parts; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws(separator, *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, length)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def release_checksum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, checksum) that is the same for any order of the rows: sums of four pieces of every row's hash."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    piece = lambda k: F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("rows"), F.concat_ws("-", *(piece(k) for k in range(4))).alias("checksum"))
