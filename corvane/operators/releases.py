"""Immutable releases, the pointer readers follow, and its history."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from corvane.functions.ids import release_checksum
from corvane.runtime import read_text, write_text


class ReleaseError(RuntimeError):
    """A release that can't be written, or isn't what its manifest says."""


def _exists(spark: SparkSession, path: str) -> bool:
    return read_text(spark, path) is not None


def freeze(rows: DataFrame, path: str, partition_by: list[str] | None = None, info: dict | None = None) -> dict:
    """Writes a release once and finalises it with a manifest (rows, checksum, columns); a finalised path is refused."""
    spark = rows.sparkSession
    if _exists(spark, f"{path}/manifest.json"):
        raise ReleaseError(f"{path} is finalised")
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    columns = sorted(rows.columns)
    found = release_checksum(spark.read.parquet(f"{path}/data").select(columns), columns).first()
    manifest = {"rows": found["rows"], "checksum": found["checksum"], "columns": columns, **(info or {})}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The release's rows, if they still have the manifest's checksum."""
    manifest = json.loads(read_text(spark, f"{path}/manifest.json"))
    rows = spark.read.parquet(f"{path}/data").select(manifest["columns"])
    found = release_checksum(rows, manifest["columns"]).first()
    if (found["rows"], found["checksum"]) != (manifest["rows"], manifest["checksum"]):
        raise ReleaseError(f"{path} isn't what its manifest says")
    return rows


def next_id(existing: list[str], stem: str) -> str:
    """stem-r1, or one more than the highest number taken."""
    taken = [int(e.rsplit("-r", 1)[1]) for e in existing if e.startswith(f"{stem}-r") and e.rsplit("-r", 1)[1].isdigit()]
    return f"{stem}-r{max(taken, default=0) + 1}"


def publish(spark: SparkSession, root: str, channel: str, release: str, passed: bool = True) -> list[str]:
    """Moves a channel's pointer if the quality gate passed; returns the channel's history."""
    if not passed:
        raise ReleaseError(f"{release} failed the gate")
    at = f"{root}/{channel}.json"
    history = json.loads(read_text(spark, at)) if _exists(spark, at) else []
    write_text(spark, at, json.dumps([*history, release]))
    return [*history, release]


def published(spark: SparkSession, root: str, channel: str) -> str | None:
    at = f"{root}/{channel}.json"
    return json.loads(read_text(spark, at))[-1] if _exists(spark, at) else None


def rollback(spark: SparkSession, root: str, channel: str) -> str:
    """Moves the pointer to the release before, as a new event of the history."""
    history = json.loads(read_text(spark, f"{root}/{channel}.json"))
    earlier = [r for r in history if r != history[-1]]
    if not earlier:
        raise ReleaseError("there is no earlier release")
    return publish(spark, root, channel, earlier[-1])[-1]


def register(rows: DataFrame, root: str, stem: str, info: dict | None = None) -> str:
    """Freezes rows as the next release of a stem below a folder, notes it in the folder's register, and returns its id."""
    spark, at = rows.sparkSession, f"{root}/register.json"
    known = json.loads(read_text(spark, at) or "[]")
    name = next_id([r["id"] for r in known], stem)
    manifest = freeze(rows, f"{root}/{name}", info=info)
    write_text(spark, at, json.dumps([*known, {"id": name, "rows": manifest["rows"], "checksum": manifest["checksum"]}]))
    return name


def registered(spark: SparkSession, root: str) -> list[dict]:
    """The register of a folder: id, rows and checksum of each release, in order."""
    return json.loads(read_text(spark, f"{root}/register.json") or "[]")
