"""Table access and shared intermediate storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir, or in local mode a temporary one.

    A cluster without the setting is refused, as a folder of one machine would lose
    results with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = getattr(shared_folder, "made", None)
    if made is None or not os.path.isdir(made):
        made = shared_folder.made = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


class Scratch:
    """Written intermediate tables of one operator run.

    Each save() cuts the lineage: a lost executor costs at most the job under way, as
    the table lies in the shared folder. drop() removes what later steps don't need.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def append(self, df: DataFrame, name: str, partition_by: str | None = None) -> None:
        writer = df.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended
            pass

    def _delete(self, path: str) -> None:
        delete_path(self.spark, path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system that the session knows, replaced whole."""
    at, files = _at(spark, f"{path}.new")
    stream = files.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _at(spark, path)
    files.delete(target, False)
    files.rename(at, target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; null where there is none, the file under way if only that is whole."""
    for name in (path, f"{path}.new"):
        at, files = _at(spark, name)
        if files.exists(at):
            return spark.read.text(name, wholetext=True).first()[0]
    return None


def ship_package(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the executors' Python workers, once per application."""
    context = spark.sparkContext
    if getattr(ship_package, "application", None) != context.applicationId:
        package = os.path.dirname(os.path.abspath(__file__))
        made = tempfile.mkdtemp(prefix="corvane-zip-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        archive = shutil.make_archive(os.path.join(made, "corvane-package"), "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)  # served by the driver to every executor
        ship_package.application = context.applicationId
    return spark


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
