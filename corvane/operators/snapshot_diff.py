"""Problem 2: what changed between full snapshots.

Method: content-defined chunks of key-sorted snapshots. Within hash buckets the keys of a
snapshot are sorted and cut into chunks where a key's own hash says so, so an insertion
moves no later boundary. Chunks whose digest equals that of the neighbouring snapshot are
discarded; the rows of the others are joined by key and classified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key ends a chunk with this chance.
CHUNK_ROWS = 32
#: Keys sorted together, as a number of buckets: a bucket of a snapshot of 10^9 rows has some 10^5.
BUCKETS = 8192


def chunked(rows: DataFrame, key: str, values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds bucket, chunk (its first key), rows and digest of the chunk to rows (seq, key, values), distinct by (seq, key)."""
    row_hash = F.xxhash64(F.col(key), *values, *(F.col(v).isNull() for v in values))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("_hash", row_hash).repartition("bucket")
    cut = F.when(F.pmod(F.xxhash64(F.lit("cut"), key), F.lit(CHUNK_ROWS)) == 0, F.col(key))
    sorted_keys = Window.partitionBy("bucket", "seq").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chunk", F.coalesce(F.last(cut, ignorenulls=True).over(sorted_keys), F.lit("")))
    chunk = Window.partitionBy("bucket", "seq", "chunk")
    spread = F.sum(F.col("_hash").cast("decimal(20,0)")).over(chunk)
    return rows.withColumn("digest", F.struct(F.bit_xor("_hash").over(chunk), spread, F.count("*").over(chunk))).drop("_hash")


def snapshot_changes(rows: DataFrame, key: str, values: list[str], last_seq: int, buckets: int = BUCKETS) -> DataFrame:
    """(seq, key, change_type) of every record added, removed or changed against the list before.

    rows: (seq, key, values), one row per (seq, key); seq counts the lists 1, 2, … last_seq
    without gaps. Null is a value of its own. A list without rows removes all records of
    the list before; the first list gives nothing, nor does an empty table. Null keys are ignored.
    """
    rows = chunked(rows.where(F.col(key).isNotNull()).select("seq", key, *values), key, values, buckets)
    same = Window.partitionBy("bucket", "chunk", "digest").orderBy("seq")
    near = Window.partitionBy("bucket", "chunk", "digest").orderBy("seq").rangeBetween(-1, -1)
    after = Window.partitionBy("bucket", "chunk", "digest").orderBy("seq").rangeBetween(1, 1)
    rows = rows.withColumn("as_before", F.count("*").over(near) > 0).withColumn("as_after", F.count("*").over(after) > 0)
    now = F.when(~F.col("as_before") & (F.col("seq") > 1), F.struct(F.col("seq").alias("at"), F.lit(True).alias("now")))
    then = F.when(~F.col("as_after") & (F.col("seq") < last_seq), F.struct((F.col("seq") + 1).alias("at"), F.lit(False).alias("now")))
    # Both sides of the join are the same sorted buckets, so it is a grouping by key without another shuffle.
    sides = rows.select("bucket", key, F.struct(*values).alias("row"), F.explode(F.array_compact(F.array(now, then))).alias("side"))
    side = lambda is_now: F.max(F.when(F.col("side.now") == F.lit(is_now), F.col("row")))
    met = sides.groupBy("bucket", F.col("side.at").alias("seq"), key).agg(side(True).alias("new"), side(False).alias("old"))
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return met.withColumn("change_type", kind).where("change_type is not null").select("seq", key, "change_type")
