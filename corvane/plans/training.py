"""Queries of the general data-preparation problems (2 and 5) over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.latest import latest
from corvane.operators.snapshot_diff import snapshot_changes
from corvane.operators.timestamps import NORMAL, with_utc_micros
from corvane.runtime import table


def numbered_snapshots(spark: SparkSession, sf_dir: str) -> list[tuple[int, int, str]]:
    """(seq, snapshot_id, snapshot_date) of the deliveries; the table has one row per delivery, a few a week."""
    rows = table(spark, sf_dir, "snapshots").select("snapshot_id", "snapshot_date").distinct().orderBy("snapshot_date", "snapshot_id").collect()
    return [(i + 1, r["snapshot_id"], r["snapshot_date"]) for i, r in enumerate(rows)]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and observed items that were added, removed or changed against the snapshot before."""
    known = numbered_snapshots(spark, sf_dir)
    days = F.broadcast(spark.createDataFrame(known, "seq int, snapshot_id int, snapshot_date string"))
    posts = table(spark, sf_dir, "posts").select("snapshot_id", "post_id", "ingested_at", "score", "num_comments")
    posts = latest(posts, ["snapshot_id", "post_id"], ["ingested_at"], ["score", "num_comments"])
    posts = posts.join(days.select("seq", "snapshot_id"), "snapshot_id").withColumnRenamed("post_id", "record_id")
    seen = table(spark, sf_dir, "observations").select(
        F.substring_index("run_id", ":", 1).alias("snapshot_date"), F.col("item_id").alias("record_id"), "observed_at", "score_delta"
    )
    seen = latest(seen, ["snapshot_date", "record_id"], ["observed_at"], ["score_delta"])
    seen = seen.join(days.select("seq", "snapshot_date"), "snapshot_date")
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), "seq", "record_id", "change_type")
    found = named(snapshot_changes(posts, "record_id", ["score", "num_comments"], len(known)), "posts").unionByName(
        named(snapshot_changes(seen, "record_id", ["score_delta"], len(known)), "observations")
    )
    return found.join(days.select("seq", "snapshot_date"), "seq").select("table_name", "snapshot_date", "record_id", "change_type")


P2_SQL = """
with days as (select snapshot_id, snapshot_date, row_number() over (order by snapshot_date, snapshot_id) as seq from snapshots),
p as (select s.seq, post_id as record_id, arg_max({'s': score, 'c': num_comments}, ingested_at) as v
      from posts join days s using (snapshot_id) group by all),
o as (select s.seq, item_id as record_id, arg_max({'s': score_delta}, observed_at) as v
      from observations join days s on s.snapshot_date = split_part(run_id, ':', 1) group by all),
c as (
  select 'posts' as table_name, coalesce(a.seq, b.seq + 1) as seq, coalesce(a.record_id, b.record_id) as record_id,
    case when b.seq is null then 'added' when a.seq is null then 'removed'
         when a.v.s is distinct from b.v.s or a.v.c is distinct from b.v.c then 'changed' end as change_type
  from p a full join p b on a.seq = b.seq + 1 and a.record_id = b.record_id
  union all
  select 'observations', coalesce(a.seq, b.seq + 1), coalesce(a.record_id, b.record_id),
    case when b.seq is null then 'added' when a.seq is null then 'removed'
         when a.v.s is distinct from b.v.s then 'changed' end
  from o a full join o b on a.seq = b.seq + 1 and a.record_id = b.record_id)
select c.table_name, days.snapshot_date, c.record_id, c.change_type
from c join days using (seq) where c.change_type is not null and c.seq > 1
"""

def time_values(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Distinct (record_id, raw_value) with zone and date_order, of each field of problem 5."""
    sources = table(spark, sf_dir, "sources").select("provider", F.col("tz_name").alias("zone"), "date_order")
    items, posts = table(spark, sf_dir, "items"), table(spark, sf_dir, "posts")

    def of(rows: DataFrame, raw: str, key: str, provider: Column) -> DataFrame:
        rows = rows.where(F.col(raw).isNotNull() & F.col(key).isNotNull() & ~F.col(raw).rlike(NORMAL))
        return rows.groupBy(F.col(key).alias("record_id"), F.col(raw).alias("raw_value")).agg(F.max(provider).alias("provider"))

    nowhere = {"zone": F.lit(None).cast("string"), "date_order": F.lit(None).cast("string")}
    return {
        "items.published_at": of(items, "published_at", "item_id", F.col("provider")).join(sources, "provider", "left"),
        "items.observed_at": of(items, "observed_at", "item_id", F.lit(None)).withColumns(nowhere),
        "posts.created_utc": of(posts, "created_utc", "post_id", F.lit(None)).withColumns(nowhere),
    }


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every time value that isn't already in the normal form."""
    out = None
    for field, values in time_values(spark, sf_dir).items():
        found = with_utc_micros(values, "raw_value", "zone", "date_order")
        # Grouped, not filtered: a pushed filter would repeat the whole cascade in front of the scan.
        found = found.groupBy("record_id", "raw_value").agg(F.max("utc_us").alias("utc_us")).where("utc_us is not null")
        found = found.select(F.lit(field).alias("field_name"), "record_id", "raw_value", "utc_us")
        out = found if out is None else out.unionByName(found)
    return out


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}
ORACLE = {"p2_found": P2_SQL}
