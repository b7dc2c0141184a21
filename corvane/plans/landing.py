"""Queries of sources, sinks, upserts, releases and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.operators import releases
from corvane.plans.base import I_SQL, day, day_sql, items_now, snapshot, snapshot_sql
from corvane.runtime import Scratch, table
from corvane.sources import landed, registry
from corvane.streaming import windows

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


@query("select json_valid(metadata) as valid, count(*) as n from items where metadata is not null group by 1")
def s1_skip_broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts, the broken ones counted."""
    rows = table(spark, sf_dir, "items").where("metadata is not null")
    return rows.groupBy(F.try_parse_json("metadata").isNotNull().alias("valid")).agg(F.count("*").alias("n"))


@query("select distinct snapshot_date, post_id, subreddit, title, score, num_comments from posts where post_id is not null")
def s2_json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written as JSON lines and read with the typed schema."""
    scratch = Scratch(spark, "lines")
    posts = table(spark, sf_dir, "posts").where("post_id is not null")
    posts.select("snapshot_date", "post_id", "subreddit", "title", "score", "num_comments").distinct().write.json(scratch.path("posts"))
    rows, _ = landed.read_json_lines(spark, scratch.path("posts"))
    return rows.select("snapshot_date", "post_id", "subreddit", "title", "score", "num_comments")


@query("""with r as (select snapshot_id, post_id, monitoring_type, row_number() over (partition by snapshot_id, post_id order by case monitoring_type when 'hot' then 1 when 'top' then 2 when 'rising' then 3 else 4 end, monitoring_type) as k from posts where not stickied)
select monitoring_type, count(*) as posts from r where k = 1 group by 1""")
def s14_mode_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts seen in several scans count for the first one."""
    order = F.when(F.col("monitoring_type") == "hot", 1).when(F.col("monitoring_type") == "top", 2).when(F.col("monitoring_type") == "rising", 3).otherwise(4)
    rows = table(spark, sf_dir, "posts").where(~F.col("stickied")).select("snapshot_id", "post_id", "monitoring_type")
    return landed.first_of_each(rows, ["snapshot_id", "post_id"], [order, "monitoring_type"]).groupBy("monitoring_type").agg(F.count("*").alias("posts"))


@query(f"""with l as (select snapshot_id, post_id, arg_max({{'s': score, 'c': num_comments}}, ingested_at) as v from posts group by 1, 2),
a as (select * from l where snapshot_id = {snapshot_sql()}), b as (select * from l where snapshot_id = {snapshot_sql(1)})
select coalesce(a.post_id, b.post_id) as post_id, greatest(0, coalesce(a.v.c - b.v.c, 0)) as new_comments, coalesce(a.v.s - b.v.s, 0) as score_delta,
case when a.post_id is null then 'missing' when b.v.s is null and b.v.c is null then 'new' else 'seen' end as state from a full join b on a.post_id = b.post_id""")
def s16_thread_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts against their state in the delivery before."""
    from corvane.operators.latest import latest

    of = lambda k: latest(table(spark, sf_dir, "posts").where(F.col("snapshot_id") == k), ["post_id"], ["ingested_at"], ["score", "num_comments"])
    return landed.thread_deltas(of(snapshot(spark, sf_dir)), of(snapshot(spark, sf_dir, 1)))


@query("select provider, source_cluster, tier, case when tier = 1 then 'required' else 'optional' end as rule from sources")
def s17_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source registry as a dimension."""
    return registry.registry(table(spark, sf_dir, "sources")).select("provider", "source_cluster", "tier", "rule")


@query("""with h as (select s.provider, d.snapshot_date as run_id, coalesce(n, 0) as n from sources s cross join snapshots d left join (select provider, snapshot_date, count(distinct item_id) as n from items group by 1, 2) i on i.provider = s.provider and i.snapshot_date = d.snapshot_date),
t as (select run_id, case when n > 0 then 'ok' when tier = 1 then 'pending' else 'error' end as status from h join sources using (provider)) select run_id, case when bool_and(status in ('ok', 'empty')) then 'complete' when bool_or(status = 'pending') then 'pending' else 'partial' end as status from t group by 1""")
def s20_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of every expected source in every run, and the run's status. Sources and runs are two small dimensions."""
    runs = table(spark, sf_dir, "snapshots").select(F.col("snapshot_date").alias("run_id"))
    expected = registry.expected(table(spark, sf_dir, "sources"), runs)
    counted = table(spark, sf_dir, "items").groupBy("provider", F.col("snapshot_date").alias("run_id")).agg(F.count_distinct("item_id").alias("n"))
    status = F.when(F.coalesce("n", F.lit(0)) > 0, "ok").when(F.col("tier") == 1, "pending").otherwise("error")
    return landed.run_status(expected.join(counted, ["provider", "run_id"], "left").withColumn("status", status))


@query("""select count(*) as items from (select distinct i.item_id from items i join observations o using (item_id) where o.run_id in (select distinct run_id from observations order by 1 desc limit 2))""")
def s22_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the last two runs, as a semi-join."""
    chosen = [r[0] for r in table(spark, sf_dir, "observations").select("run_id").distinct().orderBy(F.desc("run_id")).limit(2).collect()]
    runs = table(spark, sf_dir, "observations").where(F.col("run_id").isin(chosen)).select("item_id")
    return table(spark, sf_dir, "items").select("item_id").distinct().join(runs, "item_id", "left_semi").agg(F.count("*").alias("items"))


@query(f"""with a as (select item_id, max(title) as title, min(snapshot_date) as first_seen, max(language) as language from items where snapshot_date < {day_sql(1)} group by 1), b as (select item_id, max(title) as title, min(snapshot_date) as first_seen, max(language) as language from items where snapshot_date >= {day_sql(1)} group by 1)
select coalesce(a.item_id, b.item_id) as item_id, case when b.item_id is not null then b.title else a.title end as title, coalesce(a.first_seen, b.first_seen) as first_seen, case when b.item_id is not null then b.language else a.language end as language from a full join b on a.item_id = b.item_id""")
def s23_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows over earlier ones, the first date stays."""
    of = lambda rule: table(spark, sf_dir, "items").where(rule).groupBy("item_id").agg(F.max("title").alias("title"), F.min("snapshot_date").alias("first_seen"), F.max("language").alias("language"))
    return landed.upserted(of(F.col("snapshot_date") < day(spark, sf_dir, 1)), of(F.col("snapshot_date") >= day(spark, sf_dir, 1)), ["item_id"], ["first_seen"])


@query(f"""select snapshot_date, count(distinct item_id) as added from items i where snapshot_date = {day_sql()} and not exists (select 1 from items e where e.item_id = i.item_id and e.snapshot_date < {day_sql()}) group by 1""")
def s24_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last batch whose key is new."""
    last = day(spark, sf_dir)
    items = table(spark, sf_dir, "items").select("item_id", "snapshot_date")
    new = landed.only_new(items.where(F.col("snapshot_date") < last), items.where(F.col("snapshot_date") == last), ["item_id"])
    return new.groupBy("snapshot_date").agg(F.count_distinct("item_id").alias("added"))


@query("select provider || ':' || coalesce(nullif(source_section, ''), provider) as source, count(*) as rows from items group by 1")
def a29_coverage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per provider and source."""
    source = F.concat_ws(":", "provider", F.coalesce(F.nullif("source_section", F.lit("")), "provider"))
    return table(spark, sf_dir, "items").groupBy(source.alias("source")).agg(F.count("*").alias("rows"))


@query("select count(distinct item_id) as rows, true as same from items")
def o18_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are frozen with a checksum, verified, and the checksum doesn't depend on their order."""
    scratch = Scratch(spark, "release")
    items = items_now(spark, sf_dir).drop("domain_ids")
    manifest = releases.freeze(items, scratch.path(releases.next_id([], "items")))
    rows = releases.verify(spark, scratch.path("items-r1"))
    again = ids.release_checksum(rows.repartition(7, F.rand(1)).select(manifest["columns"]), manifest["columns"])
    return again.select("rows", (F.col("checksum") == manifest["checksum"]).alias("same"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _appended(rows: DataFrame) -> DataFrame:
    """What a stream appends to files until its sources are read: rows whose time the watermark has passed."""
    scratch = Scratch(rows.sparkSession, "stream")
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", scratch.path("rows")).option("checkpointLocation", scratch.path("state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(scratch.path("rows"))


_MARK = "(select max(ts) - interval 1 hour from events)"


@query(f"select event_type, cast(date_trunc('day', ts) as varchar) as day, count(*) as n, round(sum(value), 4) as total from events group by 1, 2 having max(date_trunc('day', ts)) + interval 1 day <= {_MARK}")
def st1_daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling event-time windows over a file stream, appended to files once the watermark has passed them."""
    counted = _appended(windows.counted(_stream(spark, sf_dir), "ts", ["event_type"], "1 day", value="value"))
    return counted.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", F.round("total", 4).alias("total"))


@query(f"with w as (select event_type, date_trunc('day', ts) - to_days(k::int) as s from events, range(7) r(k)) select event_type, cast(s as varchar) as start, count(*) as n from w where s + interval 7 day <= {_MARK} group by 1, 2, s")
def st4_sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of seven days, one a day, over a file stream."""
    counted = _appended(windows.counted(_stream(spark, sf_dir), "ts", ["event_type"], "7 days", slide="1 day"))
    return counted.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours then 1 else 0 end as cut from events), s as (select user_id, ts, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as k from g),
e as (select user_id, k, count(*) as n from s group by 1, 2 having max(ts) + interval 6 hours <= {_MARK}) select user_id, count(*) as sessions, sum(n)::bigint as events from e group by 1""")
def st5_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a pause of six hours over a file stream."""
    ended = _appended(windows.sessions(_stream(spark, sf_dir), "ts", "user_id", "6 hours"))
    return ended.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("select event_type, count(distinct user_id) as users from events group by 1")
def st6_deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type within the watermark, over a file stream that is read at once."""
    first = _appended(windows.deduplicated(_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "30 days"))
    return first.groupBy("event_type").agg(F.count("*").alias("users"))


@query("select user_id, cast(date_trunc('day', ts) as varchar) as day, count(*) as n, count(distinct event_type) as kinds from events group by 1, 2 having count(*) >= 5")
def st2_daily_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the daily window with a filter on the group."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    return rows.where("n >= 5").select("user_id", F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", "kinds")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours then 1 else 0 end as cut from events), s as (select user_id, ts, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, count(distinct k) as sessions from s group by 1""")
def st3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a pause of six hours."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query(f"""with {I_SQL}, r as (select item_id, provider, liked, row_number() over (partition by provider order by liked desc nulls last, item_id) as k from i) select provider, string_agg(item_id, ',' order by k) as best from r where k <= 2 group by 1""")
def s28_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report, two per provider."""
    rank = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc_nulls_last("liked"), "item_id"))
    top = items_now(spark, sf_dir).withColumn("k", rank).where("k <= 2")
    return top.groupBy("provider").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item_id"))), lambda x: x.item_id), ",").alias("best"))
