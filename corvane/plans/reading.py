"""Queries of the read functions: pages of stories, news and signals, and the radar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import classify
from corvane.operators import reading
from corvane.plans.base import I_SQL, day, day_sql, items_now, posts_now
from corvane.plans.serving import ORACLE as SERVING
from corvane.plans.serving import w4_direction, w7_lifecycle
from corvane.plans.texts import ORACLE as TEXTS
from corvane.plans.texts import SIGNAL_SQL, c32_pulse_score
from corvane.plans.views import ORACLE as VIEWS
from corvane.plans.views import c30_trend_score
from corvane.runtime import Scratch, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def story_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with what the read functions filter and sort by; direction is that of the last run a story was seen in."""
    items = table(spark, sf_dir, "items").where("dedupe_group_id <> ''")
    kept = lambda c: F.array_sort(F.collect_set(c))
    rows = items.groupBy(F.col("dedupe_group_id").alias("story")).agg(
        F.min("title").alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("domain_ids")))).alias("domains"), kept("provider").alias("providers"), kept("source_cluster").alias("clusters"),
        F.count_distinct("item_id").alias("items"), F.count_distinct("provider").alias("sources"), F.max("snapshot_date").alias("last_seen"),
    )
    rows = rows.withColumns({"pains": classify.pain_points(F.col("title")), "themes": F.array().cast("array<string>")})
    last = w4_direction(spark, sf_dir).groupBy("story").agg(F.max_by("direction", "day").alias("direction"))
    score = c30_trend_score(spark, sf_dir).withColumnRenamed("story_id", "story")
    return rows.join(score, "story").join(last, "story", "left")


_STORIES = f"""a as (select dedupe_group_id as story, min(title) as title, list_distinct(flatten(list(domain_ids))) as domains, list_distinct(list(provider)) as providers, count(distinct item_id) as items, count(distinct provider) as sources, max(snapshot_date) as last_seen from items where dedupe_group_id <> '' group by 1),
b as ({VIEWS["c30_trend_score"]}), c as (select story, max_by(direction, day) as direction from ({SERVING["w4_direction"]}) group by 1), stories as (select a.*, b.trend_score, b.confidence, c.direction from a join b on b.story_id = a.story left join c using (story))"""


@query(f"""with {_STORIES}, f as (select * from stories where list_contains(domains, 'ai') and direction = 'stable' and confidence = 'medium' and contains(lower(title), 'e'))
select story, items, sources, trend_score, (select count(*) from f) as total from f order by trend_score desc nulls last, story limit 10 offset 10""")
def f2_stories_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, T4: the second page of stories by domain, direction, confidence and text, the best first, with the total."""
    stories = Scratch(spark, "reading").save(story_table(spark, sf_dir), "stories")
    found = reading.stories_page(stories, domain="ai", direction="stable", confidence="medium", text="E", sort="score", page=2, size=10)
    return found.select("story", "items", "sources", "trend_score", "total")


@query(f"""with {_STORIES}, p as (select min(provider) as p from items where dedupe_group_id <> ''), f as (select * from stories where list_contains(providers, (select p from p)))
select story, items, sources, last_seen, (select count(*) from f) as total from f order by sources desc nulls last, items desc nulls last, story limit 15""")
def f2_stories_of_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a provider's stories, those of most sources first."""
    stories = Scratch(spark, "reading").save(story_table(spark, sf_dir), "stories")
    first = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").agg(F.min("provider")).first()[0]
    return reading.stories_page(stories, provider=first, sort="sources", size=15).select("story", "items", "sources", "last_seen", "total")


@query(f"""with {I_SQL}, t as (select i.*, (select max(published_at) from items x where x.item_id = i.item_id and x.snapshot_date = i.snapshot_date) as published_at from i), f as (select * from t where (snapshot_date = {day_sql(1)} or coalesce(starts_with(published_at, {day_sql(1)}), false)) and list_contains(domain_ids, 'business') and contains(lower(concat_ws(' ', title, excerpt)), 'a'))
select item_id, provider, snapshot_date, (select count(*) from f) as total from f order by snapshot_date desc, item_id limit 20""")
def f5_news_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's news of a domain by text, with the total."""
    when = table(spark, sf_dir, "items").groupBy("item_id", "snapshot_date").agg(F.max("published_at").alias("published_at"))
    items = items_now(spark, sf_dir).join(when, ["item_id", "snapshot_date"])
    return reading.news_page(items, day=day(spark, sf_dir, 1), domain="business", text="A").select("item_id", "provider", "snapshot_date", "total")


@query(f"""with g as ({SIGNAL_SQL}), c as ({TEXTS["c32_pulse_score"]}), f as (select g.post_id, c.pulse from g join c using (post_id) where signal_type in ('discussion')) select post_id, pulse, (select count(*) from f) as total from f order by pulse desc nulls last, post_id limit 20""")
def f6_signals_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discussions by pulse, with the total."""
    posts = posts_now(spark, sf_dir)
    kind = classify.signal_type(F.col("title"), F.col("selftext"), F.col("subreddit"), F.col("url"), F.col("is_self"))
    rows = posts.select("post_id", "title", F.lower("subreddit").alias("section"), kind.alias("kind"), "score", "num_comments").join(c32_pulse_score(spark, sf_dir).select("post_id", "pulse"), "post_id")
    signals = Scratch(spark, "reading").save(rows, "signals")
    return reading.signals_page(signals, kind="Discussion").select("post_id", "pulse", "total")


@query(f"""with w as ({SERVING["w7_lifecycle"]}), l as (select * from w where day = (select max(day) from w)), r as (select *, row_number() over (partition by lifecycle order by stories desc, trend) as k from l where lifecycle <> 'insufficient_history')
select lifecycle as shelf, k as place, trend, stories from r where k <= 2""")
def x34_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelves of the radar by the trends' lifecycle in the last run, two a shelf."""
    rows = w7_lifecycle(spark, sf_dir)
    last = rows.where(F.col("day") == rows.agg(F.max("day")).first()[0]).withColumn("domains", F.array("trend"))
    return reading.radar(last, most=2)
