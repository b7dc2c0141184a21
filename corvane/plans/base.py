"""Current rows of the content tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.latest import latest
from corvane.runtime import table

POST_COLUMNS = ["score", "num_comments", "upvote_ratio", "subreddit", "title", "author", "url", "selftext", "link_flair_text", "is_self", "stickied", "keyword", "created_utc", "snapshot_date"]
ITEM_COLUMNS = ["provider", "source_cluster", "title", "excerpt", "author", "source_section", "language", "content_scope", "dedupe_group_id", "target_url", "domain_ids"]


def day(spark: SparkSession, sf_dir: str, back: int = 0) -> str:
    """Date of the last snapshot, or of the one so many before it."""
    rows = table(spark, sf_dir, "snapshots").orderBy(F.desc("snapshot_id")).select("snapshot_date").limit(back + 1).collect()
    return rows[-1][0] if rows else ""


def snapshot(spark: SparkSession, sf_dir: str, back: int = 0) -> int:
    """Number of the last snapshot, or of the one so many before it."""
    rows = table(spark, sf_dir, "snapshots").orderBy(F.desc("snapshot_id")).select("snapshot_id").limit(back + 1).collect()
    return rows[-1][0] if rows else 0


def day_sql(back: int = 0) -> str:
    return f"(select snapshot_date from snapshots order by snapshot_id desc limit 1 offset {back})"


def snapshot_sql(back: int = 0) -> str:
    return f"(select snapshot_id from snapshots order by snapshot_id desc limit 1 offset {back})"


def posts_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot's posts, one row each: the latest delivery."""
    posts = table(spark, sf_dir, "posts")
    last = posts.agg(F.max("snapshot_id")).first()[0]
    return latest(posts.where(F.col("snapshot_id") == last), ["post_id"], ["ingested_at"], POST_COLUMNS)


def items_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items, one row each: the latest batch's."""
    items = table(spark, sf_dir, "items")
    items = items.withColumn("liked", F.coalesce(*(F.try_element_at("raw_engagement", F.lit(k)) for k in ("score", "points", "votes"))))
    items = items.withColumn("discussed", F.try_element_at("raw_engagement", F.lit("comments")))
    return latest(items, ["item_id"], ["snapshot_date", "canonical_url", "observed_at"], ["snapshot_date", "canonical_url", "liked", "discussed", *ITEM_COLUMNS])


P_SQL = f"""p as (select post_id, {', '.join(POST_COLUMNS)} from (
  select *, row_number() over (partition by post_id order by ingested_at desc, score desc nulls last) as rn
  from posts where snapshot_id = (select max(snapshot_id) from posts)) where rn = 1)"""
I_SQL = f"""i as (select item_id, snapshot_date, canonical_url, liked, discussed, {', '.join(ITEM_COLUMNS)} from (
  select *, coalesce(raw_engagement['score'], raw_engagement['points'], raw_engagement['votes']) as liked, raw_engagement['comments'] as discussed,
    row_number() over (partition by item_id order by snapshot_date desc, canonical_url desc nulls last, observed_at desc nulls last) as rn
  from items) where rn = 1)"""

#: Pairs with their best score, and a label that doesn't come from it: whether both items' last batches name the same first domain.
LABELLED_SQL = f"""{I_SQL}, labelled as (select l.*, x.domain_ids[1] = y.domain_ids[1] as label from (select item_id_a, item_id_b, max(score) as score, max_by(signals_json, score) as signals from cluster_candidate_pairs where score is not null and item_id_a <> item_id_b group by 1, 2) l
join i x on x.item_id = item_id_a join i y on y.item_id = item_id_b where x.domain_ids[1] is not null and y.domain_ids[1] is not null)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id_a, item_id_b, score, signals, label) as in LABELLED_SQL."""
    rows = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null and item_id_a <> item_id_b")
    rows = rows.groupBy("item_id_a", "item_id_b").agg(F.max("score").alias("score"), F.max_by("signals_json", "score").alias("signals"))
    first = items_now(spark, sf_dir).select("item_id", F.try_element_at("domain_ids", F.lit(1)).alias("d")).where("d is not null")
    rows = rows.join(first.toDF("item_id_a", "x"), "item_id_a").join(first.toDF("item_id_b", "y"), "item_id_b")
    return rows.select("item_id_a", "item_id_b", "score", "signals", (F.col("x") == F.col("y")).alias("label"))
