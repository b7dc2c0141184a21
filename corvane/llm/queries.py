"""Queries of the training-data problems tagged llm, over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.capping import over_share
from corvane.llm.encoding import count_tokens, encode, vocabulary_path
from corvane.llm.groups import group_items
from corvane.llm.history import known_items
from corvane.llm.lookalikes import identical_looking, looking_members, normalize, spellings, text_forms
from corvane.llm.neardup import near_duplicate_members, near_duplicate_pairs
from corvane.llm.packing import pack
from corvane.llm.pii import find_pii, known_names, ordinary_words, redact
from corvane.functions.pages import page_key
from corvane.operators.latest import latest
from corvane.runtime import Scratch, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every linked item within its experiment."""
    return group_items(table(spark, sf_dir, "cluster_candidate_pairs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose words have at least 0.6 in common."""
    return near_duplicate_pairs(table(spark, sf_dir, "items").select("item_id", "title", "excerpt"))


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item the smallest id with its text, and with any text that near-duplicates link to it."""
    return near_duplicate_members(table(spark, sf_dir, "items").select("item_id", "title", "excerpt"))


def free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, text) of the fields with personal information."""
    of = lambda name, field, key: table(spark, sf_dir, name).select(
        F.lit(f"{name}.{field}").alias("field_name"), F.col(key).alias("record_id"), F.col(field).alias("text")
    )
    return of("comments", "body", "comment_id").unionByName(of("comments", "author", "comment_id")).unionByName(of("posts", "selftext", "post_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of personal information."""
    texts = free_texts(spark, sf_dir)
    known = known_names(table(spark, sf_dir, "person_names"))
    return find_pii(texts, known, ordinary_words(texts, known))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct texts with placeholders for what p4_found finds."""
    texts = free_texts(spark, sf_dir)
    known = known_names(table(spark, sf_dir, "person_names"))
    return redact(texts.distinct(), known, ordinary_words(texts, known))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that an accepted item of an earlier batch already covers."""
    items = table(spark, sf_dir, "items").select("snapshot_date", "item_id", "dedupe_group_id", "canonical_url", "title", "excerpt")
    exact = [F.col("item_id"), F.nullif("dedupe_group_id", F.lit("")), page_key(F.col("canonical_url"))]
    return known_items(items, "snapshot_date", "item_id", ["title", "excerpt"], exact)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to drop from the last snapshot so that no contributor holds more than 2 %."""
    posts = table(spark, sf_dir, "posts").select("snapshot_id", "post_id", "ingested_at", "subreddit", "score")
    last = posts.agg(F.max("snapshot_id")).first()[0]
    posts = latest(posts.where(F.col("snapshot_id") == last), ["post_id"], ["ingested_at"], ["score", "subreddit"])
    forum = F.regexp_replace(F.lower(F.trim("subreddit")), "^r/", "")
    posts = posts.select(F.nullif(forum, F.lit("")).alias("contributor"), F.col("post_id").alias("record_id"), F.col("score").alias("quality"))
    items = table(spark, sf_dir, "items").select("snapshot_date", "item_id", "provider", "raw_engagement")
    last = items.agg(F.max("snapshot_date")).first()[0]
    liked = F.coalesce(*(F.try_element_at("raw_engagement", F.lit(k)) for k in ("score", "points", "votes")))
    items = items.where(F.col("snapshot_date") == last).select("item_id", "provider", F.nanvl(liked, F.lit(None).cast("double")).alias("quality"))
    items = items.groupBy(F.col("item_id").alias("record_id")).agg(F.max("provider").alias("contributor"), F.max("quality").alias("quality"))
    named = lambda df, name: df.select(F.lit(name).alias("field_name"), "record_id")
    return named(over_share(posts), "posts.subreddit").unionByName(named(over_share(items), "items.provider"))


P7_SQL = """
with p as (
  select 'posts.subreddit' as field_name, post_id as record_id,
    nullif(regexp_replace(lower(trim(arg_max({'s': subreddit}, ingested_at).s)), '^r/', ''), '') as contributor,
    cast(arg_max({'s': score}, ingested_at).s as double) as quality
  from posts where snapshot_id = (select max(snapshot_id) from posts) group by post_id),
i as (
  select 'items.provider' as field_name, item_id as record_id, max(provider) as contributor,
    max(coalesce(raw_engagement['score'], raw_engagement['points'], raw_engagement['votes'])) as quality
  from items where snapshot_date = (select max(snapshot_date) from items) group by item_id),
r as (select * from p union all select * from i),
n as (select *, row_number() over (partition by field_name, contributor order by quality desc nulls last, record_id) as k,
  count(*) over (partition by field_name) as total from r)
select field_name, record_id from n where contributor is not null and k > greatest(1, (total * 2) // 100)
"""

def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path("byte_bpe_50k"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or part of one, for each capacity in pack_targets."""
    targets = table(spark, sf_dir, "pack_targets").orderBy("target_id").collect()  # a few capacities
    documents, scratch, out = table(spark, sf_dir, "documents"), Scratch(spark, "packing"), None
    counted = {name: scratch.save(count_tokens(documents, "doc_id", "text", vocabulary_path(name)), f"tokens-{name}") for name in sorted({t["tokenizer"] for t in targets})}
    for t in targets:
        packed = pack(counted[t["tokenizer"]], "doc_id", t["capacity_tokens"], t["target_id"])
        out = packed if out is None else out.unionByName(packed)
    return out


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look the same and aren't the same characters."""
    documents, scratch = table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "lookalikes")
    return identical_looking(scratch.save(text_forms(documents, "doc_id", "text", 12, spellings(documents, "text")), "forms"), "doc_id")


def p10_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document of more than 12 characters the smallest id with its very text and with its look."""
    documents, scratch = table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "lookalikes")
    return looking_members(scratch.save(text_forms(documents, "doc_id", "text", 12, spellings(documents, "text")), "forms"), "doc_id")


def p10_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return normalize(documents, "doc_id", "text", spellings(documents, "text")).select("doc_id", "canonical")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_members": p3_members, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_packed": p9_packed, "p10_found": p10_found, "p10_members": p10_members, "p10_text": p10_text}
ORACLE = {"p7_found": P7_SQL}
