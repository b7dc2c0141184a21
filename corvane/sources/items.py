"""Posts of landed files become items of the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import classify, urls

# Provider and cluster of a landed file, and the cluster of a feed's publisher.
FILES = {"posts.jsonl": ("forum", "voices"), "keyword-search.jsonl": ("forum", "voices"), "hackernews.jsonl": ("hackernews", "developers"), "producthunt.jsonl": ("producthunt", "product_pulse")}
FEED_FILES = ("rss.jsonl", "ladder.jsonl")
PUBLISHER_CLUSTERS = {
    "bbc": "mainstream", "guardian": "mainstream", "reuters": "business", "techcrunch": "tech_culture", "theverge": "tech_culture", "verge": "tech_culture", "arstechnica": "tech_culture", "nytimes": "mainstream",
    "washingtonpost": "mainstream", "time": "mainstream", "usatoday": "mainstream", "ft": "business", "americanbanker": "business", "foxbusiness": "business", "wired": "tech_culture", "newyorker": "tech_culture",
    "vanityfair": "tech_culture", "medium": "voices", "foxnews": "mainstream",
}
# The measures that a provider counts likes by.
LIKES = {"forum": "score", "hackernews": "points", "producthunt": "votes"}


def source_of(file: str, section: Column) -> tuple[Column, Column]:
    """(provider, cluster) of a row of a landed file; feeds are told apart by their section."""
    if file in FILES:
        return tuple(F.lit(v) for v in FILES[file])
    if file not in FEED_FILES:
        return F.lit("unknown"), F.lit("mainstream")
    key = F.regexp_replace(F.lower(section), "[ _-]", "")
    known = F.create_map(*(F.lit(x) for pair in PUBLISHER_CLUSTERS.items() for x in pair))
    cluster = F.try_element_at(known, key)
    return F.when(cluster.isNotNull(), key).otherwise(F.lower(section)), F.coalesce(cluster, F.lit("mainstream"))


def to_items(posts: DataFrame, file: str, observed_at: str, site: str = "https://forum.example") -> DataFrame:
    """Items of typed posts (schema landed.POST) of a landed file.

    A forum post that links elsewhere stands for the page it links to, others for their
    discussion. Texts are kept whole. Null texts are empty, null figures 0; a row without an
    id is named by its address. Domains and the group id are derived.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    provider, cluster = source_of(file, F.col("subreddit"))
    forum, feed = file in FILES and FILES[file][0] == "forum", file in FEED_FILES
    rows = posts.withColumns({"provider": provider, "source_cluster": cluster, "target_url": urls.canonical_url(empty("url"))})
    permalink = F.when(F.col("permalink").startswith("http"), F.col("permalink")).otherwise(F.concat(F.lit(site), empty("permalink")))
    rows = rows.withColumn("discussion_url", urls.canonical_url(permalink) if forum else F.lit(""))
    outside = (F.col("target_url") != "") & ~F.col("target_url").startswith(site) & ~F.coalesce("is_self", F.lit(False))
    address = F.when(outside, F.col("target_url")).otherwise(F.col("discussion_url")) if forum else F.col("target_url")
    rows = rows.withColumn("canonical_url", address).withColumn("excerpt", empty("selftext"))
    own = F.when(empty("post_id") != "", F.col("post_id")).otherwise(F.substring(F.sha2("canonical_url", 256), 1, 24))
    rows = rows.withColumn("external_id", own).withColumn("item_id", F.concat_ws(":", "provider", "external_id"))
    likes = LIKES.get(FILES.get(file, ("",))[0])
    figures = {likes: "score", "comments": "num_comments"} if likes else {}
    measured = F.create_map(*(x for name, column in figures.items() for x in (F.lit(name), F.coalesce(F.col(column).cast("double"), F.lit(0.0))))) if figures else F.create_map().cast("map<string,double>")
    if forum:
        measured = F.map_concat(measured, F.create_map(F.lit("upvote_ratio"), F.coalesce("upvote_ratio", F.lit(0.0))))
    scope = F.when(F.col("excerpt") == "", "headline").otherwise("excerpt" if forum else "abstract")
    section = F.when(empty("keyword") != "", F.col("keyword")).otherwise(F.col("subreddit")) if feed else F.col("subreddit")
    rows = rows.withColumns({"raw_engagement": measured, "content_scope": scope, "source_section": section, "published_at": F.col("created_utc"), "observed_at": F.lit(observed_at)})
    rows = rows.withColumn("dedupe_group_id", F.concat(F.lit("dedupe_"), F.substring(F.sha2(F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.col("item_id")), 256), 1, 20)))
    rows = classify.with_domains(rows, "title", "excerpt", "domain_ids")
    return rows.select(
        "item_id", "provider", "source_cluster", "external_id", "canonical_url", "title", "excerpt", "author", "published_at", "observed_at", "snapshot_date", "content_scope", "source_section", "domain_ids",
        "discussion_url", "target_url", "dedupe_group_id", "raw_engagement", F.to_json(F.struct("monitoring_type", "keyword", "is_self", "link_flair_text")).alias("metadata"),
    )
