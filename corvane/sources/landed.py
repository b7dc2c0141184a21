"""Landed files: JSON lines, listings, feeds and pages become typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema of landed posts.
POST = (
    "subreddit string, post_id string, title string, author string, created_utc string, score int, num_comments int, upvote_ratio double, url string, "
    "permalink string, selftext string, link_flair_text string, keyword string, is_self boolean, is_video boolean, over_18 boolean, stickied boolean, "
    "monitoring_type string, snapshot_date string, "
    "top_comments array<struct<comment_id: string, author: string, score: int, body: string, created_utc: string, is_submitter: boolean>>, crosspost_parents array<string>"
)
# The largest bodies kept of posts and comments.
POST_CHARS, COMMENT_CHARS = 5000, 2000
_LISTING = (
    "struct<data: struct<children: array<struct<kind: string, data: struct<id: string, title: string, author: string, subreddit: string, score: int, upvote_ratio: double, "
    "num_comments: int, url: string, permalink: string, selftext: string, link_flair_text: string, is_self: boolean, created_utc: double, stickied: boolean, body: string, is_submitter: boolean, crosspost_parent_list: array<struct<id: string, subreddit: string>>>>>>>"
)


def read_json_lines(spark: SparkSession, path: str, schema: str = POST) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): typed rows of JSON lines and the lines that are no such JSON. Unknown fields are dropped, missing ones null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("row"))
    bad = F.col("row").isNull() | F.col("row._broken").isNotNull()
    return parsed.where(~bad).select("row.*").drop("_broken"), parsed.where(bad).select("value")


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def posts_of_listing(pages: DataFrame, page: str = "page") -> DataFrame:
    """Posts (kind t3) of listing JSON texts; broken texts give none, bodies are capped."""
    child = pages.select(F.explode(F.from_json(page, _LISTING).data.children).alias("c")).where("c.kind = 't3'").select("c.data.*")
    parents = F.transform(F.coalesce("crosspost_parent_list", F.array().cast("array<struct<id:string,subreddit:string>>")), lambda p: F.concat_ws("/", p.subreddit, p.id))
    return child.select(
        F.col("id").alias("post_id"), "subreddit", "title", "author", "score", "num_comments", "upvote_ratio", absolute_url(F.col("url"), F.col("permalink")).alias("url"), "permalink",
        F.substring("selftext", 1, POST_CHARS).alias("selftext"), "link_flair_text", "is_self", iso_utc(F.col("created_utc")).alias("created_utc"), F.coalesce("stickied", F.lit(False)).alias("stickied"), parents.alias("crosspost_parents"),
    )


def comments_of_listing(pages: DataFrame, page: str = "page", key: str = "post_id", most: int = 5) -> DataFrame:
    """(key, comments): the best comments (kind t1) of each page; removed, deleted, empty and sticky ones are left out."""
    both = F.from_json(page, f"array<{_LISTING}>")
    rows = pages.select(key, F.explode(F.element_at(both, 2).data.children).alias("c")).where("c.kind = 't1'").select(key, "c.data.*")
    rows = rows.where(~F.coalesce("stickied", F.lit(False)) & ~F.coalesce("body", F.lit("")).isin("", "[removed]", "[deleted]"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "id"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    comment = F.struct("rank", F.col("id").alias("comment_id"), "author", "score", F.substring("body", 1, COMMENT_CHARS).alias("body"))
    return top.groupBy(key).agg(F.array_sort(F.collect_list(comment)).alias("comments"))  # at most `most` a key


def absolute_url(url: Column, permalink: Column, site: str = "https://forum.example") -> Column:
    """A relative or missing address falls back to the permalink on the site."""
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(site), permalink))


def feed_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(title, url, id, published, author, summary) of RSS 2.0 items, or else Atom entries; a broken feed gives none."""
    schema = (
        "channel struct<item: array<struct<title: string, link: string, guid: string, pubDate: string, author: string, description: string>>>, "
        "entry array<struct<title: string, link: struct<_href: string>, id: string, published: string, updated: string, author: struct<name: string>, content: string, summary: string>>"
    )
    parsed = feeds.select(F.from_xml(xml, schema, {"mode": "PERMISSIVE"}).alias("f"))
    rss = F.transform(F.coalesce("f.channel.item", F.array().cast("array<struct<title:string,link:string,guid:string,pubDate:string,author:string,description:string>>")), lambda i: F.struct(i.title.alias("title"), i.link.alias("url"), i.guid.alias("id"), i.pubDate.alias("published"), i.author.alias("author"), i.description.alias("summary")))
    atom = F.transform("f.entry", lambda e: F.struct(e.title.alias("title"), e.link._href.alias("url"), F.element_at(F.split(e.id, "/"), -1).alias("id"), F.coalesce(e.published, e.updated).alias("published"), e.author.getField("name").alias("author"), F.coalesce(e.content, e.summary).alias("summary")))
    return parsed.select(F.explode(F.when(F.size(rss) > 0, rss).otherwise(atom)).alias("e")).select("e.*").withColumn("summary", without_tags(F.col("summary")))


def without_tags(html: Column) -> Column:
    """Text of HTML: tags become blanks, the usual entities their characters, runs of blanks one blank."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_head(html: Column) -> tuple[Column, Column]:
    """(title, description) of an HTML page."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    description = F.regexp_extract(html, r"""(?is)<meta\s+[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1)
    return without_tags(title), without_tags(description)


def page_links(pages: DataFrame, key: str, html: str, article: str = r"^https?://[^/]+/.+", least_title: int = 15) -> DataFrame:
    """(key, url, title): article links of HTML pages, without parameters, the first of each address, titles of some length."""
    anchor = r"""(?is)<a\s[^>]*href=["'][^"']+["'][^>]*>.*?</a>"""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(anchor), F.lit(0))).alias("position", "a"))
    rows = rows.select(key, "position", F.regexp_replace(F.regexp_extract("a", r"""href=["']([^"'#?]+)""", 1), "/+$", "").alias("url"), without_tags(F.col("a")).alias("title"))
    rows = rows.where(F.col("url").rlike(article) & (F.char_length("title") >= least_title))
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy("position"))
    return rows.withColumn("n", first).where("n = 1").select(key, "url", "title")


#: Words of feed addresses and their sections, in order.
FEED_SECTIONS = [("world", "world"), ("politic", "politics"), ("business", "business"), ("tech", "technology"), ("science", "science"), ("health", "health"), ("sport", "sports"), ("art", "arts"), ("opinion", "opinion")]


def feed_section(url: Column) -> Column:
    """Section of a feed's address by its words; top without any."""
    low, out = F.lower(url), F.when(F.lit(False), "")
    for word, section in FEED_SECTIONS:
        out = out.when(low.contains(word), section)
    return out.otherwise("top")


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keeps the first row per key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def thread_deltas(now: DataFrame, before: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, new_comments, score_delta, state): against the state before; what is missing now keeps its state."""
    old = before.select(key, F.col("score").alias("old_score"), F.col("num_comments").alias("old_comments"))
    joined = now.select(key, "score", "num_comments", F.lit(True).alias("_now")).join(old, key, "full")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("old_score").isNull() & F.col("old_comments").isNull(), "new").otherwise("seen")
    grown = F.greatest(F.lit(0), F.coalesce(F.col("num_comments") - F.col("old_comments"), F.lit(0)))
    return joined.select(key, grown.alias("new_comments"), F.coalesce(F.col("score") - F.col("old_score"), F.lit(0)).alias("score_delta"), state.alias("state"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_first: list[str]) -> DataFrame:
    """old with new's rows put over it by key; the columns keep_first keep their older value if there is one."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.select(*keys, F.struct(*rest).alias("o")).join(new.select(*keys, F.struct(*rest).alias("n")), keys, "full")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep_first else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*keys, *(pick(c).alias(c) for c in rest))


def only_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows whose key isn't in old."""
    return new.join(old.select(*keys), keys, "left_anti")


def with_defaults(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema in its order; those a file lacks are null."""
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def run_status(health: DataFrame) -> DataFrame:
    """(run_id, status): complete if all sources are ok or empty, pending if any is, else partial."""
    ok, waiting = F.bool_and(F.col("status").isin("ok", "empty")), F.bool_or(F.col("status") == "pending")
    return health.groupBy("run_id").agg(F.when(ok, "complete").when(waiting, "pending").otherwise("partial").alias("status"))
