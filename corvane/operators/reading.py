"""Pages of stories, news and signals by filters, and the shelves of a radar: parameters in, a DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STORY_SORTS = {"score": ["-trend_score"], "recent": ["-last_seen"], "items": ["-items"], "sources": ["-sources", "-items"]}
SIGNAL_SORTS = {"pulse": ["-pulse"], "score": ["-score"], "comments": ["-num_comments"]}
#: Shelves of a radar, in order, by a trend's lifecycle.
SHELVES = ("growing", "new", "resurfacing", "stable", "fading")


def _order(keys: list[str], last: str) -> list[Column]:
    return [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_first(k) for k in keys] + [F.col(last)]


def _all(rules: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, (r for r in rules if r is not None), F.lit(True))


def _has(column: str, value: str | None) -> Column | None:
    return None if value is None else F.coalesce(F.array_contains(column, value), F.lit(False))


def _is(column: str, value: str | None) -> Column | None:
    return None if value is None else F.lower(column) == value.lower()


def _contains(text: str | None, *columns: str) -> Column | None:
    return None if not text else F.lower(F.concat_ws(" ", *columns)).contains(text.lower())


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of a page, counted from 1, with `total`, the number of rows of all pages."""
    if page < 1 or size < 1:
        raise ValueError("pages and their size begin with 1")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(rows.agg(F.count("*").alias("total")))  # one row


def stories_page(
    stories: DataFrame, *, domain: str | None = None, provider: str | None = None, cluster: str | None = None, direction: str | None = None, confidence: str | None = None, pain: str | None = None,
    theme: str | None = None, text: str | None = None, sort: str = "score", page: int = 1, size: int = 20,
) -> DataFrame:
    """A page of stories (story, title, domains, providers, clusters, pains, themes, items, sources, last_seen, trend_score, direction, confidence)."""
    rules = [_has("domains", domain), _has("providers", provider), _has("clusters", cluster), _has("pains", pain), _has("themes", theme), _is("direction", direction), _is("confidence", confidence), _contains(text, "title")]
    return page_of(stories.where(_all(rules)), _order(STORY_SORTS[sort], "story"), page, size)


def news_page(
    items: DataFrame, *, day: str | None = None, domain: str | None = None, provider: str | None = None, cluster: str | None = None, text: str | None = None, page: int = 1, size: int = 20
) -> DataFrame:
    """A page of items (item_id, title, excerpt, provider, source_cluster, domain_ids, published_at, snapshot_date), the latest first; a day is the batch's or the publication's."""
    on = None if day is None else (F.col("snapshot_date") == day) | F.coalesce(F.col("published_at").startswith(day), F.lit(False))
    rules = [on, _has("domain_ids", domain), _is("provider", provider), _is("source_cluster", cluster), _contains(text, "title", "excerpt")]
    return page_of(items.where(_all(rules)), _order(["-snapshot_date"], "item_id"), page, size)


def signals_page(signals: DataFrame, *, kind: str | None = None, section: str | None = None, text: str | None = None, sort: str = "pulse", page: int = 1, size: int = 20) -> DataFrame:
    """A page of signals (post_id, title, section, kind, pulse, score, num_comments)."""
    return page_of(signals.where(_all([_is("kind", kind), _is("section", section), _contains(text, "title")])), _order(SIGNAL_SORTS[sort], "post_id"), page, size)


def radar(trends: DataFrame, domain: str | None = None, most: int = 6) -> DataFrame:
    """(shelf, place, trend, stories) of trends (trend, lifecycle, stories, domains): the largest of each lifecycle; other lifecycles have no shelf."""
    rows = trends.where(_all([_has("domains", domain)])).where(F.col("lifecycle").isin(*SHELVES))
    place = F.row_number().over(Window.partitionBy("lifecycle").orderBy(F.desc("stories"), "trend"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(F.col("lifecycle").alias("shelf"), "place", "trend", "stories")
