"""Stories from a stream of items, in order, and the merging of stories across providers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import urls

# Title similarities that join an item to a story, and the lead over the second best.
SIMILAR, SIMILAR_WITH_ENTITY, SHORT, LEAD = 0.72, 0.62, 0.85, 0.03
# Fixed values: (similarity, shared entities, shared words) that merge stories of different providers.
MERGES = [(0.82, 0, 0), (0.72, 2, 0), (0.60, 1, 3), (0.35, 2, 1)]


def prepared(items: DataFrame, scope: str, order: str) -> DataFrame:
    """Items (item_id, provider, url, target_url, title) with what the clusterer compares by; scope and order are columns."""
    joined = tx.normalized_title(F.col("title"))
    rows = items.select(F.col(scope).alias("scope"), F.col(order).alias("at"), "item_id", "provider", "title", "url", urls.url_set(F.col("url"), F.col("target_url")).alias("urls"), joined.alias("joined"))
    generic = tx.is_generic(F.col("joined")) | tx.is_low_signal(F.col("title"))
    return rows.withColumn("entities", tx.entities(F.col("title"))).withColumn("generic", generic).drop("title")


def similarity(a: str, b: str) -> float:
    """Six parts word overlap, four parts fuzzy ratio of two normalised titles."""
    one, two = set(a.split()), set(b.split())
    shared = len(one & two) / len(one | two) if one and two else 0.0
    return 0.6 * shared + 0.4 * tx.token_set_ratio(a, b)


def clustered(items: pd.DataFrame) -> list[int]:
    """Number of the story of each item, in the rows' order; an item joins a story or opens one.

    First by address; then, unless a title is generic, by the one story whose first title is
    similar enough and leads the second best; else a story of the same five first words.
    """
    stories: list[dict] = []
    by_url, by_word, by_key, out = {}, {}, {}, []
    for row in items.itertuples(index=False):
        links, words, entities = list(row.urls) or ([row.url] if row.url else []), row.joined.split(), set(row.entities)
        found = next((by_url[u] for u in links if u in by_url), None)
        if found is None and not row.generic:
            near = []
            for number in sorted({n for w in set(words) for n in by_word.get(w, ())}):
                story = stories[number]
                if story["generic"]:
                    continue
                value, known = similarity(row.joined, story["joined"]), bool(entities & story["entities"])
                if len(words) < 4 and not known and value < SHORT:
                    continue
                if value >= SIMILAR or (known and value >= SIMILAR_WITH_ENTITY):
                    near.append((-value, number))
            near.sort()
            if near and (len(near) == 1 or near[1][0] - near[0][0] >= LEAD):
                found = near[0][1]
        if found is None:
            key = f"url:{row.url or row.item_id}" if row.generic else " ".join(words[:5])
            found = by_key.get(key)
            if found is None:
                found = by_key[key] = len(stories)
                stories.append({"joined": row.joined, "generic": row.generic, "entities": set(), "words": set()})
                for link in links:
                    by_url[link] = found
        story = stories[found]
        story["entities"] |= entities
        for word in set(words) - story["words"]:
            by_word.setdefault(word, []).append(found)
        story["words"] |= set(words)
        out.append(found)
    return out


def story_clusters(rows: DataFrame) -> DataFrame:
    """(scope, item_id, story): stories of prepared rows, in order, ties by item; story is the first item's id.

    Which story an item joins depends on all items before it, so a scope (a run) is one
    group; runs are solved in parallel. A repeated item keeps its first place.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "item_id"], kind="stable", na_position="first").drop_duplicates("item_id")
        numbers = clustered(group)
        first = {}
        for number, item in zip(numbers, group["item_id"]):
            first.setdefault(number, item)
        return pd.DataFrame({"scope": group["scope"], "item_id": group["item_id"], "story": [first[n] for n in numbers]})

    kind = rows.schema["scope"].dataType.simpleString()
    return rows.where("scope is not null and item_id is not null").groupBy("scope").applyInPandas(solve, f"scope {kind}, item_id string, story string")


def merged_across(stories: pd.DataFrame) -> list[str]:
    """Story that each of the stories (story, joined, generic, entities, providers) goes into, in the rows' order.

    A story takes in each later one that adds a provider and shares a word, if similarity,
    shared entities and shared words reach one of the bounds. Only stories that share a
    word are compared.
    """
    rows = list(stories.itertuples(index=False))
    words = [set() if r.generic else set(r.joined.split()) for r in rows]
    by_word: dict[str, list[int]] = {}
    for k, own in enumerate(words):
        for word in own:
            by_word.setdefault(word, []).append(k)
    into = list(range(len(rows)))
    for i, row in enumerate(rows):
        if into[i] != i or not words[i]:
            continue
        providers = set(row.providers)
        for j in sorted({k for w in words[i] for k in by_word[w] if k > i}):
            other = rows[j]
            if into[j] != j or not providers or set(other.providers) <= providers:
                continue
            value, entities, shared = similarity(row.joined, other.joined), len(set(row.entities) & set(other.entities)), len(words[i] & words[j])
            if any(value >= least and entities >= named and shared >= told for least, named, told in MERGES):
                into[j] = i
                providers |= set(other.providers)
    return [rows[k].story for k in into]


def merged_stories(rows: DataFrame, stories: DataFrame) -> DataFrame:
    """(scope, story, into): stories (scope, item_id, story) of prepared rows merged across providers, in the order of their ids."""
    names = tx.PUBLISHERS.split("|")
    first = rows.select("scope", F.col("item_id").alias("story"), "joined", "generic", F.filter("entities", lambda e: ~e.isin(names)).alias("entities")).dropDuplicates(["scope", "story"])
    held = stories.join(rows.select("scope", "item_id", "provider"), ["scope", "item_id"]).groupBy("scope", "story").agg(F.collect_set("provider").alias("providers"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("story")
        return pd.DataFrame({"scope": group["scope"], "story": group["story"], "into": merged_across(group)})

    kind = rows.schema["scope"].dataType.simpleString()
    return first.join(held, ["scope", "story"]).groupBy("scope").applyInPandas(solve, f"scope {kind}, story string, into string")
