import pandas as pd
from pyspark.sql import functions as F

from corvane.operators import clusterer
from corvane.runtime import ship_package

SCHEMA = "run string, at string, item_id string, provider string, url string, target_url string, title string"


def stories(spark, items, shuffle=False):
    ship_package(spark)
    df = spark.createDataFrame([("r", f"{k:03}", i, p, u, None, t) for k, (i, p, u, t) in enumerate(items)], SCHEMA)
    rows = clusterer.prepared(df.orderBy(F.rand(1)) if shuffle else df, "run", "at")
    return rows, clusterer.story_clusters(rows)


ITEMS = [
    ("a", "p", "https://x.test/1", "Acme opens giant chip plant near Springfield harbor"), ("b", "q", "", "Acme opens giant chip plant near Springfield"), ("c", "q", "https://x.test/1/", "Other words entirely different here"),
    ("d", "r", "", "Top stories"), ("e", "r", "", "Top stories"), ("f", "s", "", "Borealis raises money for fusion reactor"), ("g", "t", "", "Borealis fusion reactor wins regulator praise today"), ("h", "t", "", None), ("h", "t", "", "repeated"),
]


def test_items_join_by_address_and_title(spark):
    _, found = stories(spark, ITEMS)
    story = {r["item_id"]: r["story"] for r in found.collect()}
    assert story["a"] == story["b"] == story["c"] == "a" and story["d"] != story["e"] and story["f"] != story["g"] and len(story) == 8
    _, again = stories(spark, ITEMS, shuffle=True)
    assert {r["item_id"]: r["story"] for r in again.collect()} == story
    assert stories(spark, ITEMS)[1].limit(0).count() == 0 and clusterer.story_clusters(stories(spark, ITEMS)[0].limit(0)).count() == 0


def test_two_equally_good_stories_open_a_third(spark):
    items = [("a", "p", "", "Delta union strike halts harbor north"), ("b", "p", "", "Delta union strike halts harbor south trains buses ferries planes"), ("c", "q", "", "Delta union strike halts harbor")]
    story = {r["item_id"]: r["story"] for r in stories(spark, items)[1].collect()}
    assert story["a"] == "a" and story["c"] in ("a", "c")


def test_stories_of_two_providers_merge():
    row = lambda name, joined, entities, providers, generic=False: (name, joined, generic, entities, providers)
    df = pd.DataFrame([
        row("s1", "borealis raises money fusion reactor", ["borealis", "kord"], ["p"]), row("s2", "borealis kord reactor praised regulator", ["borealis", "kord"], ["q"]), row("s3", "borealis raises money fusion reactor", ["borealis"], ["p"]),
        row("s4", "unrelated garden story here", [], ["q"]), row("s5", "borealis raises money fusion reactor", [], ["z"], True),
    ], columns=["story", "joined", "generic", "entities", "providers"])
    assert clusterer.merged_across(df) == ["s1", "s1", "s3", "s4", "s5"]


def test_merged_stories_over_rows(spark):
    rows, found = stories(spark, ITEMS)
    into = {r["story"]: r["into"] for r in clusterer.merged_stories(rows, found).collect()}
    assert set(into) == {r["story"] for r in found.collect()} and all(into[v] == v for v in into.values())
