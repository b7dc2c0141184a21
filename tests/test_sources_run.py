import json

import pytest

from corvane.sources import adapters
from corvane.sources.items import to_items
from corvane.sources.landed import POST
from corvane.streaming import windows


def posts(spark, rows):
    return spark.createDataFrame([{**dict.fromkeys(("post_id", "title", "url", "selftext", "keyword", "permalink")), **r} for r in rows], POST)


def test_items_of_forum_posts(spark):
    rows = [
        {"post_id": "1", "subreddit": "r", "url": "http://m.bbc.com/news/x/?utm_source=a", "permalink": "/r/1", "is_self": False, "title": "OpenAI chips", "score": 5, "num_comments": 2, "upvote_ratio": 0.9},
        {"post_id": "2", "subreddit": "r", "url": "https://forum.example/r/2", "permalink": "/r/2", "is_self": True, "title": None, "selftext": "words " * 2000},
        {"post_id": None, "subreddit": "r", "url": "", "permalink": "https://forum.example/r/3"},
    ]
    found = {r["external_id"] if r["external_id"] in "12" else "3": r for r in to_items(posts(spark, rows), "posts.jsonl", "2025-01-01T00:00:00Z").collect()}
    assert found["1"]["item_id"] == "forum:1" and found["1"]["canonical_url"] == "https://www.bbc.com/news/x" and found["1"]["discussion_url"] == "https://forum.example/r/1"
    assert found["1"]["raw_engagement"] == {"score": 5.0, "comments": 2.0, "upvote_ratio": 0.9} and found["1"]["domain_ids"] == ["ai_technology"] and found["1"]["content_scope"] == "headline"
    assert found["2"]["canonical_url"] == "https://forum.example/r/2" and len(found["2"]["excerpt"]) == 12000 and found["2"]["content_scope"] == "excerpt" and found["2"]["raw_engagement"]["score"] == 0.0
    assert found["3"]["canonical_url"] == "https://forum.example/r/3" and len(found["3"]["external_id"]) == 24
    assert to_items(posts(spark, rows).limit(0), "posts.jsonl", "").count() == 0


@pytest.mark.parametrize(("file", "section", "provider", "cluster"), [("rss.jsonl", "The Verge", "theverge", "tech_culture"), ("ladder.jsonl", "Own-Paper", "own-paper", "mainstream"), ("hackernews.jsonl", "x", "hackernews", "developers"), ("other.jsonl", "x", "unknown", "mainstream")])
def test_providers_of_files(spark, file, section, provider, cluster):
    row = to_items(posts(spark, [{"post_id": "1", "subreddit": section, "url": "https://a.test/b", "selftext": "t", "score": 3, "keyword": "world"}]), file, "").first()
    assert (row["provider"], row["source_cluster"], row["content_scope"]) == (provider, cluster, "abstract")
    assert row["source_section"] == ("world" if file in ("rss.jsonl", "ladder.jsonl") else section) and row["raw_engagement"].get("points") == (3.0 if file == "hackernews.jsonl" else None)


def test_day_of_files(spark, tmp_path):
    line = lambda **r: json.dumps({"subreddit": "s", "permalink": "/p", **r})
    (tmp_path / "posts.jsonl").write_text("\n".join([line(post_id="1", title="a"), "{broken", line(post_id="2", title="b"), ""]))
    (tmp_path / "keyword-search.jsonl").write_text(line(post_id="1", title="later", keyword="k"))
    items, broken = adapters.items_of_day(spark, str(tmp_path), ["posts.jsonl", "keyword-search.jsonl"], "t")
    assert broken == 1 and {r["item_id"]: r["title"] for r in items.collect()} == {"forum:1": "a", "forum:2": "b"}


def test_adapters_and_fallback(spark):
    def fails(_):
        raise RuntimeError("closed")

    rows, health = adapters.run_adapters(spark, {"a": lambda s: s.range(3), "b": fails, "c": lambda s: s.range(0)}, ["a", "b", "c", "d"])
    assert {r["source"]: (r["status"], r["rows"], r["error"]) for r in health.collect()} == {"a": ("ok", 3, ""), "b": ("error", 0, "closed"), "c": ("empty", 0, ""), "d": ("skipped", 0, "")} and set(rows) == {"a", "c"}
    empty = spark.createDataFrame([], "id bigint, score int, num_comments int")
    assert adapters.with_fallback([empty, empty], lambda s: s.range(2), spark).count() == 2 and adapters.with_fallback([empty, spark.range(1)], fails, spark).count() == 1


def test_deltas_keep_state_between_batches(spark, tmp_path):
    schema = "post_id string, at bigint, score bigint, num_comments bigint"
    for k, rows in enumerate([[("a", 1, 10, 5), ("b", 1, 1, 0)], [("a", 2, 12, 9), ("a", 3, 11, 8)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    out = []
    for k in range(2):
        spark.read.parquet(f"{tmp_path}/in{k}").write.mode("append").parquet(f"{tmp_path}/in")
        stream = windows.deltas(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        writer = stream.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect()))
        writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [("a", 0, -1), ("a", 0, 0), ("a", 4, 2), ("b", 0, 0)]
