import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import releases
from corvane.sources import landed, report


def test_json_lines_skip_broken(spark, tmp_path):
    (tmp_path / "posts.jsonl").write_text('{"post_id": "a", "score": 3, "unknown": 1}\n{broken\n{"post_id": "b"}\n')
    rows, broken = landed.read_json_lines(spark, str(tmp_path / "posts.jsonl"))
    assert {(r["post_id"], r["score"]) for r in rows.select("post_id", "score").collect()} == {("a", 3), ("b", None)}
    assert [r[0] for r in broken.collect()] == ["{broken"]


def test_listing_and_comments(spark):
    page = {"data": {"children": [
        {"kind": "t3", "data": {"id": "p", "title": "T", "subreddit": "s", "score": 4, "created_utc": 1761276408.0, "permalink": "/r/s/p", "selftext": "x" * 6000, "crosspost_parent_list": [{"id": "q", "subreddit": "o"}]}},
        {"kind": "more", "data": {"id": "m"}}]}}
    post = landed.posts_of_listing(spark.createDataFrame([(json.dumps(page),), ("{",), (None,)], "page string")).collect()
    assert len(post) == 1 and len(post[0]["selftext"]) == 5000 and post[0]["created_utc"] == "2025-10-24T03:26:48Z"
    assert post[0]["url"] == "https://forum.example/r/s/p" and post[0]["crosspost_parents"] == ["o/q"]
    comment = lambda i, s, body="b", sticky=False: {"kind": "t1", "data": {"id": i, "score": s, "body": body, "stickied": sticky}}
    both = [page, {"data": {"children": [comment("a", 1), comment("b", 9), comment("c", 5, "[removed]"), comment("d", 7, sticky=True), comment("e", 3)]}}]
    found = landed.comments_of_listing(spark.createDataFrame([("p", json.dumps(both))], "post_id string, page string"), most=2).first()
    assert [c["comment_id"] for c in found["comments"]] == ["b", "e"]


def test_feeds(spark):
    atom = '<feed><entry><title>One</title><link href="https://x/1"/><id>t/abc</id><updated>2025-10-24T00:00:00Z</updated><author><name>n</name></author><content>&lt;b&gt;hi&lt;/b&gt;</content></entry></feed>'
    rss = "<rss><channel><item><title>Two</title><link>https://x/2</link><guid>g</guid><description>d</description></item></channel></rss>"
    found = landed.feed_entries(spark.createDataFrame([(atom,), (rss,), ("<broken",)], "xml string")).collect()
    assert {(r["title"], r["url"], r["id"], r["summary"]) for r in found} == {("One", "https://x/1", "abc", "hi"), ("Two", "https://x/2", "g", "d")}


def test_pages(spark):
    html = '<title>A &amp; B</title><meta name="description" content="d"><a href="https://x.test/news/one?u=1">A title of some length</a><a href="https://x.test/news/one/">Again the same address</a><a href="https://x.test/s">short</a>'
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    title, description = landed.page_head(F.col("html"))
    assert tuple(df.where("id = 1").select(title, description).first()) == ("A & B", "d")
    assert [tuple(r) for r in landed.page_links(df, "id", "html").collect()] == [(1, "https://x.test/news/one", "A title of some length")]


def test_release_is_immutable_and_verified(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    path = str(tmp_path / "items-r1")
    releases.freeze(rows, path)
    assert releases.verify(spark, path).count() == 2
    with pytest.raises(releases.ReleaseError):
        releases.freeze(rows, path)
    rows.limit(1).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(releases.ReleaseError):
        releases.verify(spark, path)
    root = str(tmp_path)
    assert releases.published(spark, root, "radar") is None
    releases.publish(spark, root, "radar", "r1")
    releases.publish(spark, root, "radar", "r2")
    assert releases.rollback(spark, root, "radar") == "r1" == releases.published(spark, root, "radar")
    with pytest.raises(releases.ReleaseError):
        releases.publish(spark, root, "radar", "r3", passed=False)
    assert releases.next_id(["x-r1", "x-r4", "y-r9"], "x") == "x-r5"


def test_report(spark, tmp_path):
    report.write_report(str(tmp_path / "r.md"), "T", {"S": spark.createDataFrame([(1, "a|b")], "n int, s string")})
    assert "| 1 | a\\|b |" in (tmp_path / "r.md").read_text()
    assert json.loads(report.manifest({"a": "ok", "b": "error"})) == {"status": "partial", "failed": ["b"]}
