import pytest

from corvane.operators import reading

SCHEMA = "story string, title string, domains array<string>, providers array<string>, clusters array<string>, pains array<string>, themes array<string>, items int, sources int, last_seen string, trend_score double, direction string, confidence string"


def stories(spark):
    rows = [
        ("a", "Alpha beta", ["ai"], ["p", "q"], ["c"], [], [], 3, 2, "2025-01-02", 50.0, "new", "high"), ("b", "Gamma", ["ai", "art"], ["p"], ["d"], ["burnout"], ["t"], 9, 1, "2025-01-01", None, None, "low"),
        ("c", None, None, None, None, None, None, None, None, None, 50.0, "stable", None), ("d", "beta delta", ["art"], ["q"], ["c"], [], [], 1, 1, "2025-01-03", 70.0, "new", "low"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("how", "expected"), [
    ({}, "dacb"), ({"domain": "ai"}, "ab"), ({"provider": "q"}, "da"), ({"cluster": "c", "direction": "NEW"}, "da"), ({"confidence": "low", "sort": "items"}, "bd"), ({"pain": "burnout"}, "b"), ({"theme": "t"}, "b"),
    ({"text": "BETA"}, "da"), ({"sort": "recent"}, "dabc"), ({"sort": "sources"}, "abdc"), ({"page": 2, "size": 2}, "cb"), ({"page": 9, "size": 2}, ""), ({"domain": "none"}, ""),
])
def test_pages_of_stories(spark, how, expected):
    found = reading.stories_page(stories(spark), **how).collect()
    assert "".join(r["story"] for r in sorted(found, key=lambda r: expected.index(r["story"]))) == expected and len(found) == len(expected)
    whole = reading.stories_page(stories(spark), **{k: v for k, v in how.items() if k not in ("page", "size")}).count()
    assert all(r["total"] == whole for r in found)


def test_pages_keep_their_order_and_refuse_nonsense(spark):
    order = [r["story"] for r in reading.stories_page(stories(spark)).orderBy("trend_score").collect()]
    assert set(order) == set("abcd")
    with pytest.raises(ValueError):
        reading.stories_page(stories(spark), page=0)
    with pytest.raises(KeyError):
        reading.stories_page(stories(spark), sort="chance")
    assert reading.stories_page(stories(spark).limit(0)).count() == 0


def test_news_signals_and_radar(spark):
    news = spark.createDataFrame([("i", "t", None, "p", "c", ["ai"], "2025-01-01T00:00:00Z", "2025-01-02"), ("j", None, "Text", "p", "c", None, None, "2025-01-01"), ("k", "x", "y", None, None, [], "bad", None)], "item_id string, title string, excerpt string, provider string, source_cluster string, domain_ids array<string>, published_at string, snapshot_date string")
    ids = lambda **how: {r["item_id"] for r in reading.news_page(news, **how).collect()}
    assert ids(day="2025-01-01") == {"i", "j"} and ids(domain="ai") == {"i"} and ids(text="tex") == {"j"} and ids(provider="P", cluster="c") == {"i", "j"} and ids() == {"i", "j", "k"}
    signals = spark.createDataFrame([("1", "A", "s", "question", 5.0, 1, 2), ("2", None, None, None, None, None, None)], "post_id string, title string, section string, kind string, pulse double, score int, num_comments int")
    assert [r["post_id"] for r in reading.signals_page(signals, kind="Question", section="S", text="a").collect()] == ["1"] and reading.signals_page(signals, sort="comments").count() == 2
    trends = spark.createDataFrame([(f"t{k}", "growing" if k < 4 else "insufficient_history", k, ["ai"] if k % 2 else None) for k in range(6)], "trend string, lifecycle string, stories int, domains array<string>")
    assert [tuple(r) for r in reading.radar(trends, most=2).orderBy("place").collect()] == [("growing", 1, "t3", 3), ("growing", 2, "t2", 2)] and reading.radar(trends, "ai").count() == 2
