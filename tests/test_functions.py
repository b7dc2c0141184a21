import random

from pyspark.sql import functions as F

from corvane.functions import classify, ids, pages, scores, text, urls


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_page_key_joins_spellings_and_keeps_content(spark):
    same = ["https://Www.Site.Test:443/p/00%32x/?utm_source=a#top", "http://site.test/p/002x", "https://amp.site.test//p/002X/?ref=1"]
    other = ["https://site.test/p/002y", "https://site.test/story?id=1", "https://site.test/story?id=2&utm_medium=x"]
    key = lambda u: one(spark, pages.page_key(F.lit(u)))
    assert len({key(u) for u in same}) == 1
    assert len({key(u) for u in same + other}) == 4
    assert key("https://site.test/story?a=1&b=2") == key("https://site.test/story?b=2&a=1")
    assert [key(u) for u in ("https://site.test", "https://site.test/", "https://www.site.test/?gclid=1", "", "/p/1", None)] == [None] * 6


def test_canonical_url(spark):
    of = lambda u: one(spark, urls.canonical_url(F.lit(u)))
    assert of("http://m.bbc.com/news/x/?utm_source=a&id=3#c") == "https://www.bbc.com/news/x?id=3"
    assert of("https://news.google.com/rss/articles/CB?oc=5") == "https://news.google.com/rss/articles/CB"
    assert of("ftp://x/y") == ""


def test_token_set_ratio():
    assert text.token_set_ratio("a b", "b a") == 1.0
    assert text.token_set_ratio("new york mets", "new york mets vs braves") == 1.0
    assert text.token_set_ratio("", "a") == 0.0 == text.token_set_ratio(None, None)
    assert abs(text.token_set_ratio("abcd", "abed") - 0.75) < 1e-9
    rng = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert text._lcs(a, b) == lcs(a, b)


def test_titles(spark):
    assert one(spark, text.normalized_title(F.lit("Why AI chips cost more - The Verge"))) == "ai chips cost"
    assert one(spark, text.compatible_title(F.lit("Ｆｕｌｌ ｗｉｄｔｈ"))) == "full width"
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.shingles(F.array(F.lit("a"), F.lit("b")), 3)) == []


def test_signal_types_and_domains(spark):
    kind = lambda t, s="": one(spark, classify.signal_type(F.lit(t), F.lit(""), F.lit(s), F.lit(""), F.lit(True)))
    assert kind("Anything", "stocks") == "market_investing"
    assert kind("New vaccine works") == "health_science"
    assert kind("hello there") == "discussion"
    rows = spark.createDataFrame([(1, "OpenAI chips and a layoff", "", "x"), (2, "", None, "x"), (3, None, None, None)], "id int, title string, excerpt string, found string")
    assert [r["d"] for r in classify.with_domains(rows, "title", "excerpt", "d").orderBy("id").collect()] == [["ai_technology", "labor_career"], ["other"], ["other"]]


def test_typed_numbers(spark):
    of = lambda t: {tuple(r) for r in one(spark, classify.typed_numbers(F.lit(t)))}
    assert of("Raises $5.5B, up 12% in 3 towns") == {("currency:$", "5.5", "bn"), ("percent", "12", "base"), ("count", "3", "base")}
    assert of("Raises $5.5 billion") == {("currency:$", "5.5", "bn")} and of("1,200 of 4 million") == {("count", "12", "base"), ("count", "4", "m")} and of(None) == set() == of("none")
    conflict = lambda a, b: one(spark, classify.number_conflict(classify.typed_numbers(F.lit(a)), classify.typed_numbers(F.lit(b))))
    assert not conflict("$5.5B", "$5.5 billion deal") and conflict("$5B", "$7B") and not conflict("$5B", "12%") and not conflict("none", "$5B") and not conflict("3 of 4", "4 towns")


def test_hints(spark):
    of = lambda c, t: one(spark, c(F.lit(t)))
    assert of(classify.action_hint, "Acme sues rival") == "sue" and of(classify.action_hint, "nothing") is None
    assert of(classify.places, "Chinese and American officials meet in Germany") == ["china", "germany", "united states"] and of(classify.places, "") == []
    assert of(classify.is_prompt, "What’s your plan?") and not of(classify.is_prompt, "Whatever") and of(classify.is_housekeeping, "Game Thread: a at b") and of(classify.is_housekeeping, "ok 12")
    assert of(text.is_low_signal, "Weekly Career Advice Thread") and not of(text.is_low_signal, "A career in advice")


def test_directions(spark):
    rows = spark.createDataFrame([("d1", "d1", 3, 2, None, None, None), ("d0", "d1", 3, 2, 2, 2, 1), ("d0", "d1", 1, 1, 3, 3, 1), ("d0", "d1", 3, 2, 3, 2, 20), ("d0", "d1", 2, 3, 3, 3, 1)], "f string, t string, n int, p int, n0 int, p0 int, gap int")
    assert [r[0] for r in rows.select(scores.direction(*(F.col(c) for c in rows.columns))).collect()] == ["new", "growing", "fading", "resurfacing", "stable"]
    trend = spark.createDataFrame([(False, 3, 2, 1), (True, 3, None, 0), (True, 2, 2, 8), (True, 3, 2, 1), (True, 1, 2, 3), (True, 2, 2, 1)], "r boolean, n int, n0 int, gap int")
    assert [r[0] for r in trend.select(scores.lifecycle(*(F.col(c) for c in trend.columns))).collect()] == ["insufficient_history", "new", "resurfacing", "growing", "fading", "stable"]


def test_scores(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    found = scores.with_percentile(scores.with_percentile(rows, "g", "v", "p", average=True), "g", "v", "s")
    assert sorted((r["g"], r["v"], r["p"], round(r["s"], 2)) for r in found.collect()) == [("a", 1.0, 25.0, 66.67), ("a", 1.0, 25.0, 66.67), ("a", 3.0, 100.0, 100.0), ("b", 5.0, 50.0, 100.0)]
    assert one(spark, scores.upper_median(F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0))))) == 3.0


def test_checksum_ignores_order_and_sees_changes(spark):
    of = lambda rows: ids.release_checksum(spark.createDataFrame(rows, "a int, b string"), ["a", "b"]).first()["checksum"]
    assert of([(1, "x"), (2, None)]) == of([(2, None), (1, "x")])
    assert of([(1, "x"), (2, None)]) != of([(1, "x"), (2, "")])
