from itertools import product

from corvane.functions import pages

HOSTS = ["s.test", "www.s.test", "m.www.s.test", "www.test", "m.", "amp.a.b.test", "S.test", "s.test.", "u@s.test", "s.test:80", "s.test:81", "-", "", "a..b", "www..b.c", "www.m.b"]
PATHS = ["", "/", "/a", "/a/", "/a//b", "/a/b-1.html", "/a.b/c", "/A", "/a%20b", "/a+b", "/a~_b///", "/a\n", "/é", "a"]
ENDS = ["", "?", "?id=1", "?utm_source=x", "#f", "#f\ng", "#f?x=1#g", " ", "\n"]


def test_one_look_at_an_ordinary_address_gives_what_all_steps_give(spark):
    urls = [f"{s}{h}{p}{e}" for s, h, p, e in product(["https://", " http://", "x:", ""], HOSTS, PATHS, ENDS)]
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "url string")
    rows = df.select("url", pages.page_key(df.url).alias("key"), pages._spelled(df.url).alias("spelled")).collect()
    assert [r for r in rows if r["key"] != r["spelled"]] == [] and sum(r["key"] is not None for r in rows) > 1000
