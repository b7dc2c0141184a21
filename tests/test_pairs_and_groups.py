import random

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import grouping, pairs, trends
from corvane.runtime import ship_package


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(90)} | {(k, k + 1) for k in range(200, 240)}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = dict(tuple(r) for r in grouping.components(spark.createDataFrame(sorted(edges), "a int, b int")).collect())
    assert found == {x: find(x) for x in list(parent)}


def ladder(spark, items, **options):
    ship_package(spark)
    schema = "item_id string, provider string, section string, day string, url string, target_url string, title string, excerpt string, people array<string>"
    rows = pairs.featured(spark.createDataFrame([(i, p, s, d, u, None, t, e, w) for i, p, s, d, u, t, e, w in items], schema))
    return rows, pairs.scored(pairs.blocked_pairs(pairs.blocking_keys(rows)), rows, **options)


def item(key, title, provider="p", day="2025-10-24", url="", excerpt="", people=(), section="s"):
    return key, provider, section, day, url, title, excerpt, list(people)


def test_ladder(spark):
    title = "Acme launches giant chip plant near Springfield harbor"
    items = [
        item("a1", title), item("a2", title + " today", "q"), item("u1", "Other words entirely", "q", url="https://x.test/y/"), item("u2", "Nothing like these here", "r", url="https://x.test/y"),
        item("l1", "First headline about tools", url="https://github.com/acme/tool"), item("l2", "Second story about things", "q", url="https://github.com/acme/tool"),
        item("m1", "Acme publishes open language weights", url="https://huggingface.co/acme/model"), item("m2", "Open language weights from Acme", "q", url="https://huggingface.co/acme/model"),
        item("n1", "Borealis raises $5.5B for fusion reactor program"), item("n2", "Borealis raises $5.5 billion for fusion reactor program", "q"), item("n3", "Borealis seeks $7 billion for fusion reactor site", "r"),
        item("p1", "Committee hears long testimony over secret harbor papers", excerpt="In France it rained", people=["ann lee"]), item("p2", "Committee hears long testimony over secret harbor papers", "q", excerpt="In Japan it rained", people=["bob ray"]),
        item("g1", "Top stories", url="https://x.test/1"), item("g2", "Top stories", "q", url="https://x.test/2"), item("r1", "Final score: Lions beat harbor town", section="scores"), item("r2", "Final score: Lions beat harbor town", "q"), item("e", None, "r"),
    ]
    rows, scored = ladder(spark, items)
    found = {(r["a"], r["b"]): (r["decision"], r["rule"]) for r in scored.collect()}
    assert found[("a1", "a2")] == ("auto", "near duplicate") and found[("u1", "u2")] == ("auto", "shared address") and found[("m1", "m2")] == ("auto", "shared model address")
    assert ("l1", "l2") not in found and ("g1", "g2") not in found and ("r1", "r2") not in found
    assert found[("n1", "n2")][0] == "auto" and found[("n1", "n3")] == found[("n2", "n3")] == ("reject", "conflict") and found[("p1", "p2")] == ("reject", "conflict")
    assert pairs.blocked_pairs(pairs.blocking_keys(rows), budget=1).count() == 1


def test_ladder_score_and_review(spark):
    items = [item("a", "Senate committee debates harbor funding while Delta unions protest loudly outside"), item("b", "Delta unions protest harbor funding debates", "q", day="2025-10-29"), item("c", "Completely different subject about gardens")]
    _, scored = ladder(spark, items)
    row = scored.where("a = 'a' and b = 'b'").first()
    left, right = "senate committee debates harbor funding delta unions protest loudly outside", "delta unions protest harbor funding debates"
    title = text.token_set_ratio(left, right)
    assert row["title"] == round(title, 6) and row["jaccard"] == 0.6
    expected = round(0.46 * title + 0.18 * 0.6 + 0.18 * 1.0 + 0.08 * 0.7 + 0.06, 4)
    assert abs(row["score"] - max(expected, 0.0)) < 1e-9 and row["decision"] == "review"
    _, bounded = ladder(spark, items, bounded=True)
    assert bounded.where("a = 'a' and b = 'b'").first()["rule"] == "bounded"


def scored_pairs(spark, rows):
    full = [(*r, *("score", False, None)[len(r) - 4 :]) for r in rows]
    return spark.createDataFrame(full, "a string, b string, score double, decision string, rule string, conflict boolean, provider string")


def test_medoid_groups_refuse_chains(spark):
    chain = scored_pairs(spark, [("a", "b", 0.9, "auto"), ("b", "c", 0.9, "auto"), ("c", "d", 0.8, "auto"), ("x", "y", 1.0, "auto"), ("x", "z", 0.3, "reject")])
    found = {r["item_id"]: r["story"] for r in grouping.medoid_groups(chain).collect()}
    assert found["a"] == found["b"] == found["c"] != found["d"] and found["x"] == found["y"] and "z" not in found


def test_guards_of_groups(spark):
    names = [f"i{k}" for k in range(5)]
    every = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    sizes = lambda rows, **how: sorted(r["count"] for r in grouping.medoid_groups(scored_pairs(spark, rows), **how).groupBy("story").count().collect())
    one = [(a, b, 0.9, "auto", "score", False, "p") for a, b in every]
    assert max(sizes(one)) == 3  # over three items of one provider need a firm pair
    assert sizes([*one[:-1], (*one[-1][:4], "near duplicate", False, "p")]) == [5] or max(sizes([(*r[:4], "shared address", False, "p") for r in one])) == 5
    assert sizes([(*r[:6], None) for r in one]) == [5]
    assert max(sizes([(*r[:5], r[0] == "i0", None) for r in one])) == 4  # i0's pairs are in conflict
    chain = [("a", "b", 0.9, "auto", "score", False, None), ("b", "c", 0.9, "auto", "score", False, None), ("c", "d", 0.9, "auto", "score", False, None), ("d", "e", 0.9, "auto", "score", False, None)]
    assert sizes(chain, most=4) == [1, 4] or max(sizes(chain, most=4)) == 4


def test_identity_is_one_to_one(spark):
    old = spark.createDataFrame([("o1", "1"), ("o1", "2"), ("o2", "3"), ("o2", "4")], "story string, item_id string")
    new = spark.createDataFrame([("n1", "1"), ("n1", "2"), ("n1", "3"), ("n2", "3"), ("n2", "4"), ("n3", "9")], "story string, item_id string")
    found = dict(tuple(r) for r in grouping.carried_identity(old, new).collect())
    assert found == {"n1": "o1", "n2": "o2", "n3": "n3"}


def test_top_cosine_equals_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    expected = set()
    for i, a in vectors:
        best = sorted(((-cosine(a, b), j) for j, b in vectors if j != i and cosine(a, b) >= 0.1))[:3]
        expected |= {(min(i, j), max(i, j)) for _, j in best}
    df = spark.createDataFrame(vectors, "id bigint, embedding array<float>")
    assert {(r["a"], r["b"]) for r in pairs.top_cosine(df, 3, 0.1, cells=3).collect()} == expected


def test_threshold_and_floors(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.5, False)], "score double, label boolean")
    assert trends.precision_threshold(rows, 0.6) == 0.8 and trends.precision_threshold(rows, 1.0) == 0.9
    assert trends.precision_threshold(rows.limit(0), 0.5) is None


def test_floors_and_regressions(spark):
    now = spark.range(1).select(F.lit(1).alias("stories_overmerge_ge5"), F.lit(0.9).alias("stories_compression"), F.lit(70.0).alias("stories_multi_per_1k"), F.lit(0).alias("taxonomy_empty_rubrics"))
    checked = {r["metric"]: r["passed"] for r in trends.floors_of(now, trends.RELEASE_FLOORS).collect()}
    assert checked == {"stories_overmerge_ge5": False, "stories_compression": False, "stories_multi_per_1k": False, "taxonomy_empty_rubrics": True}
    before = spark.range(1).select(F.lit(1).alias("stories_overmerge_ge5"), F.lit(95.0).alias("stories_multi_per_1k"))
    moved = {r["metric"]: (r["delta"], r["regressed"]) for r in trends.regressions(now, before).collect()}
    assert moved == {"stories_overmerge_ge5": (0.0, False), "stories_multi_per_1k": (-25.0, True)}


def test_feature_edges_keep_every_link(spark):
    rows = [(f"s{k:04}", f) for k in range(900) for f in (["big"] if k < 600 else []) + [f"g{k % 300}"]]
    features = spark.createDataFrame(rows, "story string, feature string").withColumn("weight", F.lit(0.5))
    found = {(r["a"], r["b"]): r["weight"] for r in trends.feature_edges(features, ratio=0.8).collect()}
    assert len(found) == 600 * 599 // 2 + 600 and found[("s0000", "s0300")] == 1.0 and found[("s0000", "s0600")] == found[("s0001", "s0002")] == 0.5
    few = trends.feature_edges(features)
    assert few.count() == 900 and trends.common_members(features).count() == 600
    assert {tuple(r) for r in trends.strong_links(features, ratio=0.8).collect()} == {p for p, w in found.items() if w == 1.0}
