import random

import pandas as pd

from corvane.operators import grouping, pairs


def greedy(score, least=0.55):
    of = lambda x, y: score.get((min(x, y), max(x, y)), 0.0)
    group = {x: {x} for p in score for x in p}
    for a, b in sorted(score, key=lambda p: (-score[p], p)):
        if group[a] is not group[b]:
            joined = group[a] | group[b]
            medoid = min(joined, key=lambda x: (-sum(round(of(x, y) * 10000) for y in joined if y != x), x))
            if all(of(medoid, x) >= least for x in joined if x != medoid):
                for x in joined:
                    group[x] = joined
    return {x: min(g) for x, g in group.items()}


def frame(rows):
    return pd.DataFrame([(*r, "shared address", False, None) for r in rows], columns=["a", "b", "score", "decision", "rule", "conflict", "provider"])


def test_merging_equals_plain_greedy():
    for seed in range(150):
        rng = random.Random(seed)
        names = [f"i{k:02}" for k in range(rng.randint(2, 30))]
        score = {tuple(sorted(rng.sample(names, 2))): rng.choice([0.4, 0.6, 0.82, 0.9, 0.9012, 1.0]) for _ in range(rng.randint(1, 120))}
        pairs = list(score)
        found = grouping.merged(frame([(a, b, score[a, b], "auto") for a, b in pairs]), 0.55)
        assert dict(zip(found["item_id"], found["story"])) == greedy(score)


def test_component_of_over_10000_items_is_whole(spark):
    chain = [(f"i{2 * k:05}", f"i{2 * k + 1:05}", 0.9, "auto") for k in range(6000)] + [(f"i{2 * k + 1:05}", f"i{2 * k + 2:05}", 0.85, "auto") for k in range(5999)]
    star = [("hub", f"s{k:05}", 1.0, "auto") for k in range(12000)]
    df = spark.createDataFrame(frame(chain + star), "a string, b string, score double, decision string, rule string, conflict boolean, provider string")
    found = {r["item_id"]: r["story"] for r in grouping.medoid_groups(df).collect()}
    assert len(found) == 24001 and all(found[f"i{2 * k:05}"] == found[f"i{2 * k + 1:05}"] == f"i{2 * k:05}" for k in range(6000))
    assert {found[f"s{k:05}"] for k in range(12000)} == {"hub"}


def test_hot_address_links_all_its_items(spark):
    rows = [(f"i{k:02}", "u:x", "url") for k in range(33)] + [(f"i{k:02}", "w:x", "token") for k in range(33)]
    found = {tuple(r) for r in pairs.blocked_pairs(spark.createDataFrame(rows, "item_id string, key string, reason string")).select("a", "b").collect()}
    assert found == {("i00", f"i{k:02}") for k in range(1, 33)}
