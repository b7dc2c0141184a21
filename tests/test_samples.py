from collections import Counter

from corvane.operators.samples import review_sample, selection


def test_review_sample_keeps_its_quotas(spark):
    rows = [(f"a{k:03}", f"b{k:03}", (k % 80) / 100, ("mainstream|voices", "x|y", "y|z")[k % 3]) for k in range(300)]
    pairs = spark.createDataFrame(rows, "a string, b string, score double, stratum string")
    score = {(a, b): s for a, b, s, _ in rows}
    found = review_sample(pairs, 40).collect()
    parts = Counter(r["part"] for r in found)
    assert len({(r["a"], r["b"]) for r in found}) == len(found) == 40 and parts["cross"] == 6 and sum(0.45 <= score[r["a"], r["b"]] <= 0.65 for r in found) >= 20
    assert sorted(map(tuple, found)) == sorted(map(tuple, review_sample(pairs.repartition(5), 40).collect()))
    few = review_sample(pairs.where("score between 0.5 and 0.6"), 40).collect()
    assert len(few) == 40 == len({(r["a"], r["b"]) for r in few}) and review_sample(pairs.limit(0), 40).count() == 0


def test_selection_limits_a_provider(spark):
    rows = [(f"i{k:03}", "big" if k % 10 else f"p{k % 7}", ("c1", "c2")[k % 2], float(k % 50)) for k in range(400)]
    items = spark.createDataFrame(rows, "item_id string, provider string, cluster string, value double")
    owner = {r[0]: r[1] for r in rows}
    found = [r["item_id"] for r in selection(items, 100).collect()]
    assert len(found) == len(set(found)) and Counter(owner[i] for i in found)["big"] == 40
    assert selection(items.limit(0), 100).count() == 0 and selection(items.where("provider = 'big'"), 100).count() == 100
