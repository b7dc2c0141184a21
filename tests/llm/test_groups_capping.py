import random

from corvane.llm.capping import over_share
from corvane.llm.groups import group_items


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_groups_equal_union_find(spark):
    rng = random.Random(1)
    rows = [("e1", f"i{a}", f"i{b}", rng.random(), "x") for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(160))]
    rows += [("e2", f"c{k:03}", f"c{k + 1:03}", 0.9, "x") for k in range(64)]  # a long chain
    rows += [("e3", "hub", f"h{k:03}", 0.9, "x") for k in range(80)] + [("e3", f"h{k:03}", "hub", None, "x") for k in range(80)]
    rows += [("e1", "i1", "i1", 0.9, "x"), ("e1", None, "i2", 0.9, "x"), (None, "i1", "i2", 0.9, "x"), ("e1", "n1", "n2", float("nan"), "x"), ("e1", "n1", "n3", 0.61, "x")]
    df = spark.createDataFrame(rows, "experiment_id string, item_id_a string, item_id_b string, score double, node string")
    found = {(r["experiment_id"], r["item_id"]): r["group_id"] for r in group_items(df).collect()}
    expected = {}
    for e in ("e1", "e2", "e3"):
        good = [(a, b) for x, a, b, s, _ in rows if x == e and a and b and a != b and s is not None and s >= 0.62]
        expected |= {(e, k): v for k, v in components(good).items()}
    assert found == expected


def test_groups_of_nothing(spark):
    assert group_items(spark.createDataFrame([], "experiment_id string, item_id_a string, item_id_b string, score double")).count() == 0


def test_capping_equals_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), f"r{k:04}é", rng.choice([None, 1.0, 2.0, 2.0, float("nan"), -5.5, float("inf")])) for k in range(600)]
    rows += [("tied", f"provider:id{k:03}", 7.0) for k in range(200)]
    df = spark.createDataFrame(rows, "contributor string, record_id string, quality double")
    for share in (0.02, 0.1, 1.0):
        cap, expected = max(1, int(share * len(rows) + 1e-9)), set()
        for who in {r[0] for r in rows if r[0]}:
            worth = lambda q: (1, 0.0) if q is None or q != q else (0, -q)
            own = sorted((r for r in rows if r[0] == who), key=lambda r: (worth(r[2]), r[1].encode()))
            expected |= {r[1] for r in own[cap:]}
        assert {r[0] for r in over_share(df, share).collect()} == expected


def test_capping_of_nothing(spark):
    schema = "contributor string, record_id string, quality double"
    assert over_share(spark.createDataFrame([], schema)).count() == 0
    assert over_share(spark.createDataFrame([("a", "1", None), ("a", None, 2.0)], schema)).count() == 0
