import random

import pytest

from corvane.operators.similar import distinct_sets, jaccard_pairs, repetition, seen_before


@pytest.mark.parametrize(("shared", "of", "vocabulary"), [(1, 2, 40), (3, 5, 12), (3, 10, 200)])
def test_pairs_equal_brute_force(spark, shared, of, vocabulary):
    rng = random.Random(vocabulary)
    rows = [["common", *rng.sample([f"w{k}" for k in range(vocabulary)], rng.randint(0, 9))] for _ in range(150)] + [[], ["common"], ["common"]]
    sets = distinct_sets(spark.createDataFrame([(r,) for r in rows], "w array<string>"), "w")
    named = {r["set_id"]: frozenset(r["words"]) for r in sets.collect()}
    assert len(named) == len({frozenset(r) for r in rows if r})
    found = {(r["a"], r["b"]): r["jaccard"] for r in jaccard_pairs(sets, shared, of).collect()}
    expected = {(a, b): len(x & y) / len(x | y) for a, x in named.items() for b, y in named.items() if a < b and len(x & y) * of >= len(x | y) * shared}
    assert found.keys() == expected.keys() and all(abs(found[p] - expected[p]) < 1e-9 for p in found)


def test_repetition_and_novelty(spark):
    rows = [(1, "a", ["x", "y"]), (2, "b", ["x", "y"]), (3, "b", ["x", "y", "z"]), (4, "c", ["q"]), (5, "a", []), (6, None, ["x", "y"]), (7, "d", None)]
    df = spark.createDataFrame(rows, "id int, s string, w array<string>")
    assert {tuple(r) for r in repetition(df, "id", "s", "w").collect()} == {(1, 1), (2, 1), (3, 1)}
    old = spark.createDataFrame([(["x", "y", "z"],), (["q", "r", "s"],), (None,)], "w array<string>")
    assert {r[0] for r in seen_before(df, old, "id", "w").collect()} == {1, 2, 3, 6}
    assert seen_before(df, old.limit(0), "id", "w").count() == 0 and repetition(df.limit(0), "id", "s", "w").count() == 0
