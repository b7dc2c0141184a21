import random

from corvane.operators.latest import latest
from corvane.operators.snapshot_diff import snapshot_changes


def brute(rows, last):
    at = {}
    for seq, key, *values in rows:
        if key is not None:
            at.setdefault(seq, {})[key] = tuple(values)
    out = set()
    for seq in range(2, last + 1):
        now, old = at.get(seq, {}), at.get(seq - 1, {})
        out |= {(seq, k, "added") for k in now.keys() - old.keys()} | {(seq, k, "removed") for k in old.keys() - now.keys()}
        out |= {(seq, k, "changed") for k in now.keys() & old.keys() if now[k] != old[k]}
    return out


def test_changes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(seq, f"k{k}", rng.choice([1, 1, 1, 2, None]), 5) for seq in (1, 2, 4) for k in range(300) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "seq int, id string, score int, n int")
    for buckets in (1, 64):
        found = {tuple(r) for r in snapshot_changes(df, "id", ["score", "n"], 4, buckets).collect()}
        assert found == brute(rows, 4)


def test_changes_of_null_empty_and_one_list(spark):
    schema = "seq int, id string, score int, seq_extra int"
    assert snapshot_changes(spark.createDataFrame([], schema), "id", ["score"], 3).collect() == []
    rows = [(1, None, 1, 0), (1, "a", None, 0), (2, "a", None, 0)]
    assert snapshot_changes(spark.createDataFrame(rows, schema), "id", ["score"], 2).collect() == []
    gone = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, schema), "id", ["score"], 3).collect()}
    assert gone == {(3, "a", "removed")}


def test_latest_takes_nulls_last_and_ignores_input_order(spark):
    rows = [("a", None, 1), ("a", 2, 5), ("a", 2, 7), ("b", None, None)]
    expected = {("a", 7), ("b", None)}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, at int, v int")
        assert {tuple(r) for r in latest(df, ["k"], ["at"], ["v"]).collect()} == expected
