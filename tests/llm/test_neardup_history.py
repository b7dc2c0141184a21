import random

import pytest
from pyspark.sql import functions as F

from corvane.llm.history import History, known_items
from corvane.llm.neardup import near_duplicate_members, near_duplicate_pairs, neighbours_met

WORDS = [f"w{k}" for k in range(4000)]


def corpus(seed, groups=40):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = rng.sample(WORDS, rng.randint(6, 40))
        for _ in range(rng.randint(1, 4)):
            kept = [w for w in base if rng.random() < 0.9] + rng.sample(WORDS, rng.randint(0, 2))
            rows.append((f"i{len(rows):03}", " ".join(["the", "of", *kept[:5]]), " ".join(kept[5:]) or None))
    return rows


def words(title, excerpt):
    return frozenset(f"{title or ''} {excerpt or ''}".lower().split())


def alike(a, b):
    return bool(a and b) and 5 * len(a & b) >= 3 * len(a | b)


def test_pairs_equal_brute_force(spark):
    rows = corpus(1) + [("copy1", "Same Title here", ""), ("copy2", "same title HERE", None), ("copy2", "same title HERE", None), ("empty", "", None), ("empty2", None, ""), (None, "same title here", "")]
    df = spark.createDataFrame(rows, "item_id string, title string, excerpt string").withColumn("words", F.lit(1)).withColumn("id", F.lit(2))
    found = {tuple(r) for r in near_duplicate_pairs(df).collect()}
    sets = {i: words(t, e) for i, t, e in rows if i}
    expected = {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    assert found - expected == set() and len(found) >= 0.97 * len(expected) and ("copy1", "copy2") in found


def test_many_copies_cost_in_proportion(spark):
    rows = [(f"c{k:04}", "one two three four five six", "") for k in range(400)] + [("x", "one two three four five six seven", "")]
    found = {tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, "item_id string, title string, excerpt string")).collect()}
    assert {("c0000", f"c{k:04}") for k in range(1, 400)} <= found and {(f"c{k:04}", "x") for k in range(400)} <= found
    assert len(found) == 399 + 400


def test_all_copies_by_membership_or_exactly(spark):
    rows = [(f"c{k:02}", "one two three four five six", "") for k in range(70)] + [("x", "one two three four five six seven", ""), ("y", "alone", ""), (None, "alone", ""), ("z", None, None)]
    df = spark.createDataFrame(rows, "item_id string, title string, excerpt string")
    assert near_duplicate_pairs(df, copies=None).count() == 71 * 70 // 2
    assert sorted(tuple(r) for r in near_duplicate_members(df).collect()) == [(f"c{k:02}", "c00", "c00") for k in range(70)] + [("x", "x", "c00"), ("y", "y", "y")]


@pytest.mark.parametrize(("vocabulary", "length"), [(400, 15), (3000, 40)])
def test_common_words_keep_their_links(spark, vocabulary, length):
    rng, words_ = random.Random(3), [f"w{k}" for k in range(vocabulary)]
    rows = [rng.sample(words_, length) for _ in range(9000)]
    for k in range(500):
        edited = list(rows[k])
        for _ in range(rng.randint(1, 3)):
            edited[rng.randrange(length)] = rng.choice(words_)
        rows.append(edited)
    df = spark.createDataFrame([(f"i{k:05}", " ".join(r), "") for k, r in enumerate(rows)], "item_id string, title string, excerpt string").repartition(4)
    planted = {(f"i{k:05}", f"i{9000 + k:05}") for k in range(500) if alike(set(rows[k]), set(rows[9000 + k]))}
    found = {tuple(r) for r in near_duplicate_pairs(df).collect()}
    assert len(planted & found) >= 0.99 * len(planted) > 300


def test_neighbours_meet_in_blocks(spark):
    links = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(5, 99)], "a bigint, b bigint")
    expected = {(x, y) for x in range(1, 40) for y in range(x + 1, 40)} | {(0, 99)}
    for block in (7, 256):
        assert {tuple(r) for r in neighbours_met(links, links, block).collect()} == expected


def test_different_texts_of_one_word_set_all_pair(spark):
    turned = [(f"b{k:02}", "six five four three two one", "") for k in range(2)] + [("c00", "Two one three, four five six!", "")]
    rows = [(f"a{k:02}", "one two three four five six", "") for k in range(70)] + turned
    found = {tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, "item_id string, title string, excerpt string")).collect()}
    assert {("b00", "b01"), ("b00", "c00"), ("b01", "c00")} <= found and {(f"a{k:02}", x) for k in range(70) for x in ("b00", "b01", "c00")} <= found
    assert len(found) == 3 + 210 + 69


def test_nothing_in_nothing_out(spark):
    assert near_duplicate_pairs(spark.createDataFrame([], "item_id string, title string, excerpt string")).count() == 0


@pytest.mark.parametrize("crowd", [0, 40])
def test_history_equals_replay(spark, crowd):
    rng = random.Random(5)
    rows = [(f"2025-10-{24 + rng.randrange(3)}", i, t, e, rng.choice([None, "", "g1", i]), f"https://s.test/{i}") for i, t, e in corpus(7, 25)]
    same = " ".join(WORDS[:30])
    rows += [(f"2025-10-{24 + k % 2}", f"n{k:03}", f"{same} extra{k}", "", None, None) for k in range(crowd)]
    rows += [("2025-10-25", rows[0][1], "redelivered", "", None, None), (None, "z", "t", "", None, None), ("2025-10-25", None, "t", "", None, None)]
    df = spark.createDataFrame(rows, "day string, item_id string, title string, excerpt string, g string, url string")
    exact = [F.col("item_id"), F.nullif("g", F.lit("")), F.col("url")]
    found = {tuple(r) for r in known_items(df, "day", "item_id", ["title", "excerpt"], exact).collect()}
    kept, expected = [], set()
    for day in sorted({r[0] for r in rows if r[0]}):
        batch = {}
        for r in rows:
            if r[0] == day and r[1]:
                batch.setdefault(r[1], []).append(r)
        match = lambda r, k: r[1] == k[1] or (r[4] and r[4] == k[4]) or (r[5] and r[5] == k[5]) or alike(words(r[2], r[3]), words(k[2], k[3]))
        known = {i for i, own in batch.items() if any(match(r, k) for r in own for k in kept)}
        expected |= {(day, i) for i in known}
        kept += [r for i, own in batch.items() if i not in known for r in own]
    assert found - expected == set() and len(found) >= 0.95 * len(expected) and len(expected) > 0


def test_history_goes_on_in_a_new_session(spark, tmp_path):
    exact = [F.col("item_id")]
    day = lambda rows: spark.createDataFrame(rows, "item_id string, title string, excerpt string")
    base = " ".join(WORDS[:20])
    first = History(spark, f"file://{tmp_path}/kept")
    assert first.take(day([("a", base, ""), ("b", base + " more", ""), ("c", "", None)]), "item_id", ["title", "excerpt"], exact).count() == 0
    first.close()
    again = History(spark, f"file://{tmp_path}/kept", shared=1, of=10)  # the folder's parameters hold
    assert again.state["batches"] == 1 and (again.shared, again.of) == (3, 5)
    rows = [("c", "redelivered text of its own", ""), ("d", base + " added words", ""), ("e", " ".join(WORDS[100:120]), ""), ("e", base, ""), ("f", "redelivered text of its own", "")]
    assert {r[0] for r in again.take(day(rows), "item_id", ["title", "excerpt"], exact).collect()} == {"c", "d", "e"}
    broken = again
    broken._append(again._spread(spark.createDataFrame([(1, 2)], "bucket bigint, mark bigint"), "exact"), "exact")  # a batch breaks off
    broken._commit(begun=3)
    again.close()
    third = History(spark, f"file://{tmp_path}/kept")
    found = third.take(day([("g", " ".join(WORDS[100:120]), ""), ("f", "x", ""), ("h", " ".join(WORDS[:19]), "")]), "item_id", ["title", "excerpt"], exact)
    assert {r[0] for r in found.collect()} == {"f", "h"} and third.state["generation"] == 1  # e was known: its text wasn't accepted
    third.close()


def test_history_grows_and_splits_crowded_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corvane.llm.history.ROWS_PER_BUCKET", 100)
    monkeypatch.setattr("corvane.llm.history.CROWDED", 4)
    same = " ".join(WORDS[:30])
    rows = [("1", f"n{k:02}", f"{same} own{k}", "") for k in range(40)] + [("2", f"m{k:02}", f"{same} new{k}", "") for k in range(5)] + [("2", "z", " ".join(WORDS[40:80]), "")]
    df = spark.createDataFrame(rows, "day string, item_id string, title string, excerpt string")
    found = known_items(df, "day", "item_id", ["title", "excerpt"], [F.col("item_id")], f"file://{tmp_path}/kept")
    assert {tuple(r) for r in found.collect()} == {("2", f"m{k:02}") for k in range(5)}
    kept = History(spark, f"file://{tmp_path}/kept")
    assert kept.state["buckets"] > 8 and kept.state["crowded"] and kept.state["generation"] > 0
    kept.close()


def test_history_of_nothing(spark):
    df = spark.createDataFrame([], "day string, item_id string, title string, excerpt string")
    assert known_items(df, "day", "item_id", ["title", "excerpt"], [F.col("item_id")]).count() == 0
