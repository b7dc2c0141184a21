"""Words are counted over all texts, however many there are."""

import re
from collections import Counter

from pyspark.sql import functions as F

from corvane.llm import pii
from corvane.llm.queries import p4_found

NAMES = tuple((a + b, "given") for a in ("Rom", "Tor", "Sel") for b in ("wyn", "ara", "os")) + tuple((a + b, "family") for a in ("Pell", "Kron", "Vel") for b in ("sen", "berg", "mann"))


def test_a_word_of_texts_that_a_sample_leaves_out(spark, tmp_path):
    """romara is a listed name and a word of 1.5 % of the texts, none of which a hash that picks one text in two or in four takes."""
    texts = spark.range(40_000).select(F.concat(F.lit("plain words number "), "id").alias("body"))
    common = spark.range(5_000).select(F.concat(F.lit("this romara bush grows "), "id").alias("body")).where(F.pmod(F.xxhash64("body"), F.lit(4)).isin(1, 3)).limit(600)
    bodies = texts.unionByName(common).select(F.sha2("body", 256).alias("comment_id"), "body", F.lit(None).cast("string").alias("author"))
    asked = spark.createDataFrame([("asked", "The gate was built with Romara.", None)], "comment_id string, body string, author string")
    bodies.unionByName(asked).write.parquet(f"{tmp_path}/comments.parquet")
    spark.createDataFrame([("p", None)], "post_id string, selftext string").write.parquet(f"{tmp_path}/posts.parquet")
    spark.createDataFrame(NAMES, "person_name string, name_kind string").write.parquet(f"{tmp_path}/person_names.parquet")
    assert p4_found(spark, str(tmp_path)).collect() == []


def test_words_and_runs_equal_a_count_over_all_texts(spark):
    texts = [f"Common {''.join(chr(97 + int(c)) for c in str(i))} pellsen" + " seldom" * (i % 400 == 0) + " Rara" * (i % 2000 == 0) for i in range(45_000)]
    rows = [(t,) for t in texts] + [(t,) for t in texts[:400]] * 3 + [(None,), ("",)]
    found = pii.ordinary_words(spark.createDataFrame(rows, "text string").repartition(5), NAMES)
    counts = Counter(w for t in texts for w in set(re.findall(r"[^\W\d_]{2,}", t.lower())))
    shares = {w: n / len(texts) for w, n in counts.items()}
    assert dict(found.usual) == {w: s for w, s in shares.items() if s > pii.USUAL} and {"common", "seldom", "pellsen"} == set(dict(found.usual))
    listed = set().union(*pii.listed_names(NAMES).values())
    runs = Counter(g for w in counts.keys() - listed for g in pii.letter_runs(w))
    named = {g for w in listed for g in pii.letter_runs(w)}
    assert found.words == len(counts.keys() - listed) and dict(found.runs) == {g: n for g, n in runs.items() if n > pii.FEW or g in named}
    whole, told = pii.Finder(NAMES, tuple(shares.items())), pii.Finder(NAMES, found)
    for word in ["Romara", "Romsen", "Torberg", "pellsen", "seldom", "Rara", "Selmann", "Kronos", *list(counts)[:200]]:
        for kind in ("given", "family"):
            assert abs(whole.like[kind](word.lower()) - told.like[kind](word.lower())) < 1e-9
        assert whole._word(word) == told._word(word)
    assert pii.ordinary_words(spark.createDataFrame([(None,), ("",)], "text string"), NAMES) == pii.Ordinary()
