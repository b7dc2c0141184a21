"""Exact similarity join of word sets by prefix filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import jaccard
from corvane.runtime import Scratch


def distinct_sets(rows: DataFrame, words: str) -> DataFrame:
    """(set_id, words): every distinct, non-empty array of words once, sorted; set_id stands for it."""
    sets = rows.select(F.array_sort(F.array_distinct(words)).alias("words")).where(F.size("words") > 0).distinct()
    return sets.select(F.xxhash64("words").cast("string").alias("low"), F.md5(F.to_json("words")).alias("high"), "words").select(F.concat("high", "low").alias("set_id"), "words")


def jaccard_pairs(sets: DataFrame, shared: int, of: int) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of word sets (set_id, words) that share at least shared/of of their words.

    Exact: with the words of a set ordered from rare to common, two sets that similar share
    one of their first words; how many is known from the size and the threshold. So a common
    word makes candidates only of sets that have no rarer ones, and no bucket is cut.
    """
    words = sets.select("set_id", F.explode("words").alias("word"))
    rare = words.groupBy("word").agg(F.count("*").alias("n"))
    ordered = words.join(rare, "word").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    hashed = F.transform("ranked.word", lambda w: F.xxhash64(w))
    first = ordered.select("set_id", hashed.alias("words")).select("set_id", "words", F.explode(F.slice("words", F.lit(1), F.size("words") - (F.ceil(F.size("words") * shared / of).cast("int")) + 1)).alias("word"))
    first = Scratch(sets.sparkSession, "prefixes").save(first, "first")  # read from both sides
    a = first.select("word", F.col("set_id").alias("a"), F.col("words").alias("wa"))
    b = first.select("word", F.col("set_id").alias("b"), F.col("words").alias("wb"))
    met = a.join(b, "word").where("a < b").where(_share(F.col("wa"), F.col("wb"), shared, of)).select("a", "b").distinct()
    # Hashes of words are quick to compare; what they leave is checked on the words.
    met = met.join(sets.select(F.col("set_id").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("words").alias("wb")), "b")
    return met.where(_share(F.col("wa"), F.col("wb"), shared, of)).select("a", "b", jaccard(F.col("wa"), F.col("wb")).alias("jaccard"))


def _share(a: Column, b: Column, shared: int, of: int) -> Column:
    """Whether two sets have at least shared/of of all their members in common."""
    sized = (F.size(a) * of >= F.size(b) * shared) & (F.size(b) * of >= F.size(a) * shared)
    both = F.size(F.array_intersect(a, b))
    return sized & (both * of >= (F.size(a) + F.size(b) - both) * shared)


def repetition(rows: DataFrame, key: str, section: str, words: str, shared: int = 1, of: int = 2, most: int = 4) -> DataFrame:
    """(key, sections): in how many other sections, at most `most`, rows have at least shared/of of a row's words; rows without any are left out.

    Rows without words repeat nothing. Sections are compared as given; a null section is none.
    """
    sets = Scratch(rows.sparkSession, "sets").save(distinct_sets(rows, words), "sets")
    named = rows.select(key, section, F.array_sort(F.array_distinct(words)).alias("words")).join(sets, "words").select(key, section, "set_id")
    pairs = jaccard_pairs(sets, shared, of).select("a", "b")
    ways = pairs.union(pairs.select("b", "a")).union(sets.select("set_id", F.col("set_id")))
    places = named.select(F.col("set_id").alias("b"), F.col(section).alias("other")).distinct()
    met = ways.toDF("set_id", "b").join(places, "b").select("set_id", "other").distinct()
    found = named.join(met, "set_id").where(F.col("other") != F.col(section)).groupBy(key).agg(F.count_distinct("other").alias("n"))
    return found.select(key, F.least(F.lit(most), F.col("n")).alias("sections"))


def seen_before(rows: DataFrame, history: DataFrame, key: str, words: str, shared: int = 3, of: int = 5) -> DataFrame:
    """(key) of the rows whose words and those of some row of the history have at least shared/of in common."""
    old = distinct_sets(history, words).withColumn("old", F.lit(True))
    new = distinct_sets(rows, words).withColumn("new", F.lit(True))
    sets = old.unionByName(new, allowMissingColumns=True).groupBy("set_id", "words").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    sets = Scratch(rows.sparkSession, "sets").save(sets, "sets")
    pairs = jaccard_pairs(sets.select("set_id", "words"), shared, of).select("a", "b")
    ways = pairs.union(pairs.select("b", "a")).union(sets.where("old and new").select("set_id", F.col("set_id"))).toDF("set_id", "b")
    hit = ways.join(sets.where("old").select(F.col("set_id").alias("b")), "b", "left_semi").select("set_id").distinct()
    named = rows.select(key, F.array_sort(F.array_distinct(words)).alias("words")).join(sets.where("new").select("set_id", "words"), "words")
    return named.join(hit, "set_id", "left_semi").select(key).distinct()
