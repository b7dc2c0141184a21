"""Seeded samples by quotas: what a random order decides, a hash of the seed and the row's id decides here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(seed: int, *ids: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *ids), 256)


def in_turn(rows: DataFrame, most: int, stratum: str, order: Column) -> DataFrame:
    """At most so many rows, one of each stratum in turn, each stratum in the given order."""
    own = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("_n", own).where(F.col("_n") <= most).orderBy("_n", stratum).limit(most).drop("_n")


def review_sample(pairs: DataFrame, limit: int, seed: int = 13, low: float = 0.45, high: float = 0.65, boundary: float = 0.5, cross: float = 0.15, rare: str = "mainstream|voices") -> DataFrame:
    """(a, b, part) of at most `limit` pairs (a, b, score, stratum) for review.

    First pairs of the rare stratum, those in the boundary window first; then the window until
    it has its share; then pairs outside it; then whatever is left. Strata take turns.
    """
    order = hashed(seed, "a", "b")
    rows = pairs.select("a", "b", "score", "stratum", F.col("score").between(low, high).alias("edge"))
    name = lambda df, part: df.select("a", "b", "edge", F.lit(part).alias("part"))
    first = rows.where(F.col("stratum") == rare).orderBy(F.desc("edge"), order).limit(max(1, round(limit * cross)))
    out = [name(first, "cross")]
    rest = rows.join(first.select("a", "b"), ["a", "b"], "left_anti")
    taken = first.agg(F.count("*").alias("n"), F.count_if("edge").alias("edge")).first()
    need = min(max(0, -int(-limit * boundary // 1) - taken["edge"]), limit - taken["n"])
    window = in_turn(rest.where("edge"), need, "stratum", order)
    out.append(name(window, "boundary"))
    left = limit - taken["n"] - window.count()
    tail = in_turn(rest.where("not edge"), left, "stratum", order)
    out.append(name(tail, "tail"))
    left -= tail.count()
    if left > 0:
        out.append(name(in_turn(rest.where("edge").join(window.select("a", "b"), ["a", "b"], "left_anti"), left, "stratum", order), "more"))
    return reduce(DataFrame.union, out).select("a", "b", "part")


def selection(items: DataFrame, limit: int, seed: int = 13, share: float = 0.4) -> DataFrame:
    """(item_id, part) of at most `limit` items (item_id, provider, cluster, value).

    70 % evenly from the clusters, by value; 20 % by value from the rest; the remainder by
    chance. With three providers or more none keeps over `share` of the limit.
    """
    order, by_value = hashed(seed, "item_id"), [F.desc("value"), F.col("item_id")]
    clusters = items.select("cluster").distinct().count()
    if not clusters:
        return items.select("item_id", F.lit("").alias("part")).limit(0)
    even, best = int(limit * 0.7), int(limit * 0.2)
    own = F.row_number().over(Window.partitionBy("cluster").orderBy(*by_value))
    one = items.withColumn("_n", own).where(F.col("_n") <= even // clusters).drop("_n")
    rest = items.join(one.select("item_id"), "item_id", "left_anti")
    two = rest.orderBy(*by_value).limit(best)
    three = rest.join(two.select("item_id"), "item_id", "left_anti").orderBy(order).limit(limit - even - best)
    named = lambda df, part, k: df.select("item_id", "provider", F.lit(part).alias("part"), F.lit(k).alias("_p"), *(
        [F.lit(0.0).alias("_v"), order.alias("_h")] if k == 3 else [(-F.col("value")).alias("_v"), F.lit("").alias("_h")]
    ))
    chosen = named(one, "cluster", 1).unionByName(named(two, "global", 2)).unionByName(named(three, "exploration", 3))
    if chosen.select("provider").distinct().count() < 3:
        return chosen.select("item_id", "part")
    held = F.row_number().over(Window.partitionBy("provider").orderBy("_p", "_v", "_h", "item_id"))
    return chosen.withColumn("_k", held).where(F.col("_k") <= int(limit * share)).select("item_id", "part")


def with_neighbours(items: DataFrame, pairs: DataFrame, seeds: int, stratum: str = "provider", seed: int = 13, least: float = 0.65, shared: int = 2, days: int = 14) -> DataFrame:
    """(item_id, part): seeds from the strata in turn, and for each seed its best neighbour.

    pairs: (a, b, title, n_shared, same_url, days). A neighbour shares an address, or enough
    words under a similar enough title, within so many days; the most similar title counts, ties by id.
    """
    chosen = in_turn(items, seeds, stratum, hashed(seed, "item_id")).select("item_id")
    near = pairs.where((F.col("days") <= days) & (F.col("same_url") | ((F.col("n_shared") >= shared) & (F.col("title") >= least))))
    both = near.select(F.col("a").alias("item_id"), F.col("b").alias("other"), "title").union(near.select("b", "a", "title"))
    best = both.join(chosen, "item_id").groupBy("item_id").agg(F.min(F.struct((-F.col("title")).alias("t"), "other")).alias("m"))
    more = best.select(F.col("m.other").alias("item_id")).distinct().join(chosen, "item_id", "left_anti")
    return chosen.withColumn("part", F.lit("seed")).union(more.withColumn("part", F.lit("neighbour")))
