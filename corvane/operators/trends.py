"""Trends: graph and leader clusters of stories, names by term weight, lifecycles, quality floors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import classify
from corvane.functions import text as tx

# Floors of a release's quality, and how far a metric may move from the baseline; of the last three a fall is the regression.
RELEASE_FLOORS = [
    ("stories_overmerge_ge5", "max", 0.0), ("stories_overmerge_ge8", "max", 0.0), ("taxonomy_ai_tech_share", "max", 50.0), ("taxonomy_other_share", "max", 40.0), ("taxonomy_max_rubric_share", "max", 50.0), ("taxonomy_empty_rubrics", "max", 0.0),
    ("trends_bad_name_count", "max", 0.0), ("trends_duplicate_name_count", "max", 0.0), ("pulse_other_share", "max", 35.0), ("stories_multi_per_1k", "min", 90.0), ("stories_cross_source_per_1k", "min", 35.0), ("stories_compression", "max", 0.85),
]
TOLERANCES = {
    "stories_overmerge_ge5": 0.0, "stories_overmerge_ge8": 0.0, "taxonomy_ai_tech_share": 5.0, "taxonomy_other_share": 5.0, "trends_bad_name_count": 0.0, "trends_duplicate_name_count": 0.0,
    "stories_cross_source": 10.0, "stories_multi_per_1k": 20.0, "stories_cross_source_per_1k": 10.0,
}
FALLS = ("stories_cross_source", "stories_multi_per_1k", "stories_cross_source_per_1k")


def _long(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, value) of those columns of one row of metrics that are there."""
    known = [c for c in names if c in metrics.columns]
    return metrics.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in known))))


def floors_of(metrics: DataFrame, floors: list[tuple[str, str, float]]) -> DataFrame:
    """(metric, value, op, bound, passed) of one row of metrics; metrics that aren't there are left out."""
    bounds = metrics.sparkSession.createDataFrame(floors, "metric string, op string, bound double")
    passed = F.when(F.col("op") == "max", F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return bounds.join(_long(metrics, [m for m, _, _ in floors]), "metric").withColumn("passed", passed)


def regressions(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, current, before, delta, regressed) of the metrics that both rows have."""
    now, old = (_long(df, list(TOLERANCES)) for df in (metrics, baseline))
    allowed = metrics.sparkSession.createDataFrame([(m, t, m in FALLS) for m, t in TOLERANCES.items()], "metric string, tolerance double, falls boolean")
    both = now.withColumnRenamed("value", "current").join(old.withColumnRenamed("value", "before"), "metric").join(allowed, "metric")
    worse = F.when(F.col("falls"), F.col("current") < F.col("before") - F.col("tolerance")).otherwise(F.col("current") > F.col("before") + F.col("tolerance"))
    return both.select("metric", "current", "before", F.round(F.col("current") - F.col("before"), 3).alias("delta"), worse.alias("regressed"))


def rollup(rows: DataFrame) -> DataFrame:
    """Dates, providers, clusters, scope and confidence of trends; rows: (trend, story, provider, source_cluster, day)."""
    one = rows.groupBy("trend").agg(
        *(F.count_distinct(c).alias(n) for c, n in (("story", "stories"), ("day", "dates"), ("provider", "providers"), ("source_cluster", "clusters"))),
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.max("source_cluster").alias("scope"),
    )
    confidence = F.least(F.lit(0.95), 0.42 + 0.06 * F.col("stories") + 0.05 * F.col("clusters") + 0.03 * F.col("dates"))
    return one.withColumns({"scope": F.when(F.col("clusters") > 1, "mixed").otherwise(F.col("scope")), "confidence": F.round(confidence, 4)})


def kinds(rows: DataFrame, today: str) -> DataFrame:
    """(trend, kind, lifecycle) of trends by who tells them and by their age; rows as in rollup."""
    one = rows.groupBy("trend").agg(
        (F.count_distinct("provider") > 1).alias("cross"), F.bool_or(F.col("source_cluster") == "voices").alias("v"), F.bool_or(F.col("source_cluster") == "mainstream").alias("m"),
        F.min("day").alias("first"), F.max("day").alias("last"), F.count_distinct("day").alias("dates"),
    )
    kind = F.when(F.col("v") & ~F.col("m"), "community_first").when(F.col("m") & ~F.col("v"), "mainstream_only").when(F.col("cross"), "cross_source").otherwise("unclassified")
    age = F.date_diff(F.lit(today).cast("date"), F.to_date("first"))
    life = F.when(age <= 2, "new").when((F.col("dates") >= 5) & (F.col("first") != F.col("last")), "growing").otherwise("stable")
    return one.select("trend", kind.alias("kind"), life.alias("lifecycle"))


def _sized(features: DataFrame, ratio: float, least_df: int) -> tuple[DataFrame, int]:
    """(feature, n) of the features of two stories or more, and the n up to which a feature gives pairs."""
    total = features.select("story").distinct().count()
    return features.groupBy("feature").agg(F.count_distinct("story").alias("n")).where("n >= 2"), max(least_df, int(ratio * total))


def feature_edges(features: DataFrame, ratio: float = 0.08, least_df: int = 20) -> DataFrame:
    """(a, b, weight): all stories that share features (story, feature, weight) of up to max(least_df, ratio * stories) stories.

    Commoner features are given by common_members. A pair is made once, at the first feature
    both have, with the weight of all of them; so pairs need no shuffle of their own.
    """
    sized, cap = _sized(features, ratio, least_df)
    kept = features.join(sized.where(F.col("n") <= cap).select("feature"), "feature")
    own = kept.groupBy("story").agg(F.array_sort(F.collect_set(F.struct("feature", "weight"))).alias("own"))
    rows = own.select("story", "own", F.explode("own.feature").alias("feature"))
    a = rows.select("feature", F.col("story").alias("a"), F.col("own").alias("own_a"))
    b = rows.select("feature", F.col("story").alias("b"), F.col("own.feature").alias("own_b"))
    both = F.filter("own_a", lambda f: F.array_contains("own_b", f["feature"]))
    met = a.join(b, "feature").where("a < b").select("a", "b", "feature", both.alias("both")).where(F.col("both")[0]["feature"] == F.col("feature"))
    return met.select("a", "b", F.round(F.aggregate("both", F.lit(0.0), lambda t, f: t + f["weight"]), 6).alias("weight"))


# Weights of shared features, phrases that name no topic, and what distance in time costs.
FEATURE_WEIGHTS = {"pain": 0.5, "topic": 0.45, "action": 0.12}
GENERIC_TOPICS = ["ai agent", "artificial intelligence", "machine learning", "open source", "president trump", "social media", "united states", "white house"]
FAR, FARTHER = (30, 0.08), (45, 0.2)


def story_features(stories: DataFrame) -> DataFrame:
    """Adds `features`, an array of (feature, weight), to stories (story, title, excerpt): topics (pairs of neighbouring words of the title's first five), pains and an action."""
    words = F.filter(F.split(tx.normalized_title(F.col("title")), " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    rows = stories.withColumn("_w", F.slice(F.transform(words, tx.stem), 1, 5))
    twos = F.filter(tx.shingles(F.col("_w"), 2), lambda t: (F.substring_index(t, " ", 1) != F.substring_index(t, " ", -1)) & ~t.isin(GENERIC_TOPICS))
    body = F.concat_ws(" ", "title", "excerpt")
    named = lambda values, kind: F.transform(values, lambda v: F.struct(F.concat(F.lit(f"{kind}:"), v).alias("feature"), F.lit(FEATURE_WEIGHTS[kind]).alias("weight")))
    topics = F.when(tx.is_low_signal(F.col("title")), F.array().cast("array<string>")).otherwise(F.array_distinct(twos))
    found = F.concat(named(topics, "topic"), named(classify.pain_points(body), "pain"), named(F.array_compact(F.array(classify.action_hint(body))), "action"))
    return rows.withColumn("features", found).drop("_w")


def dated_edges(edges: DataFrame, stories: DataFrame) -> DataFrame:
    """Edges (a, b, weight) of stories (story, first, last) less what the days between them cost."""
    side = lambda s: stories.select(F.col("story").alias(s), F.to_date("first").alias(f"f{s}"), F.to_date("last").alias(f"l{s}"))
    apart = F.greatest(F.date_diff("fa", "lb"), F.date_diff("fb", "la"), F.lit(0))
    cost = F.when(apart > FARTHER[0], FARTHER[1]).when(apart > FAR[0], FAR[1]).otherwise(0.0)
    return edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(F.col("weight") - cost, 4).alias("weight"))


def best_edges(edges: DataFrame, most: int, least: float) -> DataFrame:
    """Edges (a, b, weight) of at least this weight that are among the best `most` of either end, ties by the other end."""
    kept = edges.where(F.col("weight") >= least)
    ends = kept.select("a", "b", "weight", F.col("a").alias("n"), F.col("b").alias("o")).union(kept.select("a", "b", "weight", F.col("b").alias("n"), F.col("a").alias("o")))
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("weight"), "o"))
    return ends.withColumn("k", place).where(F.col("k") <= most).select("a", "b", "weight").distinct()


def common_members(features: DataFrame, ratio: float = 0.08, least_df: int = 20) -> DataFrame:
    """(feature, story, weight): members of the features that are too common for feature_edges; together they hold every link."""
    sized, cap = _sized(features, ratio, least_df)
    return features.join(sized.where(F.col("n") > cap).select("feature"), "feature").select("feature", "story", "weight").distinct()


def strong_links(features: DataFrame, ratio: float = 0.08, least_df: int = 20) -> DataFrame:
    """(a, b): stars with the components of stories that share two features of feature_edges or more, in proportion to the memberships."""
    sized, cap = _sized(features, ratio, least_df)
    kept = features.join(sized.where(F.col("n") <= cap).select("feature"), "feature").select("story", "feature").distinct()
    two = kept.join(kept.select("story", F.col("feature").alias("other")), "story").where("feature < other")
    hub = F.min("story").over(Window.partitionBy("feature", "other"))
    return two.select(hub.alias("a"), F.col("story").alias("b")).where("a <> b").distinct()


def leader_clusters(vectors: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(scope, id, leader): in id order a vector joins the first cluster whose running mean has this cosine, else it leads one.

    Order-dependent by definition, so a scope (a release of stories) is one group; releases run in parallel.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        rows = np.array(group["embedding"].tolist(), dtype=float)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
        sums, leaders, out = np.zeros_like(rows), [], []
        for name, row in zip(group["id"], rows):
            means = sums[: len(leaders)]
            close = (means @ row) / np.maximum(np.linalg.norm(means, axis=1), 1e-30)
            hit = np.flatnonzero(close >= threshold)
            at = int(hit[0]) if len(hit) else len(leaders)
            if not len(hit):
                leaders.append(name)
            sums[at] += row
            out.append(leaders[at])
        return pd.DataFrame({"scope": group["scope"], "id": group["id"], "leader": out})

    return vectors.groupBy("scope").applyInPandas(solve, "scope int, id bigint, leader bigint")


def term_weights(titles: DataFrame, terms: int = 4) -> DataFrame:
    """(cluster, rank, term, weight): class-based tf-idf of words and word pairs of titles (cluster, words)."""
    pairs = F.when(F.size("words") >= 2, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))
    rows = titles.select("cluster", F.explode(F.concat("words", pairs)).alias("term"))
    clusters = titles.select("cluster").distinct().count()
    tf = rows.groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((1 + F.lit(clusters)) / (1 + F.col("df"))) + 1
    weight = F.round(F.col("tf") * idf * F.when(F.col("term").contains(" "), 1.3).otherwise(1.0), 6)
    ranked = tf.join(df, "term").withColumn("weight", weight)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")))
    return ranked.where(F.col("rank") <= terms).select("cluster", "rank", "term", "weight")


def precision_threshold(scores: DataFrame, target: float) -> float | None:
    """The lowest score (score, label) at which the rows from there up have the target precision; else the highest score; null without rows.

    Counted per distinct score, so the driver gets one number; equal scores stand or fall together.
    """
    per = scores.groupBy("score").agg(F.sum(F.col("label").cast("int")).alias("tp"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score"))
    run = per.withColumn("precision", F.sum("tp").over(down) / F.sum("n").over(down))
    row = run.agg(F.min(F.when(F.col("precision") >= target, F.col("score"))).alias("at"), F.max("score").alias("top")).first()
    return row["at"] if row["at"] is not None else row["top"]


def model_row(features: list[str], weights: list[float], bias: float) -> tuple[str, str]:
    """(JSON, hash) of a linear model: features in order, numbers with eight decimals, so that equal models have equal hashes."""
    if len(features) != len(weights):
        raise ValueError("a weight for each feature")
    text = json.dumps({"bias": f"{bias:.8f}", "features": features, "weights": [f"{w:.8f}" for w in weights]}, sort_keys=True, separators=(",", ":"))
    return text, hashlib.sha256(text.encode()).hexdigest()[:16]


def discover(method: str, ways: dict[str, Callable[[DataFrame], DataFrame]], stories: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Trends by one of several ways over stories (story, …), with `verified` (story) of these only; an unknown method is refused."""
    if method not in ways:
        raise ValueError(f"no method {method}: {', '.join(sorted(ways))}")
    return ways[method](stories if verified is None else stories.join(verified.select("story").distinct(), "story", "left_semi"))
