"""Stories from accepted pairs: components, and medoid-constrained merging within them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.components import component_labels
from corvane.runtime import Scratch, is_empty


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that edges (a, b) reach."""
    scratch = Scratch(edges.sparkSession, "components")
    return component_labels(scratch, edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def merged(pairs: pd.DataFrame, least_edge: float, single: int = 3, most: int | None = None) -> pd.DataFrame:
    """Items, stories and medoids of one component's pairs (a, b, score, decision, rule, conflict, provider), by greedy merging.

    Accepted pairs are merged from the highest score down, ties by ids. A merge is refused if
    it leaves over `single` items of one provider (provider: that of both items, null if they
    differ) without a shared address or near-duplicate title among them, or an item without an
    accepted, conflict-free pair of `least_edge` or more with the medoid: the item with the largest
    sum of scores, smallest id first. With `most`, the size is bounded instead of the medoid.

    A merge changes only items with pairs between the two groups: of the joined group's
    items just these and the two medoids can be its medoid. So a step costs as much as the
    pairs of the group with fewer of them, and a component may have any size.
    """
    a, b = pairs["a"].to_numpy(dtype=str), pairs["b"].to_numpy(dtype=str)
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, n = ends[: len(a)], ends[len(a) :], len(names)
    score, auto = pairs["score"].to_numpy(), (pairs["decision"] == "auto").to_numpy()
    points = np.rint(score * 10_000).astype(np.int64)  # scores have four decimals: sums are exact
    near = (auto & (score >= least_edge) & ~pairs["conflict"].to_numpy(dtype=bool)).astype(np.int64)
    firm = pairs["rule"].isin(["shared address", "near duplicate"]).to_numpy().astype(np.int64)
    mixed_pair = pairs["provider"].isna().to_numpy().astype(np.int64)
    order = np.flatnonzero(auto)[np.lexsort((y[auto], x[auto], -score[auto]))]
    side, other = np.concatenate([x, y]), np.concatenate([y, x])
    by = np.argsort(side, kind="stable")
    start = np.searchsorted(side[by], np.arange(n + 1)).tolist()
    other = other[by].tolist()
    weight, close, anchor, differ = (np.tile(v, 2)[by].tolist() for v in (points, near, firm, mixed_pair))
    group, members, medoid = list(range(n)), [[i] for i in range(n)], list(range(n))
    total, direct, edges = [0] * n, [0] * n, [start[i + 1] - start[i] for i in range(n)]
    anchors, mixed = [0] * n, [0] * n
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        small, large = group[i], group[j]
        if small == large:
            continue
        if edges[small] > edges[large]:
            small, large = large, small
        more, nearer, held, unlike = {}, {}, anchors[small] + anchors[large], mixed[small] + mixed[large]
        for u in members[small]:
            for k in range(start[u], start[u + 1]):
                v = other[k]
                if group[v] == large:
                    held, unlike = held + anchor[k], unlike + differ[k]
                    for w in (u, v):
                        more[w] = more.get(w, 0) + weight[k]
                        nearer[w] = nearer.get(w, 0) + close[k]
        size = len(members[small]) + len(members[large])
        if most and size > most or size > single and not held and not unlike:
            continue
        best = max({medoid[small], medoid[large], *more}, key=lambda u: (total[u] + more.get(u, 0), -u))
        if not most and direct[best] + nearer.get(best, 0) < size - 1:
            continue
        for u, gain in more.items():
            total[u] += gain
            direct[u] += nearer[u]
        keep, gone = (small, large) if len(members[small]) > len(members[large]) else (large, small)
        for u in members[gone]:
            group[u] = keep
        members[keep] += members[gone]
        members[gone] = []
        edges[keep] += edges[gone]
        medoid[keep], anchors[keep], mixed[keep] = best, held, unlike
    least = [min(m, default=0) for m in members]
    return pd.DataFrame({"item_id": names, "story": [names[least[g]] for g in group], "medoid": [names[medoid[g]] for g in group]})


def medoid_groups(pairs: DataFrame, least_edge: float = 0.55, single: int = 3, most: int | None = None) -> DataFrame:
    """(item_id, story, medoid) of the items with an accepted pair; story is the smallest item of the group. See merged.

    pairs: as given by pairs.scored. Greedy merging never crosses a component of accepted
    pairs, so each is solved by itself, whatever its size, with all its pairs, as scores of
    pairs that aren't accepted count for the medoid too. One task holds the pairs of a component.
    """
    auto = pairs.where("decision = 'auto'")
    roots = Scratch(pairs.sparkSession, "roots").save(components(auto.select("a", "b")), "roots")
    columns = ["a", "b", "score", "decision", "rule", "conflict", "provider"]
    rooted = pairs.select(columns).join(roots.toDF("a", "root"), "a").join(roots.toDF("b", "root_b"), "b").where("root = root_b")
    solve = lambda edges: merged(edges, least_edge, single, most)
    return rooted.select("root", *columns).groupBy("root").applyInPandas(solve, "item_id string, story string, medoid string")


def carried_identity(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new_story, story_id): new stories (story, item_id) take over the id of the old one they share most items with.

    At least two shared items or a Jaccard similarity of .4. Both sides choose: a pair holds
    where each is the other's best, by overlap, similarity and ids, and rounds go on with the rest.
    """
    sizes = lambda df, n: df.groupBy("story").agg(F.count_distinct("item_id").alias(n))
    met = old.withColumnRenamed("story", "o").join(new.withColumnRenamed("story", "n"), "item_id").groupBy("o", "n").agg(F.count_distinct("item_id").alias("k"))
    met = met.join(sizes(old, "so").withColumnRenamed("story", "o"), "o").join(sizes(new, "sn").withColumnRenamed("story", "n"), "n")
    met = met.withColumn("j", F.round(F.col("k") / (F.col("so") + F.col("sn") - F.col("k")), 6)).where("k >= 2 or j >= 0.4")
    order = F.struct(-F.col("k"), -F.col("j"), "o", "n")
    scratch, step, out = Scratch(old.sparkSession, "identity"), 0, None
    met = scratch.save(met.select("o", "n", "k", "j", order.alias("order")), "met-0")
    while not is_empty(met):
        best_o, best_n = met.groupBy("o").agg(F.min("order").alias("order")), met.groupBy("n").agg(F.min("order").alias("order"))
        chosen = scratch.save(met.join(best_o, ["o", "order"]).join(best_n, ["n", "order"]).select("o", "n"), f"chosen-{step}")
        out = chosen if out is None else out.union(chosen)
        step += 1
        met = scratch.save(met.join(chosen.select("o"), "o", "left_anti").join(chosen.select("n"), "n", "left_anti"), f"met-{step}")
    stories = new.select(F.col("story").alias("new_story")).distinct()
    if out is None:
        return stories.withColumn("story_id", F.col("new_story"))
    return stories.join(out.select(F.col("n").alias("new_story"), F.col("o").alias("kept")), "new_story", "left").select("new_story", F.coalesce("kept", "new_story").alias("story_id"))
