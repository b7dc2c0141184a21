"""Candidate pairs by blocking, and their scoring ladder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import classify, urls
from corvane.functions import text as tx

# Thresholds and weights of the pair score, without and with a dense similarity.
AUTO, REVIEW, NEAR_BITS, NEAR_SHINGLES = 0.82, 0.62, 18, 0.34
WEIGHTS = {"title": 0.46, "jaccard": 0.18, "entity": 0.18, "dense": 0.0, "time": 0.08, "independent": 0.06, "theme": 0.04, "action": 0.04, "number": -0.16, "place": -0.18, "person": -0.18}
DENSE_WEIGHTS = WEIGHTS | {"title": 0.34, "jaccard": 0.12, "entity": 0.14, "dense": 0.22}
DENSE_AUTO, DENSE_REVIEW = 0.88, 0.72
# Words of an event.
EVENT_WORDS = (
    "acquire acquires ban bans block blocks buy buys charge charges crash cuts delay delays drop drops fall falls hire hiring invest invests launch launches layoff lawsuit leak leaks "
    "pause pauses raise raises release releases resign resigns sell sells strike strikes sue sues tumble tumbles"
)
BUCKET_LIMIT, NEAR_LIMIT = 32, 40
COLUMNS = ["provider", "section", "day", "url", "urls", "words", "entities", "numbers", "places", "people", "action", "themes", "joined", "shingles", "print", "generic", "prompt"]


def featured(items: DataFrame) -> DataFrame:
    """Items (item_id, provider, section, day, url, target_url, title, excerpt) with all that pairs are scored by.

    Optional columns of arrays: `people` and `themes`; without them there are none. Routine
    material is left out. Null texts and addresses count as empty.
    """
    known = {c: F.col(c) if c in items.columns else F.array().cast("array<string>") for c in ("people", "themes")}
    body = F.concat_ws(". ", "title", "excerpt")
    rows = items.where(~classify.is_routine(F.col("title"), F.col("section"))).withColumn("joined", tx.normalized_title(F.col("title")))
    rows = rows.withColumn("words", F.array_distinct(F.filter(F.split("joined", " "), lambda w: w != "")))
    rows = rows.withColumn("shingles", tx.title_shingles(F.col("words")))
    return rows.select("item_id", *[
        v.alias(c) for c, v in {
            **{c: F.coalesce(c, F.lit("")) for c in ("provider", "section", "url")}, "day": F.to_date("day"), "urls": urls.url_set(F.col("url"), F.col("target_url")), "words": F.col("words"),
            "entities": tx.meaningful_entities(F.col("title")), "numbers": classify.typed_numbers(F.col("title")), "places": classify.places(body), "action": classify.action_hint(body), **known,
            "joined": F.col("joined"), "shingles": F.col("shingles"), "print": tx.simhash(tx.near_features(F.col("words"))), "generic": tx.is_generic(F.col("joined")) | tx.is_low_signal(F.col("title")),
            "prompt": classify.is_prompt(F.col("title")),
        }.items()
    ])


def blocking_keys(rows: DataFrame) -> DataFrame:
    """(item_id, key, reason): addresses; and of titles that say something their near-duplicate keys, words and entities."""
    keyed = lambda values, mark, reason: F.transform(values, lambda k: F.struct(F.concat(F.lit(mark), k).alias("key"), F.lit(reason).alias("reason")))
    near = F.when(F.size("words") >= 3, F.concat(F.transform(tx.bands(F.col("print")), lambda b: F.concat(F.lit("b:"), b)), tx.min_hashes(F.col("words")))).otherwise(F.array().cast("array<string>"))
    titled = F.concat(keyed(near, "n:", "near"), keyed(F.col("words"), "w:", "token"), keyed(F.col("entities"), "e:", "entity"))
    keys = F.concat(keyed(F.col("urls"), "u:", "url"), F.when(F.col("generic"), F.array().cast(titled_type())).otherwise(titled))
    return rows.select("item_id", F.explode(keys).alias("k")).select("item_id", "k.key", "k.reason").distinct()


def titled_type() -> str:
    return "array<struct<key:string,reason:string>>"


def blocked_pairs(keys: DataFrame, limit: int = BUCKET_LIMIT, near_limit: int = NEAR_LIMIT, budget: int | None = None) -> DataFrame:
    """(a, b, reasons): items that share a key of 2 to `limit` items (`near_limit` for near-duplicate keys).

    A word or entity of more items blocks nothing: it is too common to tell two items apart.
    An address or near-duplicate key of more items pairs each of them with its smallest one, so
    all stay linked. A budget keeps the pairs of the smallest buckets; without one all are kept.
    """
    sized = keys.groupBy("key", "reason").agg(F.count("*").alias("count"), F.min("item_id").alias("hub")).where("count >= 2")
    most = F.when(F.col("reason") == "near", near_limit).otherwise(limit)
    kept = keys.join(sized.where((F.col("count") <= most) | F.col("reason").isin("url", "near")), ["key", "reason"])
    few, many = kept.where(F.col("count") <= most), kept.where(F.col("count") > most)
    a = few.select("key", "reason", "count", F.col("item_id").alias("a"))
    b = few.select("key", F.col("item_id").alias("b"))
    met = a.join(b, "key").where("a < b").select("a", "b", "reason", "count")
    stars = many.where("item_id <> hub").select(F.col("hub").alias("a"), F.col("item_id").alias("b"), "reason", "count")
    pairs = met.union(stars).groupBy("a", "b")
    pairs = pairs.agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.min("count").alias("smallest"))
    if budget:
        pairs = pairs.orderBy("smallest", "a", "b").limit(budget)
    return pairs.select("a", "b", "reasons")


def scored(pairs: DataFrame, rows: DataFrame, bounded: bool = False) -> DataFrame:
    """Features, score and decision (auto, review, reject) of candidate pairs (a, b, reasons); pairs that reach no bound are dropped.

    pairs may have a column `dense` with a similarity. The ladder, first rule wins: an address
    that tells an event; a model's address with like titles; generic titles are dropped; hard
    conflicts of numbers, places or persons; near-duplicate titles; an event told by two
    providers; exact titles; enough score with a shared entity and number; review. With
    `bounded`, pairs for review with enough evidence are accepted for groups of bounded size.
    """
    side = lambda s: rows.select(F.col("item_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in COLUMNS))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    if "dense" not in pairs.columns:
        both = both.withColumn("dense", F.lit(None).cast("double"))
    common = lambda c: F.array_intersect(f"{c}_a", f"{c}_b")
    count = lambda c: F.size(common(c))
    apart = lambda c: (F.size(f"{c}_a") > 0) & (F.size(f"{c}_b") > 0) & (count(c) == 0)
    either = lambda c: F.least(F.size(f"{c}_a"), F.size(f"{c}_b"))
    col, no = F.col, lambda c: F.coalesce(c, F.lit(False))
    both = both.withColumns({
        "shared_urls": common("urls"), "shared_words": common("words"), "anchors": F.filter(common("entities"), tx.is_anchor), "title": tx.fuzzy_udf()("joined_a", "joined_b"),
        "days": F.coalesce(F.abs(F.date_diff("day_a", "day_b")), F.lit(0)), "independent": col("provider_a") != col("provider_b"),
        "jaccard": tx.jaccard(col("words_a"), col("words_b")), "shingled": tx.jaccard(col("shingles_a"), col("shingles_b")), "bits": tx.hamming(col("print_a"), col("print_b")),
    })
    both = both.withColumns({
        "shared_entities": F.size("anchors"), "entity": F.size("anchors") / F.greatest(either("entities"), F.lit(1)), "number_conflict": classify.number_conflict(col("numbers_a"), col("numbers_b")),
        "place_conflict": apart("places"), "person_conflict": apart("people") & (col("title") < 0.88), "same_number": count("numbers") > 0, "same_action": no(col("action_a") == col("action_b")),
        "event_words": F.size(F.filter("shared_words", lambda w: w.isin(EVENT_WORDS.split()))), "n_shared": F.size("shared_words"), "event_url": F.exists("shared_urls", lambda u: ~urls.is_lasting(u)),
        "model_url": F.exists("shared_urls", urls.is_model) & (F.size("shared_words") >= 1) & (col("jaccard") >= 0.25) & (col("days") <= 7),
    })
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = {
        "title": col("title"), "jaccard": col("jaccard"), "entity": col("entity"), "dense": F.coalesce("dense", F.lit(0.0)), "time": F.when(col("days") <= 2, 1.0).when(col("days") <= 7, 0.7).otherwise(0.3),
        "independent": flag(col("independent")), "theme": flag(count("themes") > 0), "action": flag(col("same_action")), "number": flag(col("number_conflict")), "place": flag(col("place_conflict")), "person": flag(col("person_conflict")),
    }
    total = lambda weights: reduce(lambda x, y: x + y, (weights[k] * v for k, v in parts.items()))
    base = F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.when(col("dense").isNull(), total(WEIGHTS)).otherwise(total(DENSE_WEIGHTS)))), 4)
    both = both.withColumn("base", base)
    title, jaccard, n, ents = col("title"), col("jaccard"), col("n_shared"), col("shared_entities")
    hard = (col("number_conflict") & (ents < 2) & (title < 0.9)) | col("place_conflict") | col("person_conflict")
    near = F.array_contains("reasons", "near") & (col("days") <= 7) & (col("bits") <= NEAR_BITS) & ((col("shingled") >= NEAR_SHINGLES) | (jaccard >= 0.45) | (title >= 0.86))
    strong = (jaccard >= 0.42) & (title >= 0.83) & ((ents >= 2) | (title >= 0.88)) & ((col("event_words") > 0) | ((title >= 0.86) & (n >= 5)))
    short = (title >= 0.86) & (jaccard >= 0.18) & (col("event_words") > 0) & ((ents > 0) | (n >= 3))
    told = F.arrays_overlap("reasons", F.array(*map(F.lit, ("token", "entity", "dense"))))
    event = col("independent") & (col("days") <= 3) & (strong | short) & told
    exact = (title >= 0.98) & (jaccard >= 0.72) & (col("days") <= 3) & (col("independent") | (col("section_a") != col("section_b")) | (col("url_a") != col("url_b")))
    sure = (col("base") >= AUTO) & (ents > 0) & col("same_number")
    dense = no(col("dense") >= DENSE_REVIEW) & ((title >= 0.5) | (jaccard >= 0.2) | (ents > 0) | col("same_number"))
    dense = dense | (no(col("dense") >= DENSE_AUTO) & ((title >= 0.68) | (jaccard >= 0.32) | col("same_number")) & ((ents > 0) | (title >= 0.82)))
    evidence = F.lit(bounded) & ~(col("prompt_a") & col("prompt_b")) & (title >= 0.5) & (jaccard >= 0.08) & (col("entity") >= 0.5) & (col("days") <= 7)
    as_ = lambda decision, name, score=None: F.struct(F.lit(decision).alias("decision"), F.lit(name).alias("rule"), (col("base") if score is None else score).alias("score"))
    at_least = lambda bound: F.greatest(col("base"), F.lit(bound))
    rule = (
        F.when(col("event_url"), as_("auto", "shared address", F.lit(1.0)))
        .when(col("model_url"), as_("auto", "shared model address", F.lit(0.86)))
        .when(col("generic_a") | col("generic_b") | (either("words") == 0), None)
        .when(hard, as_("reject", "conflict"))
        .when(near, as_("auto", "near duplicate", at_least(0.86)))
        .when(event, as_("auto", "cross source", at_least(0.84)))
        .when(exact, as_("auto", "exact title"))
        .when(sure, as_("auto", "score"))
        .when(((col("base") >= REVIEW) | dense) & evidence, as_("auto", "bounded"))
        .when((col("base") >= REVIEW) | dense, as_("review", "score"))
    )
    out = both.withColumn("d", rule).where("d is not null")
    conflict = ~col("event_url") & ~col("model_url") & (col("number_conflict") | col("place_conflict") | col("person_conflict"))
    return out.select(
        "a", "b", col("d.score").alias("score"), "d.decision", "d.rule", F.round("title", 6).alias("title"), F.round("jaccard", 6).alias("jaccard"), "shared_entities", "days", "independent",
        conflict.alias("conflict"), F.when(col("independent"), F.lit(None)).otherwise(col("provider_a")).alias("provider"), "reasons",
    )


def top_cosine(vectors: DataFrame, k: int, least: float, cells: int | None = None, block: int = 4_096) -> DataFrame:
    """(a, b, cosine): the k nearest of every vector (id, embedding), in both directions, from `least` on.

    Vectors are compared in blocks of cells x cells, each a matrix product of about block x
    block, and every block's top k are merged; cells grow with the table, so no task does.
    Exact, so the work grows with the square of the rows.
    """
    if cells is None:
        cells = max(2, -(-vectors.count() // block))
    import numpy as np
    import pandas as pd

    spread = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"))
    all_cells = F.array(*map(F.lit, range(cells)))
    left = spread.withColumn("other", F.explode(all_cells)).select("id", "embedding", F.col("cell").alias("x"), F.col("other").alias("y"))
    right = spread.withColumn("other", F.explode(all_cells)).select(F.col("id").alias("id2"), F.col("embedding").alias("embedding2"), F.col("other").alias("x2"), F.col("cell").alias("y2"))

    def block(_, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        if not len(one) or not len(two):
            return empty
        unit = lambda v: (m := np.array(v.tolist(), dtype=np.float64)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        a, b = one["id"].to_numpy(), two["id2"].to_numpy()
        cosine = unit(one["embedding"]) @ unit(two["embedding2"]).T
        cosine[a[:, None] == b[None, :]] = -2
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(a)), best.shape[1])
        found = pd.DataFrame({"a": a[rows], "b": b[best.ravel()], "cosine": cosine[rows, best.ravel()]})
        return found[found["cosine"] >= least]

    near = left.groupBy("x", "y").cogroup(right.groupBy("x2", "y2")).applyInPandas(block, "a bigint, b bigint, cosine double")
    near = near.withColumn("cosine", F.round("cosine", 6))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))
