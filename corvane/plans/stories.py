"""Queries of candidate pairs, stories, trends, labels and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import classify
from corvane.functions import text as tx
from corvane.operators import grouping, pairs, trends
from corvane.plans.base import I_SQL, LABELLED_SQL, day, items_now, labelled
from corvane.operators.similar import distinct_sets, jaccard_pairs, repetition
from corvane.plans.texts import PULSE_SQL, _WORDS_SQL
from corvane.runtime import Scratch, ship_package, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items_now(spark, sf_dir).select("item_id", "provider", F.col("source_section").alias("section"), F.col("snapshot_date").alias("day"), F.col("canonical_url").alias("url"), "target_url", "title", "excerpt")
    return pairs.featured(rows)


_ROUTINE_SQL = f"(lower(trim(coalesce(source_section, ''))) in ({', '.join(repr(x) for x in classify.ROUTINE_SECTIONS.split())}) or regexp_matches(lower(coalesce(title, '')), '{classify.ROUTINE}'))"
_GENERIC = ", ".join("'" + x + "'" for x in tx.GENERIC_TITLES)
_LOW_SQL = "|".join(tx.LOW_SIGNAL).replace("'", "''")


@query(rf"""with {I_SQL}, n as (select item_id, {_WORDS_SQL} as w, title, canonical_url, target_url from i where not {_ROUTINE_SQL}),
t as (select *, not (array_to_string(w, ' ') in ({_GENERIC}) or len(list_filter(w, lambda x: x <> '')) < 3 or regexp_matches(lower(trim(coalesce(title, ''))), '{_LOW_SQL}')) as good from n),
k as (select item_id, 'w:' || unnest(list_distinct(list_filter(w, lambda x: x <> ''))) as key, 'token' as reason from t where good
union all select item_id, 'e:' || e, 'entity' from (select item_id, unnest(list_distinct(list_transform(regexp_extract_all(regexp_replace(title, '[^\x00-\x7f]', ' ', 'g'), '{tx.ENTITY}'), lambda x: lower(x)))) as e from t where good) where length(e) >= 2 and e not in ({', '.join(repr(x) for x in tx.GENERIC_ENTITIES.split())})
union all select distinct item_id, 'u:' || u, 'url' from (select item_id, regexp_replace(unnest([canonical_url, target_url]), '/+$', '') as u from t) where u <> '' and not contains(u, '://forum.example/')),
c as (select key, count(*) as n, min(item_id) as hub from k group by 1 having count(*) >= 2), s as (select k.*, n, hub from k join c using (key) where n <= 32 or reason = 'url'),
p as (select a.item_id as a, b.item_id as b, a.reason from s a join s b on a.key = b.key and a.item_id < b.item_id and a.n <= 32 union all select hub, item_id, reason from s where n > 32 and item_id <> hub)
select a, b, array_to_string(list_sort(list_distinct(list(reason))), '|') as reasons from p group by 1, 2""")
def j7_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs by shared address, word or entity, without routine material; the near-duplicate keys are in j7_near_pairs."""
    keys = pairs.blocking_keys(_featured(spark, sf_dir)).where("reason <> 'near'")
    return pairs.blocked_pairs(keys).select("a", "b", F.array_join("reasons", "|").alias("reasons"))


@query()
def j7_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs by fingerprint bands and min-hashes of titles."""
    keys = pairs.blocking_keys(_featured(spark, sf_dir)).where("reason = 'near'")
    return pairs.blocked_pairs(keys).select("a", "b")


def _pairs(spark: SparkSession, sf_dir: str, bounded: bool = False) -> DataFrame:
    ship_package(spark)
    rows = Scratch(spark, "featured").save(_featured(spark, sf_dir), "rows")
    return pairs.scored(pairs.blocked_pairs(pairs.blocking_keys(rows)), rows, bounded)


@query()
def o1_pair_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision of every candidate pair."""
    return _pairs(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "|"))


@query()
def o2_story_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: stories by medoid-constrained merging of accepted pairs, with the guards for one provider and for conflicts."""
    return grouping.medoid_groups(Scratch(spark, "stories").save(_pairs(spark, sf_dir), "pairs"))


@query()
def o3_bounded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: stories of at most four items, by accepted pairs and pairs with enough evidence."""
    return grouping.medoid_groups(Scratch(spark, "stories").save(_pairs(spark, sf_dir, True), "pairs"), most=4)


@query()
def o4_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of accepted pairs."""
    return grouping.components(_pairs(spark, sf_dir).where("decision = 'auto'").select("a", "b"))


@query()
def x26_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by decision and rule."""
    return _pairs(spark, sf_dir).groupBy("decision", "rule").agg(F.count("*").alias("pairs"))


@query()
def o5_graph_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of at least three stories and two dates, by medoid-constrained merging over shared topics, pains and actions; the fifty largest."""
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> '' and title is not null").groupBy(F.col("dedupe_group_id").alias("story"))
    rows = rows.agg(F.min(F.struct("snapshot_date", "title", "excerpt")).alias("i"), F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last"), F.count_distinct("snapshot_date").alias("dates"))
    rows = Scratch(spark, "trends").save(trends.story_features(rows.select("story", "first", "last", "dates", "i.title", "i.excerpt")), "rows")
    edges = trends.dated_edges(trends.feature_edges(rows.select("story", F.inline("features"))), rows)
    edges = Scratch(spark, "trends").save(trends.best_edges(edges, 12, 0.45), "edges")
    full = edges.select("a", "b", F.col("weight").alias("score"), F.lit("auto").alias("decision"), F.lit("score").alias("rule"), F.lit(False).alias("conflict"), F.lit(None).cast("string").alias("provider"))
    groups = grouping.medoid_groups(full, least_edge=0.4)
    found = groups.join(rows.select(F.col("story").alias("item_id"), "first", "last"), "item_id").groupBy(F.col("story").alias("trend"))
    found = found.agg(F.count("*").alias("stories"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.count_distinct("first").alias("dates"))
    return found.where("stories >= 3 and dates >= 2").orderBy(F.desc("stories"), "trend").limit(50)


@query()
def o9_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the later batches take over the ids of the earlier ones."""
    items = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").select("item_id", F.col("dedupe_group_id").alias("story"), "snapshot_date").distinct()
    old = items.where(F.col("snapshot_date") < day(spark, sf_dir, 2)).select("story", "item_id").distinct()
    new = items.select(F.concat(F.lit("n-"), "story").alias("story"), "item_id").distinct()
    return grouping.carried_identity(old, new)


@query("""with v as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) as l from embeddings),
c as (select a.vec_id as x, b.vec_id as y, round(list_sum(list_transform(range(1, 65), lambda k: a.embedding[k]::double * b.embedding[k])) / (a.l * b.l), 6) as cosine from v a join v b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by x order by cosine desc, y) as k from c where cosine >= 0.2) select least(x, y) as a, greatest(x, y) as b, max(cosine) as cosine from r where k <= 5 group by 1, 2""")
def j8_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of each, in either direction."""
    return pairs.top_cosine(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 5, 0.2)


@query("""with f as (select distinct dedupe_group_id as story, unnest(domain_ids) || ':' || coalesce(source_section, '') as feature from items where dedupe_group_id <> ''),
n as (select feature, count(*) as n from f group by 1 having count(*) between 2 and (select least(500, greatest(20, floor(0.08 * count(distinct story)))) from f)),
w as (select feature from (select feature, sum(n * (n - 1) / 2) over (order by n, feature) as t from n) where t <= 150000)
select a.story as a, b.story as b, round(count(*) * 0.5::double, 6) as weight from f a join f b on a.feature = b.feature and a.story < b.story join w on w.feature = a.feature group by 1, 2""")
def j12_feature_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the story graph by shared features of up to 8 % of the stories; its SQL also caps features and pairs, which shows from sf0.1 on."""
    return trends.feature_edges(_story_features(spark, sf_dir))


@query("""with f as (select distinct dedupe_group_id as story, unnest(domain_ids) || ':' || coalesce(source_section, '') as feature from items where dedupe_group_id <> ''),
n as (select feature from f group by 1 having count(*) > (select greatest(20, floor(0.08 * count(distinct story))) from f)) select feature, story, 0.5::double as weight from f join n using (feature)""")
def j12_common_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the commoner features, as their members."""
    return trends.common_members(_story_features(spark, sf_dir))


def _story_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''")
    rows = rows.select(F.col("dedupe_group_id").alias("story"), F.explode("domain_ids").alias("domain"), F.coalesce("source_section", F.lit("")).alias("section"))
    return rows.select("story", F.concat("domain", F.lit(":"), "section").alias("feature")).distinct().withColumn("weight", F.lit(0.5))


@query(f"""with {I_SQL}, t as (select item_id, coalesce(lower(source_section), '') as s, {PULSE_SQL} as w from i), g as (select w, list_distinct(list(s)) as s from (select list_sort(w) as w, s from t where len(w) > 0) group by 1),
m as (select a.w, b.s from g a join g b on len(a.w) * 2 >= len(b.w) and len(b.w) * 2 >= len(a.w) and len(list_intersect(a.w, b.w)) * 2 >= len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), x as (select w, list_distinct(flatten(list(s))) as s from m group by 1)
select item_id, least(4, len(list_filter(x.s, lambda o: o <> t.s))) as sections from t join x on list_sort(t.w) = x.w where len(list_filter(x.s, lambda o: o <> t.s)) > 0""")
def j13_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many other sections, at most four, titles have at least half of an item's words."""
    items = items_now(spark, sf_dir).select("item_id", F.coalesce(F.lower("source_section"), F.lit("")).alias("s"), tx.pulse_tokens(F.col("title")).alias("w"))
    return repetition(items, "item_id", "s", "w")


@query(f"""with d as (select distinct cast(snapshot_date as date) as day, list_sort({PULSE_SQL}) as w from items), p as (select distinct a.day, a.w from d a join d b on b.day < a.day and b.day >= a.day - 7 and len(a.w) > 0
and len(list_intersect(a.w, b.w)) * 5 >= (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 3) select array_to_string(d.w, ' ') as words, cast(d.day as varchar) as day, p.w is not null as seen from d left join p on p.day = d.day and p.w = d.w where len(d.w) > 0""")
def j14_seen_in_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a headline, as a word set, was there in the seven days before with three fifths of its words."""
    days = table(spark, sf_dir, "items").select(F.array_sort(tx.pulse_tokens(F.col("title"))).alias("w"), F.to_date("snapshot_date").alias("day")).where(F.size("w") > 0).distinct()
    sets = distinct_sets(days, "w")
    dated = days.join(sets, F.col("w") == F.col("words")).select("set_id", "words", "day")
    pairs = jaccard_pairs(sets, 3, 5).select("a", "b")
    ways = pairs.union(pairs.select("b", "a")).union(sets.select("set_id", F.col("set_id"))).toDF("set_id", "b")
    before = dated.select(F.col("set_id").alias("b"), F.col("day").alias("then"))
    seen = dated.join(ways, "set_id").join(before, "b").where((F.col("then") < F.col("day")) & (F.col("then") >= F.date_sub("day", 7))).select("set_id", "day").distinct()
    out = dated.join(seen.withColumn("seen", F.lit(True)), ["set_id", "day"], "left")
    return out.select(F.array_join("words", " ").alias("words"), F.col("day").cast("string").alias("day"), F.coalesce("seen", F.lit(False)).alias("seen"))


@query()
def o7_leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters of vectors within each label."""
    return trends.leader_clusters(table(spark, sf_dir, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), "embedding"))


@query(rf"""with {I_SQL}, t as (select source_cluster as c, list_filter({_WORDS_SQL}, lambda x: x <> '') as w from i),
x as (select c, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) as term from t), f as (select c, term, count(*) as tf from x group by 1, 2), d as (select term, count(*) as df from f group by 1),
s as (select c, f.term, round(tf * (ln((1 + (select count(distinct c) from t)) / (1 + df)) + 1) * case when contains(f.term, ' ') then 1.3 else 1 end, 6) as weight from f join d using (term)),
r as (select *, row_number() over (partition by c order by weight desc, term) as rank from s) select c as cluster, rank, term, weight from r where rank <= 4""")
def c20_ctfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: the terms that name a cluster."""
    words = F.filter(F.split(tx.normalized_title(F.col("title")), " "), lambda w: w != "")
    return trends.term_weights(items_now(spark, sf_dir).select(F.col("source_cluster").alias("cluster"), words.alias("words")))


@query(f"""with {LABELLED_SQL}, p as (select score, sum(label::int) as tp, count(*) as n from labelled group by 1),
r as (select score, sum(tp) over (order by score desc) / sum(n) over (order by score desc) as p from p) select coalesce(min(score) filter (p >= 0.25), max(score)) as threshold from r""")
def o15_precision_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest threshold at which a quarter of the pairs have the label."""
    rows = labelled(spark, sf_dir).select("score", "label")
    return spark.createDataFrame([(trends.precision_threshold(rows, 0.25),)], "threshold double")


@query()
def o15_merge_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic model of labelled pairs over their signals, and its probabilities per decile."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = ["title", "dense", "entity"]
    rows = Scratch(spark, "model").save(labelled(spark, sf_dir), "labelled")  # read many times while fitting
    rows = rows.select(F.col("label").cast("double").alias("label"), *(F.coalesce(F.get_json_object("signals", f"$.{n}").try_cast("double"), F.lit(0.0)).alias(n) for n in names))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    fitted = LogisticRegression(regParam=0.01, maxIter=50).fit(rows).transform(rows)
    decile = F.least(F.floor(F.element_at(_to_array("probability"), 2) * 10), F.lit(9)).cast("int")
    return fitted.groupBy(decile.alias("decile")).agg(F.count("*").alias("pairs"), F.sum("label").alias("accepted"))


def _to_array(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


@query("""with a as (select item_id_a, item_id_b, bool_or(score >= 0.62) filter (experiment_id = 'exp-dense-7d') as d, bool_or(score >= 0.62) filter (experiment_id = 'exp-lexical-7d') as l from cluster_candidate_pairs where score is not null group by 1, 2)
select count(*) filter (d is not null) as dense, count(*) filter (l is not null) as lexical, count(*) filter (d is not null and l is not null) as both, round(avg((d = l)::int), 6) as agreement from a""")
def a19_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two experiments on the pairs both judged; null without any."""
    of = lambda e: F.bool_or(F.when(F.col("experiment_id") == e, F.col("score") >= 0.62))
    rows = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null").groupBy("item_id_a", "item_id_b").agg(of("exp-dense-7d").alias("d"), of("exp-lexical-7d").alias("l"))
    return rows.agg(F.count("d").alias("dense"), F.count("l").alias("lexical"), F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull()).alias("both"), F.round(F.avg((F.col("d") == F.col("l")).cast("int")), 6).alias("agreement"))


@query("""with e as (select experiment_id, quantile_cont(score, [0.5, 0.9, 0.99]) as q from cluster_candidate_pairs where score is not null group by 1)
select experiment_id, round(q[1], 9) as review, round(greatest(q[1], q[2]), 9) as accept, round(greatest(q[1], q[2], q[3]), 9) as same from e""")
def o17_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by quantile transfer, never falling."""
    rows = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null").groupBy("experiment_id").agg(F.percentile("score", [0.5, 0.9, 0.99]).alias("q"))
    q = [F.col("q")[k] for k in range(3)]
    return rows.select("experiment_id", F.round(q[0], 9).alias("review"), F.round(F.greatest(*q[:2]), 9).alias("accept"), F.round(F.greatest(*q), 9).alias("same"))
