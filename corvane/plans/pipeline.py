"""Queries of the way from landed posts to items, stories, samples, shelves and release books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import classify, ids, scores, urls
from corvane.functions import text as tx
from corvane.operators import clusterer, pairs, releases, samples, trends
from corvane.operators.diversify import capped_feed
from corvane.plans.base import I_SQL, P_SQL, day, day_sql, items_now, posts_now
from corvane.plans.serving import ORACLE as SERVING
from corvane.plans.serving import w4_direction
from corvane.plans.texts import DOMAIN_SQL, SIGNAL_SQL, _HOSTS, _URL, _quoted
from corvane.runtime import Scratch, ship_package, table
from corvane.sources import adapters, landed
from corvane.sources.items import to_items

QUERIES, ORACLE = {}, {}
ORACLE_W4 = SERVING["w4_direction"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def canonical_sql(u: str) -> str:
    """SQL of urls.canonical_url for one expression."""
    part = lambda k: f"regexp_extract({u}, {_URL}, {k})"
    path = f"case when {part(3)} = '/' then '/' else regexp_replace({part(3)}, '/+$', '') end"
    kept = f"array_to_string(list_filter(string_split({part(4)}, '&'), lambda z: regexp_matches(z, '^[^=]+=.') and not regexp_matches(lower(z), '^(?:{'|'.join(urls.TRACKING.split())})=')), '&')"
    return f"(case when {part(1)} = '' then '' else 'https://' || {_HOSTS.replace('case h ', f'case lower(trim({part(2)})) ').replace('else h end', f'else lower(trim({part(2)})) end')} || {path} || case when {kept} <> '' then '?' || {kept} else '' end end)"


@query(f"""with {P_SQL}, l as (select *, {canonical_sql("coalesce(url, '')")} as target, {canonical_sql("case when starts_with(permalink, 'http') then permalink else 'https://forum.example' || coalesce(permalink, '') end")} as talk from p join (select post_id, max_by(permalink, ingested_at) as permalink from posts where snapshot_id = (select max(snapshot_id) from posts) group by 1) using (post_id)),
c as (select *, case when target <> '' and not starts_with(target, 'https://forum.example') and not coalesce(is_self, false) then target else talk end as address from l)
select 'forum:' || post_id as item_id, 'forum' as provider, 'voices' as source_cluster, address as canonical_url, target as target_url, talk as discussion_url, case when coalesce(selftext, '') = '' then 'headline' else 'excerpt' end as content_scope,
subreddit as source_section, 'dedupe_' || substr(sha256(address), 1, 20) as dedupe_group_id, coalesce(score, 0)::double as score, coalesce(num_comments, 0)::double as comments from c""")
def s19_items_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the last delivery's posts, as of a landed forum file."""
    last = table(spark, sf_dir, "posts").agg(F.max("snapshot_id")).first()[0]
    links = table(spark, sf_dir, "posts").where(F.col("snapshot_id") == last).groupBy("post_id").agg(F.max_by("permalink", "ingested_at").alias("permalink"))
    posts = posts_now(spark, sf_dir).join(links, "post_id").withColumn("monitoring_type", F.lit("hot"))
    items = to_items(posts, "posts.jsonl", day(spark, sf_dir) + "T23:59:59Z")
    figures = [F.element_at("raw_engagement", F.lit(k)).alias(k) for k in ("score", "comments")]
    return items.select("item_id", "provider", "source_cluster", "canonical_url", "target_url", "discussion_url", "content_scope", "source_section", "dedupe_group_id", *figures)


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ship_package(spark)
    items = items_now(spark, sf_dir).withColumnRenamed("canonical_url", "url").withColumn("one", F.lit(1))
    rows = Scratch(spark, "clusters").save(clusterer.prepared(items, "snapshot_date", "item_id"), "rows")
    return rows, Scratch(spark, "clusters").save(clusterer.story_clusters(rows), "stories")


@query()
def o8_story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of each run's items, in order."""
    return _clustered(spark, sf_dir)[1]


@query()
def j10_merged_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of different providers that tell one event."""
    return clusterer.merged_stories(*_clustered(spark, sf_dir))


@query(f"""with {I_SQL}, t as (select item_id, lower(array_to_string(string_split_regex(trim(title), '\\s+'), ' ')) as n from i where title is not null),
k as (select item_id, n, list_filter(list_transform(regexp_extract_all(n, '[a-z0-9]+'), lambda x: x), lambda x: length(x) >= 2) as w from t),
f as (select item_id, unnest(list_concat(list_transform(w, lambda x: {{'f': 'tok:' || x, 'v': 1.0::double}}), list_transform(list_filter(range(1, len(w)), lambda p: w[p] <> w[p + 1]), lambda p: {{'f': 'bi:' || w[p] || '_' || w[p + 1], 'v': 1.25::double}}),
list_transform(list_filter(range(1, greatest(length(n) - 1, 1)), lambda p: not contains(substr(n, p, 3), ' ')), lambda p: {{'f': 'tri:' || substr(n, p, 3), 'v': 0.35::double}}))) as x from k),
b as (select item_id, ('0x' || substr(sha256(x.f), 1, 8))::bigint % 384 as position, case when ('0x' || substr(sha256(x.f), 9, 2))::bigint % 2 = 1 then x.v else -x.v end as v from f),
s as (select item_id, position, sum(v) as v from b group by 1, 2), l as (select item_id, sqrt(sum(v * v)) as l from s group by 1) select item_id, position::int as position, round(v / l, 4) as value from s join l using (item_id) where l > 0 and abs(v) > 1e-9""")
def c27_lexical_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed lexical vectors of titles, 384 places, as their places that aren't 0."""
    rows = items_now(spark, sf_dir).where("title is not null").select("item_id", "title")
    return tx.lexical_vectors(rows, "item_id", "title").select("item_id", "position", F.round("value", 4).alias("value"))


_PAIRS_SQL = "l as (select item_id_a, item_id_b, max(score) as score from cluster_candidate_pairs where score is not null and score < 0.82 and item_id_a <> item_id_b and experiment_id = (select min(experiment_id) from cluster_candidate_pairs) group by 1, 2), c as (select item_id, max(source_cluster) as c from items group by 1), r as (select item_id_a as a, item_id_b as b, score, least(x.c, y.c) || '|' || greatest(x.c, y.c) as stratum, sha256('13|' || item_id_a || '|' || item_id_b) as h from l join c x on x.item_id = item_id_a join c y on y.item_id = item_id_b)"


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "cluster_candidate_pairs")
    first = pairs.agg(F.min("experiment_id")).first()[0]
    pairs = pairs.where((F.col("score") < 0.82) & (F.col("item_id_a") != F.col("item_id_b")) & (F.col("experiment_id") == first)).groupBy("item_id_a", "item_id_b").agg(F.max("score").alias("score"))
    clusters = table(spark, sf_dir, "items").groupBy("item_id").agg(F.max("source_cluster").alias("c"))
    rows = pairs.join(clusters.toDF("item_id_a", "x"), "item_id_a").join(clusters.toDF("item_id_b", "y"), "item_id_b")
    return rows.select(F.col("item_id_a").alias("a"), F.col("item_id_b").alias("b"), "score", F.concat_ws("|", F.least("x", "y"), F.greatest("x", "y")).alias("stratum"))


@query(f"""with {_PAIRS_SQL}, x as (select a, b from (select *, row_number() over (order by (score between 0.45 and 0.65) desc, h) as k from r where stratum = 'mainstream|voices') where k <= 9),
w as (select *, row_number() over (partition by stratum order by h) as n from r where score between 0.45 and 0.65 and (a, b) not in (select (a, b) from x)),
y as (select a, b from (select *, row_number() over (order by n, stratum) as k from w) where k <= greatest(0, 30 - (select count(*) from x join r using (a, b) where score between 0.45 and 0.65))),
v as (select *, row_number() over (partition by stratum order by h) as n from r where not (score between 0.45 and 0.65) and (a, b) not in (select (a, b) from x)),
z as (select a, b from (select *, row_number() over (order by n, stratum) as k from v) where k <= 60 - (select count(*) from x) - (select count(*) from y))
select a, b, 'cross' as part from x union all select a, b, 'boundary' from y union all select a, b, 'tail' from z""")
def t7_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 60 pairs for review: rare cross-source pairs first, half from the boundary, the rest from outside, strata in turn."""
    return samples.review_sample(_strata(spark, sf_dir), 60)


@query(f"""with {I_SQL}, s as (select item_id, provider, source_cluster as c, coalesce(liked, 0) as v, sha256('13|' || item_id) as h from i), k as (select count(distinct c) as k from s),
x as (select item_id from (select *, row_number() over (partition by c order by v desc, item_id) as n from s) where n <= 140 // (select k from k)),
y as (select item_id from (select *, row_number() over (order by v desc, item_id) as n from s where item_id not in (select item_id from x)) where n <= 40),
z as (select item_id from (select *, row_number() over (order by h) as n from s where item_id not in (select item_id from x union all select item_id from y)) where n <= 20),
a as (select item_id, 1 as p from x union all select item_id, 2 from y union all select item_id, 3 from z), o as (select a.item_id, p, provider, row_number() over (partition by provider order by p, case when p = 3 then 0 else -v end, case when p = 3 then h else '' end, a.item_id) as n from a join s using (item_id))
select item_id, case p when 1 then 'cluster' when 2 then 'global' else 'exploration' end as part from o where n <= 80""")
def t8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 items, 70 % evenly by cluster, 20 % by value, 10 % by chance, at most 40 % of one provider."""
    rows = items_now(spark, sf_dir).select("item_id", "provider", F.col("source_cluster").alias("cluster"), F.coalesce("liked", F.lit(0.0)).alias("value"))
    return samples.selection(rows, 200)


@query()
def o11_community_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh posts, at most three of a kind and two of a section, without those on a shelf; a refused row uses up no place."""
    posts = posts_now(spark, sf_dir)
    shelved = posts.where("score is not null").orderBy(F.desc("score"), "post_id").limit(6).select("post_id")
    kind = classify.signal_type(F.col("title"), F.col("selftext"), F.col("subreddit"), F.col("url"), F.col("is_self"))
    rows = posts.join(shelved, "post_id", "left_anti").select("post_id", kind.alias("kind"), F.lower("subreddit").alias("section"), F.coalesce("num_comments", F.lit(0)).cast("double").alias("rank_score"))
    return capped_feed(rows, {"kind": 3, "section": 2}, 30, key="post_id")


_TRENDS = "x as (select unnest(domain_ids) as trend, dedupe_group_id as story, provider, source_cluster, snapshot_date as d from items where dedupe_group_id <> '')"


@query(f"""with {_TRENDS} select trend, count(distinct story) as stories, min(d) as first_seen, max(d) as last_seen, count(distinct d) as dates, count(distinct provider) as providers, count(distinct source_cluster) as clusters,
case when count(distinct source_cluster) > 1 then 'mixed' else max(source_cluster) end as scope, round(least(0.95::double, 0.42::double + 0.06::double * count(distinct story) + 0.05::double * count(distinct source_cluster) + 0.03::double * count(distinct d)), 4) as confidence from x group by 1""")
def a23_trend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, providers, clusters, scope and confidence of trends."""
    return trends.rollup(_trend_rows(spark, sf_dir))


def _trend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''")
    return rows.select(F.explode("domain_ids").alias("trend"), F.col("dedupe_group_id").alias("story"), "provider", "source_cluster", F.col("snapshot_date").alias("day"))


@query(f"""with {_TRENDS}, g as (select trend, count(distinct provider) > 1 as cross_source, bool_or(source_cluster = 'voices') as v, bool_or(source_cluster = 'mainstream') as m, min(d) as first, max(d) as last, count(distinct d) as dates from x group by 1)
select trend, case when v and not m then 'community_first' when m and not v then 'mainstream_only' when cross_source then 'cross_source' else 'unclassified' end as kind,
case when date_diff('day', cast(first as date), cast({day_sql()} as date)) <= 2 then 'new' when dates >= 5 and first <> last then 'growing' else 'stable' end as lifecycle from g""")
def c21_trend_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a trend by who tells it, and its life by age."""
    return trends.kinds(_trend_rows(spark, sf_dir), day(spark, sf_dir))


_STORY = "s as (select dedupe_group_id as story, count(distinct item_id) as n, count(distinct provider) as p, count(distinct source_cluster) as c, min(title) as title from items where dedupe_group_id <> '' group by 1)"


def _story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").groupBy(F.col("dedupe_group_id").alias("story"))
    return rows.agg(F.count_distinct("item_id").alias("n"), F.count_distinct("provider").alias("p"), F.count_distinct("source_cluster").alias("c"), F.min("title").alias("title"))


_QUALITY = f"""with {_STORY}, d as ({DOMAIN_SQL}), e as (select item_id, unnest(string_split(domains, '|')) as domain, domains from d), u as (select unnest([{_quoted([n for n, _ in classify.RUBRICS])}]) as rubric),
b as (select item_id, case {" ".join(f"when split_part(domains, '|', 1) in ({_quoted(ids)}) then '{name}'" for name, ids in classify.RUBRICS)} else 'other' end as rubric from d), rc as (select u.rubric, count(b.item_id) as n from u left join b using (rubric) group by 1), g as ({SIGNAL_SQL}),
k as (select count(*) as n from d)
select (select count(*) from s) as stories_total, (select count(*) from s where n = 1) as stories_single, (select count(*) from s where n > 1) as stories_multi, (select count(*) from s where p > 1) as stories_cross_source,
(select count(*) from s where p = 1 and n >= 5) as stories_overmerge_ge5, (select count(*) from s where p = 1 and n >= 8) as stories_overmerge_ge8, round((select count(*) from s) / n, 4) as stories_compression,
round(1000 * (select count(*) from s where n > 1) / n, 1) as stories_multi_per_1k, round(1000 * (select count(*) from s where p > 1) / n, 1) as stories_cross_source_per_1k, n as taxonomy_items,
round(100 * (select count(*) from e where domain = 'ai_technology') / n, 2) as taxonomy_ai_tech_share, round(100 * (select count(*) from e where domain = 'other') / n, 2) as taxonomy_other_share, round(100 * (select count(*) from d where domains = 'ai_technology') / n, 2) as taxonomy_ai_only_share,
round(100 * (select max(n) from rc) / n, 2) as taxonomy_max_rubric_share, (select count(*) from rc where n = 0) as taxonomy_empty_rubrics, round(100 * (select count(*) from g where signal_type = 'other') / (select count(*) from g), 2) as pulse_other_share, (select count(*) from g) as pulse_total from k"""


def release_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of quality metrics of stories, domains, rubrics and signals."""
    stories = _story_rows(spark, sf_dir).agg(
        F.count("*").alias("stories_total"), F.count_if(F.col("n") == 1).alias("stories_single"), F.count_if(F.col("n") > 1).alias("stories_multi"), F.count_if(F.col("p") > 1).alias("stories_cross_source"),
        F.count_if((F.col("p") == 1) & (F.col("n") >= 5)).alias("stories_overmerge_ge5"), F.count_if((F.col("p") == 1) & (F.col("n") >= 8)).alias("stories_overmerge_ge8"),
    )
    facets = classify.with_domains(items_now(spark, sf_dir), "title", "excerpt", "found").select("found", classify.rubric(F.col("found")).alias("rubric"))
    of = {name: F.count_if(F.col("rubric") == name) for name, _ in classify.RUBRICS}
    n = F.count("*")
    share = lambda c: F.round(100 * F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 2)
    kinds = facets.agg(
        n.alias("taxonomy_items"), share(F.array_contains("found", "ai_technology")).alias("taxonomy_ai_tech_share"), share(F.array_contains("found", "other")).alias("taxonomy_other_share"),
        share((F.size("found") == 1) & (F.col("found")[0] == "ai_technology")).alias("taxonomy_ai_only_share"), F.round(100 * F.greatest(*of.values()) / F.greatest(n, F.lit(1)), 2).alias("taxonomy_max_rubric_share"),
        sum((F.when(c == 0, 1).otherwise(0) for c in of.values()), F.lit(0)).alias("taxonomy_empty_rubrics"),
    )
    signal = classify.signal_type(F.col("title"), F.col("selftext"), F.col("subreddit"), F.col("url"), F.col("is_self"))
    pulse = posts_now(spark, sf_dir).select(signal.alias("kind")).agg(share(F.col("kind") == "other").alias("pulse_other_share"), n.alias("pulse_total"))
    one = stories.join(kinds).join(pulse)  # one row each
    per = lambda c, times, digits: F.round(times * F.col(c) / F.greatest("taxonomy_items", F.lit(1)), digits)
    return one.withColumns({"stories_compression": per("stories_total", 1, 4), "stories_multi_per_1k": per("stories_multi", 1000, 1), "stories_cross_source_per_1k": per("stories_cross_source", 1000, 1)})


@query(_QUALITY)
def a15_release_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics of a release; single-provider stories count as overmerged."""
    return release_metrics(spark, sf_dir)


_FLOORED = [m for m, _, _ in trends.RELEASE_FLOORS if not m.startswith("trends_")]
_COMPARED = [m for m in trends.TOLERANCES if not m.startswith("trends_")]


@query(f"""with m as ({_QUALITY}), v as (unpivot (select {", ".join(f"{c}::double as {c}" for c in dict.fromkeys(_FLOORED + _COMPARED))} from m) on columns(*) into name metric value value),
f(metric, op, bound) as (values {", ".join(f"('{m}', '{o}', {b}::double)" for m, o, b in trends.RELEASE_FLOORS)})
select 'floor' as check, metric, value, case op when 'max' then value <= bound else value >= bound end as passed from f join v using (metric) union all select 'regression', metric, value, true from v where metric in ({_quoted(_COMPARED)})""")
def a16_release_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors of a release, and its regressions against itself as the baseline (none)."""
    metrics = Scratch(spark, "quality").save(release_metrics(spark, sf_dir), "metrics")
    floors = trends.floors_of(metrics, trends.RELEASE_FLOORS).select(F.lit("floor").alias("check"), "metric", "value", "passed")
    return floors.unionByName(trends.regressions(metrics, metrics).select(F.lit("regression").alias("check"), "metric", F.col("current").alias("value"), (~F.col("regressed")).alias("passed")))


@query("""with l as (select experiment_id, count(*) as pairs, count(score) as reviewed, sum(case when score >= 0.62 then 1 else 0 end) as useful from cluster_candidate_pairs group by 1)
select experiment_id, pairs, reviewed, round(useful / greatest(reviewed, 1), 4) as usefulness, round(reviewed / pairs, 4) as coverage, reviewed >= 10 and useful / greatest(reviewed, 1) >= 0.75 and reviewed = pairs as passed from l""")
def a18_release_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usefulness and review coverage of a release, and its gate."""
    rows = table(spark, sf_dir, "cluster_candidate_pairs").groupBy("experiment_id").agg(F.count("*").alias("pairs"), F.count("score").alias("reviewed"), F.sum(F.when(F.col("score") >= 0.62, 1).otherwise(0)).alias("useful"))
    use = F.col("useful") / F.greatest("reviewed", F.lit(1))
    passed = (F.col("reviewed") >= 10) & (use >= 0.75) & (F.col("reviewed") == F.col("pairs"))
    return rows.select("experiment_id", "pairs", "reviewed", F.round(use, 4).alias("usefulness"), F.round(F.col("reviewed") / F.col("pairs"), 4).alias("coverage"), passed.alias("passed"))


@query(f"""with {_STORY} select count(*) as stories, count(*) filter (p > 1) as cross_source, count(*) filter (p > 1 and c > 1) as confirmed, count(*) filter (n > 1 and p = 1) as candidate from s""")
def a28_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a dashboard."""
    col = F.col
    return _story_rows(spark, sf_dir).agg(F.count("*").alias("stories"), F.count_if(col("p") > 1).alias("cross_source"), F.count_if((col("p") > 1) & (col("c") > 1)).alias("confirmed"), F.count_if((col("n") > 1) & (col("p") == 1)).alias("candidate"))


@query("""select snapshot_id, snapshot_date, count(distinct post_id) as posts from snapshots left join posts using (snapshot_id, snapshot_date) group by 1, 2 order by snapshot_id desc limit 5""")
def x1_snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five snapshots with their posts."""
    last = table(spark, sf_dir, "snapshots").orderBy(F.desc("snapshot_id")).limit(5).select("snapshot_id", "snapshot_date")
    posts = table(spark, sf_dir, "posts").select("snapshot_id", "snapshot_date", "post_id")
    return last.join(posts, ["snapshot_id", "snapshot_date"], "left").groupBy("snapshot_id", "snapshot_date").agg(F.count_distinct("post_id").alias("posts"))


@query("""with o as (select split_part(run_id, ':', 1) as run, item_id, max(observed_at) as at from observations where item_id is not null group by 1, 2), h as (select run, split_part(item_id, ':', 1) as provider, count(*) as n from o group by 1, 2)
select run, count(*) as providers, sum(n)::bigint as items, min(n) as least from h group by 1""")
def x2_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection stores: one observation an item and run, and its health by provider."""
    one = table(spark, sf_dir, "observations").where("item_id is not null").groupBy(F.substring_index("run_id", ":", 1).alias("run"), "item_id").agg(F.max("observed_at").alias("at"))
    health = one.groupBy("run", F.substring_index("item_id", ":", 1).alias("provider")).agg(F.count("*").alias("n"))
    return health.groupBy("run").agg(F.count("*").alias("providers"), F.sum("n").alias("items"), F.min("n").alias("least"))


@query(f"""with {P_SQL}, t as (select post_id, score, row_number() over (order by score desc nulls last, post_id) as k from p), s as (select count(distinct lower(subreddit)) as sections from p)
select case when k <= 5 then 'short' else 'long' end as digest, k as place, post_id, score, sections from t, s where k <= 10""")
def x8_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a short and a long digest, with the number of sections."""
    posts = posts_now(spark, sf_dir).select("post_id", "score", F.lower("subreddit").alias("section"))
    top = posts.orderBy(F.desc_nulls_last("score"), "post_id").limit(10)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "post_id"))  # ten rows
    top = top.withColumn("place", place).join(posts.agg(F.count_distinct("section").alias("sections")))
    return top.select(F.when(F.col("place") <= 5, "short").otherwise("long").alias("digest"), "place", "post_id", "score", "sections")


@query(f"""with {_STORY}, e as (select experiment_id, count(distinct item_id_a || '|' || item_id_b) as pairs, count(distinct item_id_a) filter (score >= 0.62) as accepted from cluster_candidate_pairs group by 1) select experiment_id, pairs, accepted, (select count(*) from s where n >= 2) as current from e""")
def x13_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of each experiment beside the current stories."""
    pairs = table(spark, sf_dir, "cluster_candidate_pairs").groupBy("experiment_id").agg(F.count_distinct(F.concat_ws("|", "item_id_a", "item_id_b")).alias("pairs"), F.count_distinct(F.when(F.col("score") >= 0.62, F.col("item_id_a"))).alias("accepted"))
    return pairs.join(_story_rows(spark, sf_dir).agg(F.count_if(F.col("n") >= 2).alias("current")))


@query("""with v as (select provider as component, tier as version, source_cluster as detail, row_number() over (partition by source_cluster order by tier desc, provider) as k from sources) select detail as component, version, component as source from v where k = 1""")
def x16_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of each component."""
    rows = table(spark, sf_dir, "sources").groupBy(F.col("source_cluster").alias("component")).agg(F.min(F.struct((-F.col("tier")).alias("t"), "provider")).alias("m"))
    return rows.select("component", (-F.col("m.t")).alias("version"), F.col("m.provider").alias("source"))


@query(f"""with g as ({SIGNAL_SQL}), p as (select post_id, max(score) as score, max(title) as title from posts where snapshot_id = (select max(snapshot_id) from posts) group by 1), r as (select signal_type, g.post_id, row_number() over (partition by signal_type order by score desc nulls last, g.post_id) as k from g join p using (post_id))
select signal_type, k as place, post_id from r where k <= 5""")
def x20_signal_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best posts of each kind of signal."""
    kind = classify.signal_type(F.col("title"), F.col("selftext"), F.col("subreddit"), F.col("url"), F.col("is_self"))
    last = table(spark, sf_dir, "posts").agg(F.max("snapshot_id")).first()[0]
    best = table(spark, sf_dir, "posts").where(F.col("snapshot_id") == last).groupBy("post_id").agg(F.max("score").alias("best"))
    rows = posts_now(spark, sf_dir).select("post_id", kind.alias("signal_type")).join(best, "post_id")
    place = F.row_number().over(Window.partitionBy("signal_type").orderBy(F.desc_nulls_last("best"), "post_id"))
    return rows.withColumn("place", place).where("place <= 5").select("signal_type", "place", "post_id")


@query("""with l as (select item_id_a as a, item_id_b as b, max(score) as score from cluster_candidate_pairs where score is not null group by 1, 2), d as (select distinct item_id_a as a, item_id_b as b from cluster_candidate_pairs where experiment_id = (select min(experiment_id) from cluster_candidate_pairs))
select a, b, score from l where not exists (select 1 from d where d.a = l.a and d.b = l.b) order by (score >= 0.62 and score < 0.82) desc, round(abs(score - 0.82), 9), a, b limit 40""")
def x28_active_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs not yet labelled, those for review first, nearest the boundary first."""
    rows = table(spark, sf_dir, "cluster_candidate_pairs").withColumnsRenamed({"item_id_a": "a", "item_id_b": "b"})
    first = rows.agg(F.min("experiment_id")).first()[0]
    done = rows.where(F.col("experiment_id") == first).select("a", "b").distinct()
    open_ = rows.where("score is not null").groupBy("a", "b").agg(F.max("score").alias("score")).join(done, ["a", "b"], "left_anti")
    review = F.col("score").between(0.62, 0.82) & (F.col("score") < 0.82)
    return open_.orderBy(F.desc(review), F.round(F.abs(F.col("score") - 0.82), 9), "a", "b").limit(40)


@query("""with r as (select i.dedupe_group_id as story, split_part(o.run_id, ':', 1) as run, count(distinct o.item_id) as n from observations o join (select distinct item_id, dedupe_group_id from items where dedupe_group_id <> '') i using (item_id) group by 1, 2),
k as (select *, row_number() over (partition by story order by run desc) as k from r) select story, string_agg(run || '=' || n, ' ' order by run desc) as history from k where k <= 3 group by 1""")
def x29_story_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story's figures in its last three runs."""
    items = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").select("item_id", F.col("dedupe_group_id").alias("story")).distinct()
    rows = table(spark, sf_dir, "observations").select("item_id", F.substring_index("run_id", ":", 1).alias("run")).join(items, "item_id")
    rows = rows.groupBy("story", "run").agg(F.count_distinct("item_id").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("story").orderBy(F.desc("run")))).where("k <= 3")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "run", "n"))), lambda x: F.concat_ws("=", x.run, x.n.cast("string")))
    return rows.groupBy("story").agg(F.array_join(parts, " ").alias("history"))


@query("""select dedupe_group_id as story, array_to_string(list_sort(list(distinct source_cluster)), '|') as clusters from items where dedupe_group_id <> '' and source_cluster is not null group by 1""")
def x33_clusters_of_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a story as a set."""
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").groupBy(F.col("dedupe_group_id").alias("story")).agg(F.array_join(F.array_sort(F.collect_set("source_cluster")), "|").alias("clusters"))
    return rows.where("clusters <> ''")


@query(f"""with {_TRENDS.replace("provider,", "provider, item_id,")}, s as (select trend, story, count(distinct item_id) as n from x group by 1, 2), r as (select *, row_number() over (partition by trend order by n desc, story) as k from s), e as (select distinct trend, story, item_id from x), v as (select e.*, row_number() over (partition by trend, story order by item_id) as j from e)
select trend, story, k as place, string_agg(item_id, ' ' order by j) as evidence from r join v using (trend, story) where k <= 8 and j <= 3 group by 1, 2, 3""")
def x34_trend_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest stories of a trend with three items each."""
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").select(F.explode("domain_ids").alias("trend"), F.col("dedupe_group_id").alias("story"), "item_id").distinct()
    size = rows.groupBy("trend", "story").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("trend").orderBy(F.desc("n"), "story"))).where("place <= 8")
    some = rows.join(size, ["trend", "story"]).withColumn("j", F.row_number().over(Window.partitionBy("trend", "story").orderBy("item_id"))).where("j <= 3")
    return some.groupBy("trend", "story", "place").agg(F.array_join(F.array_sort(F.collect_list("item_id")), " ").alias("evidence"))


@query(f"""with {I_SQL}, r as (select item_id, provider, liked, row_number() over (partition by provider order by liked desc nulls last, item_id) as k, row_number() over (order by liked desc nulls last, item_id) as a from i)
select 'all' as section, item_id, a as place from r where a <= 15 union all select provider, item_id, k from r where k <= 3""")
def x39_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a report: the best of all sources, and of each."""
    rows = items_now(spark, sf_dir).select("item_id", "provider", "liked")
    order = [F.desc_nulls_last("liked"), F.col("item_id")]
    top = rows.orderBy(*order).limit(15)
    top = top.select(F.lit("all").alias("section"), "item_id", F.row_number().over(Window.orderBy(*order)).alias("place"))  # fifteen rows
    own = rows.withColumn("place", F.row_number().over(Window.partitionBy("provider").orderBy(*order))).where("place <= 3")
    return top.unionByName(own.select(F.col("provider").alias("section"), "item_id", "place"))


@query("""with u as (select distinct provider, item_id, canonical_url as url from items where canonical_url <> ''), r as (select *, row_number() over (partition by provider, url order by item_id) as k from u), c as (select provider, item_id, row_number() over (partition by provider order by item_id) as n from r where k = 1) select provider, item_id from c where n <= 20""")
def x40_capped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's first twenty addresses, one row an address."""
    rows = table(spark, sf_dir, "items").where("canonical_url <> ''").groupBy("provider", "canonical_url").agg(F.min("item_id").alias("item_id"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("provider").orderBy("item_id"))).where("n <= 20").select("provider", "item_id")


_CHANGES = ORACLE_W4.replace("select story, day, n as items", ", w as (select story, day, n as items", 1) + ")"


@query(f"""{_CHANGES}, z as (select * from w where day = (select max(day) from w)), t as (select story, items from z where direction in ('new', 'growing', 'resurfacing') order by items desc, story limit 5),
s as (select story, items from z where direction in ('stable', 'fading') order by items desc, story limit 10), m as (select story, items from z where story not in (select story from t) order by items desc, story limit 10)
select 'top' as part, story, items from t union all select 'watch', story, items from s union all select 'mega', story, items from m""")
def o14_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest changes of the last run, ten stories to watch, and the ten largest that aren't among the changes."""
    rows = w4_direction(spark, sf_dir)
    last = Scratch(spark, "briefing").save(rows.where(F.col("day") == rows.agg(F.max("day")).first()[0]).select("story", "items", "direction"), "last")
    best = lambda df, most: df.orderBy(F.desc("items"), "story").limit(most).select("story", "items")
    top = best(last.where(F.col("direction").isin("new", "growing", "resurfacing")), 5)
    parts = {"top": top, "watch": best(last.where(F.col("direction").isin("stable", "fading")), 10), "mega": best(last.join(top.select("story"), "story", "left_anti"), 10)}
    named = [df.select(F.lit(part).alias("part"), "story", "items") for part, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""with t as (select dedupe_group_id as story, item_id, provider, title from items where dedupe_group_id <> '' and title is not null), g as (select story, count(distinct item_id) as n, count(distinct provider) as p from t group by 1),
e as (select distinct story, title, len(list_distinct(regexp_extract_all(regexp_replace(title, '[^\\x00-\\x7f]', ' ', 'g'), '__ENTITY__'))) as e, length(title) as l from t), b as (select *, row_number() over (partition by story order by e desc, l, title) as k from e)
select g.story, b.title, round(least(0.97::double, 0.55::double + 0.06::double * n + 0.08::double * p), 4) as confidence from g join b using (story) where k = 1 and n >= 2""".replace("__ENTITY__", tx.ENTITY))
def x11_story_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: proposed stories of two items or more, named by the title of most entities, the shortest of these, with confidence."""
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> '' and title is not null")
    plain = F.regexp_replace("title", r"[^\x00-\x7f]", " ")
    named = F.size(F.array_distinct(F.regexp_extract_all(plain, F.lit(tx.ENTITY), F.lit(0))))
    best = F.min(F.struct((-named).alias("e"), F.char_length("title").alias("l"), "title")).alias("b")
    rows = rows.groupBy(F.col("dedupe_group_id").alias("story")).agg(F.count_distinct("item_id").alias("n"), F.count_distinct("provider").alias("p"), best).where("n >= 2")
    return rows.select("story", "b.title", F.round(F.least(F.lit(0.97), 0.55 + 0.06 * F.col("n") + 0.08 * F.col("p")), 4).alias("confidence"))


@query("""with b as (select item_id, snapshot_date as d, sha256(coalesce(title, '') || '|' || coalesce(excerpt, '')) as h from items), l as (select distinct item_id, h from b where d = __LAST__), o as (select distinct item_id, h from b where d < __LAST__)
select l.item_id, l.h as checksum, case when exists (select 1 from o where o.item_id = l.item_id and o.h = l.h) then 'imported' when exists (select 1 from o where o.item_id = l.item_id) then 'mismatch' else 'registered' end as status from l""".replace("__LAST__", day_sql()))
def x15_import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the last batch against the earlier ones by checksum."""
    last = day(spark, sf_dir)
    rows = table(spark, sf_dir, "items").select("item_id", "snapshot_date", F.sha2(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit(""))), 256).alias("checksum"))
    old = rows.where(F.col("snapshot_date") < last).select("item_id", "checksum").distinct()
    new = rows.where(F.col("snapshot_date") == last).select("item_id", "checksum").distinct()
    same, known = old.withColumn("same", F.lit(True)), old.select("item_id").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("same"), "imported").when(F.col("known"), "mismatch").otherwise("registered")
    return new.join(same, ["item_id", "checksum"], "left").join(known, "item_id", "left").select("item_id", "checksum", status.alias("status"))


@query("""with c as (select source_cluster as source, count(*) as n from items where source_cluster is not null group by 1) select source, 'ok' as status, n as rows from c union all select 'broken', 'error', 0 union all select 'silent', 'empty', 0 union all select 'unheard', 'skipped', 0""")
def x3_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of adapters: one for each cluster, one that fails, one without rows, and a source without any."""
    items = table(spark, sf_dir, "items")
    names = [r[0] for r in items.where("source_cluster is not null").select("source_cluster").distinct().collect()]  # a few clusters

    def broken(_: SparkSession) -> DataFrame:
        raise ValueError("no answer")

    run = {name: (lambda _, n=name: items.where(F.col("source_cluster") == n)) for name in names}
    run |= {"broken": broken, "silent": lambda _: items.limit(0)}
    return adapters.run_adapters(spark, run, [*names, "broken", "silent", "unheard"])[1].select("source", "status", "rows")


@query("select snapshot_date, count(*) as rows from (select distinct snapshot_date, post_id, subreddit, score from posts) group by 1")
def x7_snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots written as files partitioned by date, and read back."""
    path = Scratch(spark, "snapshots").path("written")
    posts = table(spark, sf_dir, "posts").select("snapshot_date", "post_id", "subreddit", "score").distinct()
    adapters.write_snapshot({"posts": posts}, path, "snapshot_date")
    rows = spark.read.schema(posts.schema).parquet(f"{path}/posts")
    return rows.groupBy("snapshot_date").agg(F.count("*").alias("rows"))


@query("""with p as (select distinct post_id, keyword from posts where snapshot_id = (select max(snapshot_id) from posts)) select 'forum:' || post_id as item_id, max(coalesce(keyword, '')) as keyword from p group by 1""")
def s26_items_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's landed files, scans and keyword searches, read again into items."""
    last = table(spark, sf_dir, "posts").agg(F.max("snapshot_id")).first()[0]
    scratch, posts = Scratch(spark, "day"), table(spark, sf_dir, "posts").where(F.col("snapshot_id") == last).drop("snapshot_id", "ingested_at")
    posts.where("keyword is null").write.json(scratch.path("day/posts.jsonl"))
    posts.where("keyword is not null").write.json(scratch.path("day/keyword-search.jsonl"))
    items, _ = adapters.items_of_day(spark, scratch.path("day"), ["posts.jsonl", "keyword-search.jsonl"], day(spark, sf_dir) + "T23:59:59Z")
    words = posts.groupBy(F.concat(F.lit("forum:"), "post_id").alias("item_id")).agg(F.max(F.coalesce("keyword", F.lit(""))).alias("keyword"))
    return items.select("item_id").join(words, "item_id")


@query("""with l as (select item_id_a as a, item_id_b as b, max(score) as score from cluster_candidate_pairs where score is not null group by 1, 2), j as (select a, b, sha256(a || '|' || b) as input from l where score >= 0.62 and score < 0.82),
c as (select distinct sha256(item_id_a || '|' || item_id_b) as input, max(score) as confidence from cluster_candidate_pairs where experiment_id = (select max(experiment_id) from cluster_candidate_pairs) and score is not null group by 1)
select a, b, case when confidence is null then 'open' when confidence >= 0.85 then 'merge' when confidence between 0 and 1 then 'keep' else 'invalid' end as outcome from j left join c using (input)""")
def o22_review_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for review against answers kept by the hash of their input: open ones, merges of enough confidence, others, and answers that aren't valid."""
    rows = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null").select("experiment_id", F.col("item_id_a").alias("a"), F.col("item_id_b").alias("b"), "score")
    key = F.sha2(F.concat_ws("|", "a", "b"), 256).alias("input")
    jobs = rows.groupBy("a", "b").agg(F.max("score").alias("score")).where("score >= 0.62 and score < 0.82").select("a", "b", key)
    last = table(spark, sf_dir, "cluster_candidate_pairs").agg(F.max("experiment_id")).first()[0]
    kept = rows.where(F.col("experiment_id") == last).groupBy(key).agg(F.max("score").alias("confidence"))
    c = F.col("confidence")
    outcome = F.when(c.isNull(), "open").when(c >= 0.85, "merge").when(c.between(0, 1), "keep").otherwise("invalid")
    return jobs.join(kept, "input", "left").select("a", "b", outcome.alias("outcome"))


@query("""with s as (select distinct item_id_a as a, item_id_b as b from cluster_candidate_pairs where experiment_id = (select min(experiment_id) from cluster_candidate_pairs)), i as (select item_id_a as a, item_id_b as b, score, row_number() over (partition by item_id_a, item_id_b order by score desc nulls last) as k from cluster_candidate_pairs where experiment_id = (select max(experiment_id) from cluster_candidate_pairs))
select case when k > 1 then 'repeated' when score is null then 'unlabelled' when exists (select 1 from s where s.a = i.a and s.b = i.b) then 'imported' else 'unknown' end as outcome, count(*) as labels from i group by 1""")
def o25_label_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one experiment put to another's pairs: imported, repeated, without a label, and of unknown pairs."""
    rows = table(spark, sf_dir, "cluster_candidate_pairs").withColumnsRenamed({"item_id_a": "a", "item_id_b": "b"})
    low, high = rows.agg(F.min("experiment_id"), F.max("experiment_id")).first()
    known = rows.where(F.col("experiment_id") == low).select("a", "b").distinct().withColumn("known", F.lit(True))
    k = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc_nulls_last("score")))
    labels = rows.where(F.col("experiment_id") == high).withColumn("k", k).join(known, ["a", "b"], "left")
    outcome = F.when(F.col("k") > 1, "repeated").when(F.col("score").isNull(), "unlabelled").when(F.col("known"), "imported").otherwise("unknown")
    return labels.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("labels"))


@query(f"""with {_TRENDS}, d as (select trend, d, count(distinct story) as n from x group by 1, 2), l as (select *, lag(n) over (partition by trend order by d) as n0 from d), c as (select trend, n, case when n0 is null then 'new' when n / greatest(n0, 1) >= 1.5 then 'growing' when n / greatest(n0, 1) < 0.75 then 'fading' else 'stable' end as life from l where d = {day_sql()})
select trend, life, n from c where n >= 2 and life <> 'stable' order by case life when 'growing' then 1 when 'new' then 2 else 3 end, n desc, trend limit 5""")
def x36_change_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first changes of trends in the last run: growing, new, fading ones."""
    rows = _trend_rows(spark, sf_dir).groupBy("trend", "day").agg(F.count_distinct("story").alias("n"))
    rows = rows.withColumn("before", F.lag("n").over(Window.partitionBy("trend").orderBy("day"))).where(F.col("day") == day(spark, sf_dir))
    life = scores.lifecycle(F.lit(True), F.col("n"), F.col("before"), F.lit(2))
    rank = F.when(F.col("life") == "growing", 1).when(F.col("life") == "new", 2).otherwise(3)
    return rows.withColumn("life", life).where("n >= 2 and life <> 'stable'").orderBy(rank, F.desc("n"), "trend").limit(5).select("trend", "life", "n")


@query(f"with {I_SQL} select item_id, case " + " ".join(f"when contains(lower(canonical_url), '{x}') then '{y}'" for x, y in landed.FEED_SECTIONS) + " else 'top' end as section from i where canonical_url is not null")
def s7_feed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section of an address by its words."""
    return items_now(spark, sf_dir).where("canonical_url is not null").select("item_id", landed.feed_section(F.col("canonical_url")).alias("section"))


@query("select provider, cast(null as double) as weight, host, round(tier::double, 8) as tier from sources")
def x17_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read by a later schema: missing columns are null, types are cast."""
    schema = T.StructType([T.StructField("provider", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("host", T.StringType()), T.StructField("tier", T.DoubleType())])
    return landed.with_defaults(table(spark, sf_dir, "sources"), schema).withColumn("tier", F.round("tier", 8))


@query("select distinct least(item_id_a, item_id_b) || '|' || greatest(item_id_a, item_id_b) as pair from cluster_candidate_pairs where item_id_a is not null and item_id_b is not null")
def c40_pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by a key that doesn't depend on their order."""
    rows = table(spark, sf_dir, "cluster_candidate_pairs").where("item_id_a is not null and item_id_b is not null")
    return rows.select(ids.pair_key(F.col("item_id_a"), F.col("item_id_b")).alias("pair")).distinct()


@query("""with l as (select item_id_a as a, item_id_b as b, max(score) as s from cluster_candidate_pairs where score is not null group by 1, 2) select a, b, round(1 / (1 + exp(-(8 * s - 5))), 6) as chance from l""")
def c41_logistic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic score of a pair."""
    rows = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null").groupBy(F.col("item_id_a").alias("a"), F.col("item_id_b").alias("b")).agg(F.max("score").alias("s"))
    return rows.select("a", "b", F.round(scores.sigmoid(8 * F.col("s") - 5), 6).alias("chance"))


@query("with n as (select count(distinct item_id) as n from items) select 'items-r1' as id, n as rows from n union all select 'items-r2', n from n union all select 'posts-r1', count(distinct post_id) from posts")
def x10_release_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases registered under the next free id of their stem."""
    root = Scratch(spark, "register").path("releases")
    items, posts = table(spark, sf_dir, "items").select("item_id").distinct(), table(spark, sf_dir, "posts").select("post_id").distinct()
    for rows, stem in ((items, "items"), (posts, "posts"), (items, "items")):
        releases.register(rows, root, stem)
    return spark.createDataFrame([(r["id"], r["rows"]) for r in releases.registered(spark, root)], "id string, rows bigint")


@query(ORACLE["o14_briefing"])
def x30_briefing_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A briefing stored as a release and read back by the newest of its versions."""
    root = Scratch(spark, "briefings").path("store")
    rows = o14_briefing(spark, sf_dir)
    for version in (1, 2):
        last = releases.register(rows, root, "briefing", {"version": version})
    return releases.verify(spark, f"{root}/{last}").select("part", "story", "items")


_MODEL = trends.model_row(["title", "jaccard", "dense"], [0.46, 0.18, 0.22], -1.5)


@query(f"select '{_MODEL[0]}' as model, substr(sha256('{_MODEL[0]}'), 1, 16) as hash")
def x42_model_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model as a row, with its hash."""
    return spark.createDataFrame([_MODEL], "model string, hash string")


@query("""with v as (select dedupe_group_id as story from items where dedupe_group_id <> '' group by 1 having count(distinct provider) >= 2), x as (select distinct unnest(domain_ids) || ':' || coalesce(source_section, '') as bucket, dedupe_group_id as story from items where dedupe_group_id in (select story from v))
select bucket, count(*) as stories from x group by 1""")
def x24_verified_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends by the bucket method, of verified stories only."""
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").select(F.col("dedupe_group_id").alias("story"), "provider", F.explode_outer("domain_ids").alias("d"), F.coalesce("source_section", F.lit("")).alias("s"))
    verified = rows.groupBy("story").agg(F.count_distinct("provider").alias("p")).where("p >= 2")
    buckets = lambda df: df.where("d is not null").select(F.concat_ws(":", "d", "s").alias("bucket"), "story").distinct().groupBy("bucket").agg(F.count("*").alias("stories"))
    return trends.discover("bucket", {"bucket": buckets}, rows, verified)


@query()
def t9_engine_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty seeds from the providers in turn, each with its best neighbour by address or title."""
    ship_package(spark)
    rows = items_now(spark, sf_dir).select("item_id", "provider", F.col("source_section").alias("section"), F.col("snapshot_date").alias("day"), F.col("canonical_url").alias("url"), "target_url", "title", "excerpt")
    rows = Scratch(spark, "slice").save(pairs.featured(rows), "rows")
    side = lambda s: rows.select(F.col("item_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("day", "words", "joined", "urls")))
    met = pairs.blocked_pairs(pairs.blocking_keys(rows)).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    met = met.select("a", "b", tx.fuzzy_udf()("joined_a", "joined_b").alias("title"), F.size(F.array_intersect("words_a", "words_b")).alias("n_shared"), F.arrays_overlap("urls_a", "urls_b").alias("same_url"), F.abs(F.date_diff("day_a", "day_b")).alias("days"))
    return samples.with_neighbours(rows, Scratch(spark, "slice").save(met, "met"), 60)
